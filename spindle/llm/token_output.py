"""Token-ID output: documents in ascending doc_id order, a wavelet matrix file for each shard."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.llm.common import shared_folder, text_slices
from spindle.llm.encoding import worker_encoder
from spindle.llm.wavelet import WaveletMatrix, build

#: Tokens after which a shard ends; one document is never split.
SHARD_TOKENS = 1 << 18
_SHARDS = "part int, seq int, before long, tokens long, unnamed long, file binary"


def _writer(tokenizer: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = worker_encoder(tokenizer), TaskContext.get().partitionId()
        planes = max(encoder.tokenizer.get_vocab_size() - 1, end_id, 1).bit_length()
        doc_ids, bodies, sizes, held, seq, before, unnamed = [], [], [], 0, 0, 0, 0

        def shard() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            file = build(np.concatenate(doc_ids), offsets, np.concatenate(bodies), planes)
            numbers = [pa.array([x], pa.int64()) for x in (before, offsets[-1], unnamed)]
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), *numbers, pa.array([file], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "before", "tokens", "unnamed", "file"])

        for batch in text_slices(batches, most=4 << 20):
            ids, first = encoder.ids(batch["text"])
            ids = np.insert(ids, first[1:], end_id)
            first = first + np.arange(len(first))
            nameless, doc_id, low = np.asarray(batch["doc_id"].is_null()), np.asarray(batch["doc_id"].fill_null(0)), 0
            while low < len(doc_id):
                high = min(int(np.searchsorted(first, first[low] + shard_tokens - held)), len(doc_id))
                high = max(high, low + 1)
                doc_ids.append(doc_id[low:high])
                bodies.append(ids[first[low] : first[high]])
                sizes.append(np.diff(first[low : high + 1]))
                unnamed += int(nameless[low:high].sum())
                held += int(first[high] - first[low])
                low = high
                if held >= shard_tokens:
                    yield shard()
                    doc_ids, bodies, sizes, held, seq, before, unnamed = [], [], [], 0, seq + 1, before + held, 0
        if held:
            yield shard()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes docs (doc_id, text) below path: rows of part, seq, before, tokens, unnamed and file, one for each shard.

    Documents are dealt out by ranges of doc_id and sorted, so (part, seq) orders the shards; before is
    the number of tokens in the shards of the part before this one. Each text is encoded whole and
    end_id appended; a null text gives the end id alone. Rows of one doc_id stand in an order of their texts. Rows
    without doc_id come last, and as many of a shard's last documents as unnamed says are such rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = [F.asc_nulls_last("doc_id"), "th", "text"]  # so that rows of one doc_id, or without one, are dealt out too
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    ranged = docs.repartitionByRange(*order[:2]).sortWithinPartitions(*order).drop("th")
    ranged.mapInArrow(_writer(tokenizer, end_id, shard_tokens), _SHARDS).write.mode("errorifexists").parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, unnamed, file in zip(batch["start"].to_pylist(), batch["unnamed"].to_pylist(), batch["file"], strict=True):
            shard = WaveletMatrix(file.as_py())
            ids = shard.decode(np.uint16 if shard.planes <= 16 else np.uint32).astype("<u4")
            at = shard.offsets
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            nameless = np.arange(len(crc)) >= len(crc) - unnamed
            columns = [pa.array(shard.doc_ids, mask=nameless), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of written shards.

    start: the tokens of all documents before it, within the part as its shards say, and in the parts
    before, of which there are as many as there were write tasks. Files are read where they lie.
    """
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("t"))
    before = parts.select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # a row a write task, so a broadcast by its nature
    placed = shards.join(F.broadcast(before), "part").select((F.col("base") + F.col("before")).alias("start"), "unnamed", "file")
    return placed.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, *, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards into a new folder under the session's checkpoint folder and reads them back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer, end_id=end_id, shard_tokens=shard_tokens)
    return read_shards(spark.read.parquet(path))
