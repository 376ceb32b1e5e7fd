"""Token counts of whole texts, with lengths of pre-tokens looked up where the texts lie.

Two tiers on the map side: a broadcast table holds the lengths, in tokens, of pre-tokens that are
frequent in a bounded sample of documents; those it lacks are encoded once a Python worker and their lengths
kept in its cache, which holds a bounded number of bytes. Neither tier changes a count: both hold what the
tokenizer itself gives. Only the sample's pre-tokens are counted across tasks; those of the corpus are not shuffled.
A pre-token is a run of visible characters with the white space before it, across whose start the tokenizer never merges.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import checkpointed, text_slices
from spindle.llm.encoding import PieceEncoder, pieces

#: Bytes that a piece takes in the cache beside twice its characters: an entry of a dict, and a string's head.
_ENTRY = 150


class PieceCounter(PieceEncoder):
    """Lengths of texts in tokens; frequent: the first tier; full: bytes that the second one may hold."""

    def __init__(self, path: str, frequent: dict[str, int], full: int):
        super().__init__(path, full)
        self.frequent, self.asked, self.encoded = frequent, 0, 0

    def lengths(self, texts: list[str]) -> dict[str, int]:
        return {x: len(y) // self.dtype.itemsize for x, y in self.encode(texts).items()}

    def looked_up(self, texts: list[str]) -> list[int]:
        frequent, known = self.frequent, self.known
        missing = [x for x in texts if x not in frequent and x not in known]
        found = self.lengths(missing)
        for x in missing:
            if self.held >= self.full:
                break
            known[x] = found[x]
            self.held += _ENTRY + 2 * len(x)
        self.asked, self.encoded = self.asked + len(texts), self.encoded + len(missing)
        return [frequent[x] if x in frequent else known[x] if x in known else found[x] for x in texts]

    def counts(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0, np.int64)
        code, first, lengths = self._cut(texts)
        return np.add.reduceat(np.array(lengths, np.int64)[code], first[:-1])


@lru_cache(maxsize=2)
def _worker_counter(path: str, full: int, table: str) -> PieceCounter:
    """One counter for all tasks of a broadcast table that a Python worker runs, so that its cache outlives a task."""
    return PieceCounter(path, {}, full)


def frequent_pieces(docs: DataFrame, *, sample_rows: int = 4000, per_task: int = 20_000, size: int = 50_000) -> list[str]:
    """At most size pre-tokens, the most frequent ones of about sample_rows documents; of a count that would pass size, none.

    Each task counts the per_task most frequent ones of its documents. The table decides about speed only.
    """
    rows = docs.count()
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_rows / max(rows, 1))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in text_slices(batches):
            for text in batch["text"].to_pylist():
                seen.update(pieces(text))
        top = seen.most_common(per_task)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    counted = checkpointed(part.select("doc_id", "text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")))
    least, held = None, 0
    for n, many in sorted(((r.n, r.many) for r in counted.groupBy("n").agg(F.count("*").alias("many")).collect()), reverse=True):  # a row a count of the sample
        held += many
        if held > size:
            break
        least = n
    return [] if least is None else [r.piece for r in counted.where(F.col("n") >= least).select("piece").collect()]


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 1024, cache_bytes: int = 48 << 20, **sample) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    n_tokens is what the tokenizer file gives for the whole text, without added special tokens; their
    strings inside a text count as the tokenizer takes them. A null text is empty and has no tokens.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    frequent = PieceCounter(tokenizer, {}, 0).lengths(frequent_pieces(docs, **sample))
    # compact: one run of text, and a byte or two a length
    packed = pa.array(list(frequent), pa.string()), np.array(list(frequent.values()), np.min_scalar_type(max(frequent.values(), default=0)))
    shared, name = docs.sparkSession.sparkContext.broadcast(packed), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_counter(tokenizer, cache_bytes, name)
        if not encoder.frequent:
            names, lengths = shared.value
            encoder.frequent = dict(zip(names.to_pylist(), lengths.tolist(), strict=True))
        for batch in text_slices(batches, most=4 << 20):
            sizes = np.asarray(pc.binary_length(batch["text"].cast(pa.large_binary())), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes), pa.array(encoder.counts(batch["text"]))], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
