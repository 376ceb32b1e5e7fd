"""Importance resampling towards a target distribution, by hashed word n-grams.

Long texts are cut into chunks at word boundaries. A chunk carries the n-1 words after it and owns the
features that start at its own words, so each feature of a text is counted once; chunks' counts add
up to those of the corpus and their weights are summed by document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.llm.common import checkpointed, text_slices
from spindle.llm.textkit import LETTERS

BUCKETS = 10_000
#: Bytes after which a text is cut; its chunks are dealt to all tasks.
CHUNK_BYTES = 1 << 16
_LONG_WORD = 64  #: bytes; longer words are hashed one by one

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = LETTERS[_LOWER]  #: before lower-casing


def _crc_table() -> np.ndarray:
    """Remainders of single bytes for the reflected polynomial of crc32."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (out >> np.uint32(1))
    return out


_TABLE = _crc_table()


def _fed(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 registers after data[start:end] of each, from the registers before it."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    held, first = state[order], start[order]
    reach = np.searchsorted(-size[order], -np.arange(min(int(size.max(initial=0)), _LONG_WORD)), "left")
    n_long = int(np.searchsorted(-size[order], -_LONG_WORD, "left"))  # the first ones are longer
    for j, n in enumerate(reach.tolist()):
        now = held[n_long:n]
        held[n_long:n] = _TABLE[(now ^ data[first[n_long:n] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    for i in range(n_long):
        at = int(order[i])
        held[i] = zlib.crc32(data[start[at] : end[at]], int(held[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(held)
    out[order] = held
    return out


class _Found:
    """Words of a large_string array without nulls, A-Z taken as a-z; first: per text its first word, and the total."""

    def __init__(self, texts: pa.Array):
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        low, high = int(off[0]), int(off[-1])
        self.data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[low:high]] if high > low else np.zeros(0, np.uint8)
        inside, off = LETTERS[self.data], off - low
        edge = np.zeros(len(inside) + 1, bool)  # where a text begins or ends, words do
        edge[off] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)

    def features(self, carry: np.ndarray, most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of 1 to most words: the texts that own them, and their buckets; the last carry words of a text own none."""
        count = np.diff(self.first)
        text = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(text))
        owned = at < (self.first[1:] - carry)[text]
        at, text = at[owned], text[owned]
        state = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for run in range(most):
            if run:
                inside = at + run < self.first[1:][text]
                at, text, state = at[inside], text[inside], state[inside]
                state = _TABLE[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
            state = _fed(state, self.data, self.start[at + run], self.end[at + run])
            yield text, (state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)


def _edge(data: np.ndarray, at: int, inside: bool) -> int:
    """The first place from at on whose byte is in a word (inside) or is not; the end if there is none."""
    while at < len(data):
        hit = np.flatnonzero(_WORD[data[at : at + 4096]] == inside)
        if len(hit):
            return at + int(hit[0])
        at += 4096
    return len(data)


def chunk_spans(data: np.ndarray, size: int, carried: int) -> Iterator[tuple[int, int, int]]:
    """Begin, end and number of carried words for the chunks of a text's bytes; a chunk's own words end at size bytes or after."""
    begin = 0
    while begin < len(data):
        cut = _edge(data, begin + size, False) if begin + size < len(data) else len(data)
        end, more = cut, 0
        while more < carried and (word := _edge(data, end, True)) < len(data):
            end, more = _edge(data, word, False), more + 1
        yield begin, end, more
        begin = cut


_STORED = "bucket int, n long, key long, chunk long, doc_id long, carry int, text string"


def _first_pass(most: int, buckets: int, chunk_bytes: int):
    """Counts of the texts up to chunk_bytes, summed by task; longer ones are passed on in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, counts = TaskContext.get().partitionId() << 33, np.zeros(buckets, np.int64)
        key = 0
        for batch in text_slices(batches):
            texts, ids = batch["text"], batch["doc_id"]
            size = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
            short = texts.filter(pa.array(size <= chunk_bytes))
            for _, bucket in _Found(short).features(np.zeros(len(short), np.int64), most, buckets):
                counts += np.bincount(bucket, minlength=buckets)
            for i in np.flatnonzero(size > chunk_bytes).tolist():
                data = np.frombuffer(texts[i].as_buffer(), np.uint8)
                for chunk, (a, b, carry) in enumerate(chunk_spans(data, chunk_bytes, most - 1)):
                    own = [pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([base + key]), pa.array([chunk]), ids.slice(i, 1).cast(pa.int64())]
                    own += [pa.array([carry], pa.int32()), pa.array([data[a:b].tobytes()], pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(own, ["bucket", "n", "key", "chunk", "doc_id", "carry", "text"])
                key += 1
        at = np.flatnonzero(counts)
        own = [pa.array(at.astype(np.int32)), pa.array(counts[at]), *(pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))]
        yield pa.RecordBatch.from_arrays(own, ["bucket", "n", "key", "chunk", "doc_id", "carry", "text"])

    return run


def _count_chunks(most: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in text_slices(batches):
            for _, bucket in _Found(batch["text"]).features(np.asarray(batch["carry"]), most, buckets):
                counts += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["bucket", "n"])

    return run


def _weigh(most: int, buckets: int, gains):
    """key, doc_id, n_words, n_features and gain (the sum of its features' gains) of each text or chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = gains.value
        for batch in text_slices(batches):
            carry, n = np.asarray(batch["carry"]).astype(np.int64), batch.num_rows
            found = _Found(batch["text"])
            features, gain = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for text, bucket in found.features(carry, most, buckets):
                features += np.bincount(text, minlength=n)
                sums = np.concatenate([[0], np.cumsum(worth[bucket])])
                place = np.searchsorted(text, np.arange(n + 1))
                gain += sums[place[1:]] - sums[place[:-1]]
            columns = [batch["key"], batch["doc_id"], *map(pa.array, (np.diff(found.first) - carry, features, gain))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "n_words", "n_features", "gain"])

    return run


def bucket_gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of how much likelier a bucket is in the target than in the raw texts), counts raised by one."""
    s_all, t_all = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((raw.get(b, 0) + 1) * t_all))) for b in range(buckets)], np.int64)


def _counted(docs: DataFrame, most: int, buckets: int, chunk_bytes: int) -> tuple[dict[int, int], DataFrame]:
    """Features by bucket, of which there are buckets at most, and the chunks of long texts, stored."""
    stored = checkpointed(docs.mapInArrow(_first_pass(most, buckets, chunk_bytes), _STORED))
    chunks = stored.where("text is not null").select("key", "chunk", "doc_id", "carry", "text").repartition("key", "chunk")
    own = stored.where("text is null").select("bucket", "n")
    total = own.unionByName(chunks.select("carry", "text").mapInArrow(_count_chunks(most, buckets), "bucket int, n long")).groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r.bucket: r.n for r in total.collect()}, chunks


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        place = np.arange(at, at + batch.num_rows)
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(place), part, np.int32)), pa.array(place)], [*batch.schema.names, "part", "place"])


def _drawn(scored: DataFrame, share: int, least_words: int) -> DataFrame:
    """scored with rank: 1, 2, 3 ... for the share (in hundredths) of highest scores among texts of least_words and more."""
    able = F.col("n_words") >= least_words
    # scores are logarithms in thousandths, so there are some 100,000 different ones at any size of the corpus
    steps = sorted(((r.score, r.n) for r in scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    take, cut, above = share * sum(n for _, n in steps) // 100, None, 0
    for score, n in steps:
        if above >= take:
            break
        cut, above = score, above + n
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    better = able & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "salt"]  # rows alike in all but salt may change places
    # no groups by score or doc_id: rows are dealt by ranges, and counted by task
    ranged = scored.where(better).withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    kept = checkpointed(ranged.mapInArrow(_numbered, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema) + ", part int, place long"))
    parts = kept.groupBy("part").agg(F.count("*").alias("n"))  # a row a task
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place") + 1
    ranked = kept.join(F.broadcast(before), "part").select(*scored.columns, F.when(rank <= take, rank).alias("rank"))
    return scored.where(~better).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def importance_resampled(docs: DataFrame, target: DataFrame, *, most: int = 2, buckets: int = BUCKETS, share: int = 25, least_words: int = 20, seed: str = "7", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_features, weight, score, rank.

    weight: the floored mean of the gains of the text's features (runs of 1 to most words, by bucket),
    0 without features. score: weight and a Gumbel draw of the seed and doc_id. rank: place among the
    drawn documents, null for others; ties go to the smaller doc_id, rows without doc_id after all of
    their score (their draw is that of the word null), repeated rows are drawn each. A null text has
    no words. target (text) may be empty: then gains favour what is rare in docs. Other columns are
    not looked at.
    """
    plain = lambda df, *first: df.select(*first, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = plain(docs, F.col("doc_id").cast("long").alias("doc_id"))
    wanted, _ = _counted(plain(target, F.lit(None).cast("long").alias("doc_id")), most, buckets, chunk_bytes)
    held, chunks = _counted(docs, most, buckets, chunk_bytes)
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(held, wanted, buckets))
    weigh, schema = _weigh(most, buckets, gains), "key long, doc_id long, n_words long, n_features long, gain long"
    short = docs.where(F.octet_length("text") <= chunk_bytes).select(F.lit(None).cast("long").alias("key"), "doc_id", F.lit(0).alias("carry"), "text").mapInArrow(weigh, schema)
    parts = chunks.select("key", "doc_id", "carry", "text").mapInArrow(weigh, schema)
    long = parts.groupBy("key").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")))
    weighed = short.unionByName(long).withColumn("weight", F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0)).cast("long"))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((draw + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weighed.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel).cast("long").alias("score"))
    return _drawn(checkpointed(scored), share, least_words)
