"""Repeated passages: near-duplicate paragraphs of all documents, by minhash banding.

Two kinds of paragraphs are compared. A line of at least min_words words is one. So that a passage
inside longer lines or across line ends is found as well, content-defined blocks are others: 24 words
from each anchor on, and anchors are local minima of the words' hashes, about one in 13 words, so a
passage of 50 words that repeats has a block that repeats. Lines are linked by similarity: eleven
bands of three minhashes over shingles of five words let two lines at the threshold meet with a
probability of 1 - (1 - 0.8**3)**11 = 0.9996. Blocks are linked where they are equal, so that one
band, of eight minhashes, lets all of them meet. Band keys are counted first, and only paragraphs with
a key that occurs twice go on. Lines are verified by exact Jaccard, blocks by all of their words, and
removals are decided for each component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm import textkit
from spindle.llm.common import checkpointed, hash_filter, semi_join, text_slices
from spindle.llm.linking import link

_WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the broadcast filters at most, as a power of two; fewer bits than hashes let more through, nothing less.
_MOST_BITS = 29
_GRAM, _HELD = 3, 1 << 20


@dataclass(frozen=True)
class Cut:
    """How texts are cut into paragraphs, and how many bands each kind has."""

    shingle: int = 5
    min_words: int = 20
    block_words: int = 24
    reach: int = 6
    width: int = 3
    bands: int = 11
    block_width: int = 8


class _Paragraphs:
    """All paragraphs of a slice of texts: lines, then blocks. start, end: words; a, b: shingles; text: row."""

    def __init__(self, texts: pa.Array, cut: Cut):
        self.cut, found = cut, textkit.words(texts)
        start, end = textkit.lines(found)
        long = end - start >= max(cut.min_words, cut.shingle)
        start, end = start[long], end[long]
        self.lines = len(start)
        at = textkit.anchors(found, _GRAM, cut.reach)
        last = found.first[np.searchsorted(found.first, at, "right")]
        at = at[at + cut.block_words <= last]
        self.start, self.end = np.concatenate([start, at]), np.concatenate([end, at + cut.block_words])
        self.text = np.searchsorted(found.first, self.start, "right") - 1
        self.codes, first = found.windows(cut.shingle)
        self.a = self.start - found.first[self.text] + first[self.text]
        self.b = self.a + (self.end - self.start) - cut.shingle + 1
        kind = np.where(np.arange(len(self.start)) < self.lines, 0, 0x5851F42D4C957F2D).astype(np.uint64)
        self.node = textkit.mix(textkit.run_codes(found, self.start, self.end) + kind)
        self.place = self.start - found.first[self.text]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Band keys, one row a line and one row a block."""
        cut = self.cut
        out = []
        for kind, width, bands, on in ((0, cut.width, cut.bands, slice(0, self.lines)), (1, cut.block_width, 1, slice(self.lines, None))):
            hashes = textkit.run_minhashes(self.codes, self.a[on], self.b[on], width * bands)
            parts = [textkit.mix(textkit.joined_rows(hashes[:, j * width : (j + 1) * width]) + np.uint64(2 * j + kind)) for j in range(bands)]
            out.append(np.stack(parts, axis=1))
        return out[0], out[1]

    def sets(self, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of the paragraphs on, and their offsets."""
        sizes = (self.b - self.a)[on]
        first = np.concatenate([[0], np.cumsum(sizes)])
        return textkit.distinct_sets(self.codes[np.arange(first[-1]) + np.repeat(self.a[on] - first[:-1], sizes)], first)


def _repeated_keys(docs: DataFrame, cut: Cut) -> DataFrame:
    """(key) for the band keys of two paragraphs or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def merged() -> pa.RecordBatch:  # whether a key occurs once or more is all that matters
            key, n = np.unique(np.concatenate(found), return_counts=True)
            found.clear()
            return pa.RecordBatch.from_arrays([textkit.int64(np.repeat(key, np.minimum(n, 2)))], ["key"])

        for batch in text_slices(batches):
            found += [x.ravel() for x in _Paragraphs(batch["text"], cut).keys()]
            if sum(map(len, found)) > _HELD:
                yield merged()
        if found:
            yield merged()

    # a key comes from a task a few times at most, so no partition of this shuffle is hot
    return docs.select("text").mapInArrow(run, "key long").repartition("key").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")


def _filter(hashes: DataFrame, column: str):
    bits = (16 * hashes.count()).bit_length()
    return hashes.sparkSession.sparkContext.broadcast(hash_filter(hashes, column, min(max(bits, 16), _MOST_BITS)))


def repeated_paragraphs(docs: DataFrame, *, percent: int = 80, row: str | None = None, **cut) -> DataFrame:
    """A row for each paragraph that has copies or near copies: doc_id, start, n_words, block, component_id, copies, kept.

    docs: (doc_id, text). The paragraph is the n_words words of the text from word start on; block tells
    blocks from lines. Lines are linked when 100 * intersection >= percent * union of their sets of
    shingles, blocks when they are equal. In each component the first paragraph, by doc_id (none comes last) and
    start, is kept; component_id is its doc_id and copies the number of paragraphs. Blocks of one text
    that overlap are no copies of each other. Null, blank and short texts have no paragraphs. Rows that
    share a doc_id or have none are judged each, and a repetition inside one document counts like one
    between two. row: a column with a number of its own for each row, which the result then has too.
    cut: fields of Cut.
    """
    cut = Cut(**cut)
    own = F.lit(None).cast("long") if row is None else F.col(row).cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("row"), F.xxhash64(text).alias("th"), text.alias("text"))
    keys = _filter(checkpointed(_repeated_keys(docs, cut)), "key")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 33
        for batch in text_slices(batches):
            found = _Paragraphs(batch["text"], cut)
            held, each = [], []
            for own in found.keys():
                hit = keys.value.holds(own.ravel()).reshape(own.shape)
                held.append(own[hit])
                each.append(hit.sum(axis=1))
            sizes = np.concatenate(each)
            on = np.flatnonzero(sizes)
            n = np.zeros(len(on), np.int64)
            n[on < found.lines] = np.diff(found.sets(on[on < found.lines])[1])
            line, rows = on < found.lines, pa.array(found.text[on])
            at = np.concatenate([[0], np.cumsum(np.where(line, sizes[on], 0))])
            row = batch["row"].take(rows) if batch["row"].null_count == 0 else pa.array(key + found.text[on])
            columns = [row, batch["doc_id"].take(rows), batch["th"].take(rows), textkit.int64(found.place[on]), textkit.int64((found.end - found.start)[on]), pa.array(~line), textkit.int64(found.node[on]), textkit.int64(n), textkit.lists(held[0], at)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "th", "start", "n_words", "block", "node", "n", "keys"])
            key += len(batch)

    schema = "row long, doc_id long, th long, start long, n_words long, block boolean, node long, n long, keys array<long>"
    base = checkpointed(docs.mapInArrow(candidates, schema))
    # equal word sequences are one node; the aggregates never gather a group
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "start")
    summary = [F.min("first").alias("first"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("copies").alias("copies")]
    one = base.select("node", "n", "keys", "th", order.alias("first"), F.struct("row", (F.col("start") + F.col("n_words")).alias("to")).alias("low"), F.struct("row", "start").alias("high"), F.lit(1).cast("long").alias("copies"))
    home = F.min(F.struct("th", F.col("first.doc_id").alias("doc_id"))).alias("home")
    classes = checkpointed(one.groupBy("node").agg(*summary, home, F.first("n").alias("n"), F.first("keys").alias("keys")))

    def sets_of(nodes: DataFrame) -> DataFrame:
        """From one text for each node; only repeated rows may give a set twice."""
        wanted = _filter(nodes, "node")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches):
                found = _Paragraphs(batch["text"], cut)
                _, at = np.unique((found.node ^ textkit.mix(found.text.astype(np.uint64)))[: found.lines], return_index=True)
                on = at[wanted.value.holds(found.node[at])]
                yield pa.RecordBatch.from_arrays([batch["th"].take(pa.array(found.text[on])), textkit.int64(found.node[on]), textkit.lists(*found.sets(on))], ["th", "node", "items"])

        homes = checkpointed(classes.join(nodes, "node", "left_semi").select("node", "home.th", F.coalesce("home.doc_id", F.lit(-1)).alias("at")))
        texts = docs.select("th", F.coalesce("doc_id", F.lit(-1)).alias("at"), "text")
        found = semi_join(texts, homes.select("th", "at").distinct(), ["th", "at"]).mapInArrow(run, "th long, node long, items array<long>")
        return semi_join(found, homes.select("th", "node"), ["th", "node"]).select("node", "items")

    labels = link(classes.where("n > 0").select("node", "n", "copies", "keys"), sets_of, percent)
    named = classes.select("node", "first", "low", "high", "copies").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    apart = (F.col("low.row") != F.col("high.row")) | (F.col("low.to") <= F.col("high.start"))
    groups = named.groupBy("comp").agg(*summary).where("copies > 1").where(apart)
    named = checkpointed(named.select("node", "comp").join(groups.select("comp", "copies", "first"), "comp").select("node", "copies", "first"))
    out = base.select("row", "doc_id", "start", "n_words", "block", "node").join(named, "node")
    kept = (F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.start"))
    return out.select(*([] if row is None else [F.col("row").alias(row)]), "doc_id", "start", "n_words", "block", F.col("first.doc_id").alias("component_id"), "copies", kept.alias("kept"))


def _without(text: Column, spans: Column) -> Column:
    """text without the words inside spans, and without the white space that follows them."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{_WORD}[\x20\x09-\x0D]*"), F.lit(0))
    left = F.filter(pieces, lambda _, i: ~F.exists(spans, lambda s: (s["start"] <= i) & (i < s["stop"])))
    return F.array_join(left, "")


def remove_repeated(docs: DataFrame, **options) -> DataFrame:
    """docs with the paragraphs that repeated_paragraphs doesn't keep cut from their texts, row by row."""
    keyed = checkpointed(docs.select(F.struct(*docs.columns).alias("own")).withColumn("row", F.monotonically_increasing_id()))
    found = repeated_paragraphs(keyed.select("row", "own.doc_id", "own.text"), row="row", **options)
    gone = found.where("not kept").groupBy("row").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n_words")).alias("stop"))).alias("gone"))
    joined = keyed.join(gone, "row", "left")
    text = F.when(F.col("gone").isNull(), F.col("own.text")).otherwise(_without(F.col("own.text"), F.col("gone")))
    return joined.withColumn("own", F.col("own").withField("text", text)).select("own.*")
