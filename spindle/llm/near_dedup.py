"""MinHash near-duplicates of whole documents, by tensored banding.

Two small collections of minhashes stand in for one large one: 10 codes of 3 minhashes and 7 codes
of 2. Each pair of a code of the first and one of the second is a table key, so 44 minhashes give 70
tables of 5 minhashes where plain banding would compute 350. Two sets at the threshold share no key
with a probability of about (1 - 0.8**3)**10 + (1 - 0.8**2)**7 = 0.0016; candidates are then
verified on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm import textkit
from spindle.llm.common import checkpointed, semi_join, text_slices
from spindle.llm.linking import link

_SKETCH = "doc_id long, n long, s1 long, s2 long, a array<long>, b array<long>"


def _codes(hashes: np.ndarray, width: int) -> np.ndarray:
    return np.stack([textkit.joined_rows(hashes[:, j : j + width]) for j in range(0, hashes.shape[1], width)], axis=1)


def _sketches(shingle: int, first: tuple[int, int], second: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            values, at = textkit.shingle_sets(textkit.words(batch["text"]), shingle)
            hashes = textkit.minhashes(values, at, first[0] * first[1] + second[0] * second[1])
            cut = first[0] * first[1]
            a, b = _codes(hashes[:, :cut], first[0]), _codes(hashes[:, cut:], second[0])
            s1 = textkit.sums_by_set(textkit.mix(values), at)
            s2 = textkit.sums_by_set(textkit.mix(values ^ np.uint64(0x5851F42D4C957F2D)), at)
            rows = len(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].cast(pa.int64()),
                    textkit.int64(np.diff(at)),
                    textkit.int64(s1),
                    textkit.int64(s2),
                    textkit.lists(a.ravel(), np.arange(rows + 1) * first[1]),
                    textkit.lists(b.ravel(), np.arange(rows + 1) * second[1]),
                ],
                ["doc_id", "n", "s1", "s2", "a", "b"],
            )

    return run


def _full_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            values, at = textkit.shingle_sets(textkit.words(batch["text"]), shingle)
            yield pa.RecordBatch.from_arrays([batch["node"].cast(pa.int64()), textkit.lists(values, at)], ["node", "items"])

    return run


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, first: tuple[int, int] = (3, 10), second: tuple[int, int] = (2, 7)) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their sets of shingles (words
    without white space, A-Z lower-cased). component_id is the smallest doc_id reachable by links;
    kept marks the document that has it. first and second: minhashes per code, and codes.

    A null or blank text has an empty set and is linked with nothing. Texts with fewer words than a
    shingle are one shingle. Rows that share a doc_id are one document: a link of one is a link of
    all. A row without doc_id belongs to the rows of an equal set: it has their component's smallest
    known id, and if none of them has an id, null, no near copies, and is kept, like all rows of that set.
    Give rows without ids numbers, as the pipeline does, to have them compared.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = checkpointed(docs.mapInArrow(_sketches(shingle, first, second), _SKETCH))
    # rows of one set are one node: exact copies cost one row from here on
    classes = base.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.count("*").alias("copies"), F.first("a").alias("a"), F.first("b").alias("b"))
    keys = "flatten(transform(a, (x, i) -> transform(b, (y, j) -> xxhash64(i, j, x, y))))"
    items = classes.where("node is not null").select("node", "n", "copies", F.expr(keys).alias("keys"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = semi_join(docs.withColumnRenamed("doc_id", "node"), nodes, "node")
        return wanted.mapInArrow(_full_sets(shingle), "node long, items array<long>")

    labels = link(items, sets_of, percent)
    named = classes.select("s1", "s2", "node").join(labels, "node", "left").select("s1", "s2", F.coalesce("comp", "node").alias("component"))
    out = base.select("doc_id", "n", F.when(F.col("n") > 0, F.col("s1")).alias("s1"), "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
