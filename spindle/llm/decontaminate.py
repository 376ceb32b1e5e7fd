"""Benchmark passages in documents, by a prefix-filtered set join.

An item's windows are sets of shingles of two words. A document that contains a window contains all
its shingles, so the shortest necessary prefix, in the order of rarity over all documents, is the
rarest shingle alone. Documents offer their words around each shingle that is such a prefix; the
join compares offers and windows by that shingle, the shingle's place in the window bounds where the
window must lie, and the words themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm import textkit
from spindle.llm.common import checkpointed, hash_filter, text_slices

_ONE = np.uint64(0x2545F4914F6CDD1D)  # tells one-word shingles from longer ones


def _shingles(found: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
    return found.windows(2)


def _word_strings(found: textkit.Words, low: int, high: int) -> list[str]:
    raw = found.data.tobytes() if high - low > 5000 else None
    cut = (lambda a, b: raw[a:b]) if raw is not None else (lambda a, b: found.data[a:b].tobytes())
    return [cut(a, b).decode("utf-8", "replace") for a, b in zip(found.start[low:high].tolist(), found.end[low:high].tolist(), strict=True)]


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = textkit.words(batch["text"], textkit.LETTERS)
            pairs, first = _shingles(found)
            rows = []
            for i, item in enumerate(batch["item_id"].to_pylist()):
                low, n = int(found.first[i]), int(found.first[i + 1] - found.first[i])
                own = _word_strings(found, low, low + n)
                for at in range(max(n - size, 0) + 1 if n else 0):
                    width = min(size, n)
                    codes = pairs[first[i] + at : first[i] + at + width - 1] if width > 1 else found.hash[low : low + 1] ^ _ONE
                    rows.append((item, own[at : at + width], codes.view(np.int64).tolist()))
            items, texts, codes = zip(*rows, strict=True) if rows else ((), (), ())
            kind = batch.schema.field("item_id").type
            yield pa.RecordBatch.from_arrays([pa.array(items, kind), pa.array(texts, pa.list_(pa.string())), pa.array(codes, pa.list_(pa.int64()))], ["item_id", "words", "codes"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, size: int = 10, log_bits: int = 23) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is size words in a row of an item of benchmark (item_id, text); an item with fewer words
    is one window. A word of a document that lies inside an occurrence of a window is hit. Null texts
    and items without words have no windows and no hits. Items without item_id mark words as hit but
    are in no list. Repeated rows get equal results. log_bits sets the size of the broadcast filters,
    which let too much through in a larger benchmark but never too little.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"))
    items = benchmark.select("item_id", text.alias("text"))
    id_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    windows = checkpointed(items.mapInArrow(_windows(size), f"item_id {item_kind}, words array<string>, codes array<long>"))
    each = windows.select(F.explode("codes").alias("code")).distinct()
    context = docs.sparkSession.sparkContext
    known = context.broadcast(hash_filter(each, "code", log_bits))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = textkit.words(batch["text"], textkit.LETTERS)
            codes = np.concatenate([_shingles(found)[0], found.hash ^ _ONE])
            code, n = np.unique(codes[known.value.holds(codes)], return_counts=True)
            yield pa.RecordBatch.from_arrays([textkit.int64(code), pa.array(n.astype(np.int64))], ["code", "n"])

    counts = docs.select("text").mapInArrow(frequencies, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = each.join(counts, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))
    placed = windows.select("item_id", "words", F.posexplode("codes").alias("offset", "code")).join(counts, "code")
    rarest = placed.groupBy("item_id", "words").agg(F.min(F.struct("n", "code", "offset")).alias("p"))
    index = checkpointed(rarest.select("item_id", "words", F.col("p.code").alias("code"), F.col("p.offset").alias("offset")))
    prefix = context.broadcast(hash_filter(index.select("code").distinct(), "code", log_bits))

    def offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = textkit.words(batch["text"], textkit.LETTERS)
            pairs, first = _shingles(found)
            hit = np.flatnonzero(prefix.value.holds(pairs))
            doc = np.searchsorted(first, hit, "right") - 1
            at = hit - first[doc] + found.first[doc]
            single = found.hash ^ _ONE
            alone = np.flatnonzero(prefix.value.holds(single))
            rows: list[list] = [[] for _ in range(len(batch))]
            owners = np.concatenate([doc, np.searchsorted(found.first, alone, "right") - 1]).tolist()
            codes = np.concatenate([pairs[hit], single[alone]]).view(np.int64).tolist()
            for i, place, code in zip(owners, np.concatenate([at, alone]).tolist(), codes, strict=True):
                a, b = int(found.first[i]), int(found.first[i + 1])
                low, high = max(a, place - size + 1), min(b, place + size)
                rows[i].append({"code": code, "pos": place - a, "low": low - a, "near": _word_strings(found, low, high)})
            kind = pa.list_(pa.struct([("code", pa.int64()), ("pos", pa.int64()), ("low", pa.int64()), ("near", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], textkit.int64(np.diff(found.first)), pa.array(rows, kind)], ["doc_id", "th", "n_words", "offers"])

    offered = "array<struct<code:bigint,pos:bigint,low:bigint,near:array<string>>>"
    base = checkpointed(docs.mapInArrow(offers, f"doc_id {id_kind}, th long, n_words long, offers {offered}"))
    spread = base.select("doc_id", "th", "n_words", F.explode("offers").alias("o")).select("doc_id", "th", "n_words", "o.*")
    met = spread.join(index, "code").withColumns({"start": F.col("pos") - F.col("offset"), "width": F.size("words").cast("long")})
    met = met.where("start >= low and start + width <= n_words and start + width - low <= size(near)")
    met = met.where(F.slice("near", (F.col("start") - F.col("low") + 1).cast("int"), F.col("width").cast("int")) == F.col("words"))
    hits = met.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("width")).alias("stop")))).alias("spans"), F.collect_set("item_id").alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))

    def step(a, s):
        stop = F.greatest(a["to"], s["stop"])
        return F.struct(stop.alias("to"), (a["n"] + stop - F.greatest(F.least(a["to"], stop), s["start"])).alias("n"))

    covered = F.aggregate("spans", zero, step, lambda a: a["n"])
    hits = hits.select(F.col("doc_id").alias("h_id"), F.col("th").alias("h_th"), covered.alias("n_hit"), "items")
    joined = base.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")), "left")
    names = F.array_sort(F.transform(F.coalesce("items", F.array().cast(f"array<{item_kind}>")), lambda x: x.cast("string")))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
