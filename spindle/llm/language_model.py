"""Scoring texts with a language model whose n-gram counts lie in a log-frequency Bloom filter.

A count is quantised to a level, and the n-gram is put in once for each level up to it; a query
probes level after level until one is missing. No more than half of the filter's bits are set, and the
first level takes as many probes as the vocabulary calls for: all words that never followed a word, but
are found after it, add FALSE_COUNTS to the counts of its followers on average. The filter
is cut into segments by the n-gram's hash, each with bits for what it holds. Texts are dealt to slices. A slice sends
its distinct n-grams, with how often it trains on them, to their segments once; a segment adds them up, puts them
in and answers each slice by levels alone, in the order of its n-grams. So n-grams travel once for counting and for
probing, and nothing of them or of the texts is stored. Unigrams are smoothed by adding one; bigrams, all of them,
are smoothed towards them with a prior of PRIOR counts: p(w | h) = (c(h w) + PRIOR p(w)) / (c(h) +
PRIOR), which sums to one as the counts of a word's followers sum to its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm import textkit
from spindle.llm.common import checkpointed, text_slices

END = np.uint64(0x0E0D0E0D0E0D0E0D)
#: Counts below FIRST have levels of their own; from there on a level is BASE times as wide as the one before.
FIRST, BASE = 6, 1.2
#: Probes of each level but the first: one n-gram in 128 that is in gets a level too many there.
PROBES = 7
PRIOR = 20.0
#: What levels that aren't there add, on average, to the counts of one word's followers: 1/200 of the prior.
FALSE_COUNTS = PRIOR / 200
_PAIR = np.uint64(0xA0761D6478BD642F)
_LEVELS = 160
#: Bytes of text of a slice, and those whose n-grams fill a segment, as powers of two.
_SLICE, _SEGMENT = 23, 24
#: Slices at least, so that small tables are dealt to several tasks too.
_LEAST = 8


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a row without doc_id is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def level_of(counts: np.ndarray) -> np.ndarray:
    counts = np.maximum(counts, 1)
    return np.where(counts < FIRST, counts, np.minimum(FIRST + np.floor(np.log(counts / FIRST) / np.log(BASE) + 1e-9), _LEVELS - 1)).astype(np.int64)


def _level_counts() -> np.ndarray:
    """The count that each level stands for: the mean of the whole numbers in it, each weighed by the inverse of its square."""
    out = [float(i) for i in range(FIRST)]
    for level in range(_LEVELS - FIRST):
        low, high = FIRST * BASE**level, FIRST * BASE ** (level + 1)
        inside = np.arange(np.ceil(low - 1e-9), np.ceil(high - 1e-9)) if high < 1e6 else np.zeros(0)
        out.append(float((1 / inside).sum() / (1 / inside**2).sum()) if len(inside) else np.log(BASE) / (1 / low - 1 / high))
    return np.array(out)


LEVEL_COUNTS = _level_counts()


def first_probes(kinds: int) -> int:
    """Probes of the first level where there are so many kinds of words; each halves what is found wrongly."""
    return max(PROBES, math.ceil(math.log2(max(kinds, 1) / FALSE_COUNTS)))


def bits_needed(entries: int, levels: int, first: int) -> int:
    """Bits of which half are set by so many entries with so many levels in all."""
    return math.ceil((first * entries + PROBES * (levels - entries)) / math.log(2))


class LogFrequencyFilter:
    def __init__(self, size: int, log_segments: int, first: int = PROBES, single: bool = False):
        """size: bits of a segment, a multiple of 8; first: probes of the first level; single: one segment alone, for codes of that segment."""
        self.log_segments, self.size, self.first, self.single = log_segments, np.uint64(size), first, single
        self.bits = np.zeros((1 if single else 1 << log_segments, size >> 3), np.uint8)

    def segment(self, codes: np.ndarray) -> np.ndarray:
        return (codes >> np.uint64(64 - self.log_segments)).astype(np.int64)

    def _bases(self, codes: np.ndarray) -> np.ndarray:
        """The first byte of each code's segment."""
        return np.zeros(len(codes), np.int64) if self.single else self.segment(codes) * self.bits.shape[1]

    def _probes(self, level: int) -> int:
        return self.first if level == 1 else PROBES

    @staticmethod
    def _start(codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where probing of a level begins, and the first step; each step is longer than the one before by its number."""
        a = textkit.mix(codes + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return a >> np.uint64(32), (a | np.uint64(1)) & np.uint64(0xFFFFFFFF)

    def put(self, codes: np.ndarray, levels: np.ndarray) -> None:
        flat = self.bits.reshape(-1)
        for level in range(1, int(levels.max(initial=0)) + 1):
            on = levels >= level
            codes, levels = codes[on], levels[on]
            bases, (place, step) = self._bases(codes), self._start(codes, level)
            for k in range(self._probes(level)):
                at = (place % self.size).astype(np.int64)
                np.bitwise_or.at(flat, bases + (at >> 3), (1 << (at & 7)).astype(np.uint8))
                place, step = place + step, step + np.uint64(k)

    def levels(self, codes: np.ndarray) -> np.ndarray:
        """The highest level up to which each n-gram is in, by one membership test a level."""
        flat, out, on = self.bits.reshape(-1), np.zeros(len(codes), np.int64), np.arange(len(codes))
        for level in range(1, _LEVELS):
            bases, (place, step) = self._bases(codes[on]), self._start(codes[on], level)
            for k in range(self._probes(level)):
                at = (place % self.size).astype(np.int64)
                here = (flat[bases + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0
                if not here.all():
                    on, bases, place, step = on[here], bases[here], place[here], step[here]
                place, step = place + step, step + np.uint64(k)
            if not len(on):
                break
            out[on] = level
        return out


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with an end after each text's, and the offsets of texts."""
    found = textkit.words(text)
    first = found.first + np.arange(len(found.first))
    out = np.full(first[-1], END, dtype=np.uint64)
    keep = np.ones(len(out), dtype=bool)
    keep[first[1:] - 1] = False
    out[keep] = found.hash
    return out, first


def _counted(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(codes, counts) merged by code, a few million codes at a time."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> pa.RecordBatch:
        codes, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        code, back = np.unique(codes, return_inverse=True)
        return pa.RecordBatch.from_arrays([textkit.int64(code), pa.array(np.bincount(back, counts).astype(np.int64))], ["code", "c"])

    for part in parts:
        found.append(part)
        if sum(len(x) for x, _ in found) > 2_000_000:
            yield merged()
    if found:
        yield merged()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _counted(np.unique(_tokens(b["text"])[0], return_counts=True) for b in text_slices(batches))


def _followers(first: np.ndarray) -> np.ndarray:
    """The places of tokens that follow another one of their text."""
    follows = np.ones(first[-1], dtype=bool)
    follows[first[:-1]] = False
    return np.flatnonzero(follows)


def _distinct(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes, sorted and without repeats, each one's place there, and the sums of times."""
    order = np.argsort(codes)
    held = codes[order]
    new = np.ones(len(codes), dtype=bool)
    new[1:] = held[1:] != held[:-1]
    start = np.flatnonzero(new)
    back = np.empty(len(codes), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return held[start], back, np.add.reduceat(times[order], start) if len(start) else np.zeros(0, np.int64)


def _slice_tokens(own: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """_tokens of all texts of a table."""
    parts = [_tokens(b["text"]) for b in text_slices(iter(own.to_batches()))]
    sizes = np.concatenate([np.diff(first) for _, first in parts])
    return np.concatenate([tokens for tokens, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def _packed(parts: list[np.ndarray], codes: bool = False) -> pa.Array:
    """Each array's first bytes, then its second ones and so on, as most bytes of counts and of sorted codes' differences compress away."""
    parts = [np.diff(x, prepend=x.dtype.type(0)) if codes else np.ascontiguousarray(x) for x in parts]
    return pa.array([x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"" for x in parts], pa.binary())


def _unpacked(column: pa.ChunkedArray, kind: type, codes: bool = False) -> list[np.ndarray]:
    size = np.dtype(kind).itemsize
    rows = [np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(size, -1).T).reshape(-1).view(kind) for x in column]
    return [np.cumsum(x, dtype=kind) for x in rows] if codes else rows


def _index(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Each code's place in sorted_codes, or -1."""
    if not len(sorted_codes):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return np.where(sorted_codes[at] == codes, at, -1)


def _pair_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return textkit.mix(a * _PAIR + b)


def _frequent(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes, sorted, and counts of the most frequent words, most of them or fewer.

    A histogram over the counts' levels says from which level on there are no more than most.
    """
    level = F.floor(F.log(F.col("c").cast("double")) / np.log(1.05) + 1e-9)
    sizes = sorted(((r.level, r.n) for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for at, n in sizes:
        held += n
        if held > most:
            break
        least = at
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = words.where(level >= least).toPandas()
    codes = top["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    return codes[order], top["c"].to_numpy(np.int64)[order]


def language_model_scores(docs: DataFrame, *, frequent: int = 1 << 18, least_bits: int = 1 << 27, held_bits: int = 1 << 30, log_segments: int = 4) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both scores are log10 probabilities of all words of the text and its end. base_score takes exact
    counts of words in the training rows; counts of frequent words, so many at most, are broadcast,
    those of all others come with their segment's answers. score takes the counts of pairs from the
    filter, and those of words that aren't broadcast too. The filter has least_bits, or more if the
    counts need it; held_bits is of no effect, as the filter is never broadcast. Null texts are empty and hold one
    end each. Without training rows every word is unseen. Slices are told by a hash of doc_id and text: equal rows
    with equal doc_ids share one.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    words = checkpointed(docs.where("not held_out").select("text").mapInArrow(_count_words, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")))
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, n_kinds = int(totals.n), int(totals.v)
    size = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    log_segments, slices = max(log_segments, (size >> _SEGMENT).bit_length()), _LEAST + (size >> _SLICE)
    shared = spark.sparkContext.broadcast(_frequent(words, frequent))
    probes, floor = first_probes(n_kinds), np.log10(n_train + n_kinds + 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    top = np.uint64(64 - log_segments)

    def ask(own: pa.Table) -> pa.Table:
        """A row for each segment: the rare words and the pairs of a slice that belong there, and how often the slice trains on each pair."""
        tokens, first = _slice_tokens(own)
        word = np.unique(tokens)
        word = word[_index(shared.value[0], word) < 0]
        here = _followers(first)
        trained = np.repeat(~np.asarray(own["held_out"]), np.diff(first))[here]
        pair, _, times = _distinct(_pair_codes(tokens[here - 1], tokens[here]), trained.astype(np.uint32))
        segments = np.arange(1 << log_segments)
        inner = segments[1:].astype(np.uint64) << top
        cut = lambda x, by: np.split(x, np.searchsorted(by, inner))
        rows = [np.full(len(segments), own["slice"][0].as_py()), segments]
        return pa.Table.from_arrays([*map(pa.array, rows), _packed(cut(word, word), codes=True), _packed(cut(pair, pair), codes=True), _packed(cut(times.astype(np.uint32), pair))], ["slice", "segment", "words", "pairs", "times"])

    def answer(own: pa.Table, asked: pa.Table) -> pa.Table:
        """Exact counts of the words and levels of words and pairs, to each slice in the order of its codes."""
        word, count = own["code"].to_numpy().astype(np.int64).view(np.uint64), own["c"].to_numpy()
        order = np.argsort(word)
        word, count = word[order], count[order]
        held = [_unpacked(asked[name], np.uint64, codes=True) for name in ("words", "pairs")]
        cuts = [np.cumsum([len(x) for x in rows])[:-1] for rows in held]
        rare, rare_back, _ = _distinct(np.concatenate([np.zeros(0, np.uint64), *held[0]]), np.zeros(sum(map(len, held[0])), np.int64))
        times = np.concatenate([np.zeros(0, np.int64), *_unpacked(asked["times"], np.uint32)])
        pair, pair_back, times = _distinct(np.concatenate([np.zeros(0, np.uint64), *held[1]]), times)
        entries, levels = np.concatenate([word, pair[times > 0]]), level_of(np.concatenate([count, times[times > 0]]))
        bits = max(least_bits >> log_segments, bits_needed(len(entries), int(levels.sum()), probes))
        table = LogFrequencyFilter(8 * (1 + bits // 8), log_segments, probes, single=True)
        table.put(entries, levels)
        at = _index(word, rare)
        exact = np.zeros(len(rare), np.int64)
        exact[at >= 0] = count[at[at >= 0]]
        found = [exact[rare_back], table.levels(rare).astype(np.uint8)[rare_back], table.levels(pair).astype(np.uint8)[pair_back]]
        rows = [_packed(np.split(x, cuts[i])) if asked.num_rows else pa.array([], pa.binary()) for x, i in zip(found, (0, 0, 1), strict=True)]
        return pa.Table.from_arrays([asked["slice"], asked["segment"], *rows], ["slice", "segment", "counts", "words", "pairs"])

    def score(own: pa.Table, replies: pa.Table) -> pa.Table:
        codes, counts = shared.value
        tokens, first = _slice_tokens(own)
        # codes are sorted, and segments are their first bits: answers by segment are in the order of codes
        order = pa.array(np.argsort(replies["segment"].to_numpy()))
        rare_counts, rare_levels, met = (np.concatenate(_unpacked(replies[name].take(order), t)) for name, t in (("counts", np.int64), ("words", np.uint8), ("pairs", np.uint8)))
        code, back, _ = _distinct(tokens, np.zeros(len(tokens), np.int64))
        at = _index(codes, code)
        exact, seen = np.zeros(len(code)), np.zeros(len(code))
        exact[at >= 0] = seen[at >= 0] = counts[at[at >= 0]]
        exact[at < 0], seen[at < 0] = rare_counts, LEVEL_COUNTS[rare_levels]
        p = ((seen + 1) / (n_train + n_kinds + 1))[back]
        here = _followers(first)
        pair, pair_back, _ = _distinct(_pair_codes(tokens[here - 1], tokens[here]), np.zeros(len(here), np.int64))
        if len(pair) != len(met):
            raise ValueError("texts changed while they were scored")
        head = seen[back[here - 1]]
        p[here] = (np.minimum(LEVEL_COUNTS[met][pair_back], head) + PRIOR * p[here]) / (head + PRIOR)
        sizes, total = np.diff(first), lambda values: np.add.reduceat(values, first[:-1])
        base = total(np.log10(exact + 1)[back]) - sizes * floor
        known = total((exact > 0).astype(np.int64)[back])
        columns = {"n_tokens": sizes, "n_known": known, "train_tokens": np.full(len(sizes), n_train), "base_score": base, "score": total(np.log10(p))}
        return pa.Table.from_arrays([own["doc_id"], own["held_out"], *map(pa.array, columns.values())], ["doc_id", "held_out", *columns])

    # both passes over the texts read this one shuffle
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)).alias("slice"), "doc_id", "held_out", "text").repartition(slices, "slice")
    asked = dealt.groupBy("slice").applyInArrow(ask, "slice long, segment long, words binary, pairs binary, times binary")
    kept = words.withColumn("segment", F.shiftrightunsigned("code", 64 - log_segments))
    kept, asked = (x.repartition(1 << log_segments, "segment").groupBy("segment") for x in (kept, asked))
    replies = kept.cogroup(asked).applyInArrow(answer, "slice long, segment long, counts binary, words binary, pairs binary")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("slice").cogroup(replies.repartition(slices, "slice").groupBy("slice")).applyInArrow(score, schema)
