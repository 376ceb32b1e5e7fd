"""op11 to op13 against plain Python, over whole tables and small cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindle.llm import fill_in_middle, importance, packing
from spindle.llm.encoding import PieceEncoder
from spindle.llm.queries import QUERIES

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

CASES = [
    (1, "The same words here and there " * 6), (2, "The same words here and there " * 6), (2, "The same words here and there " * 6), (3, None), (4, ""), (5, "   \n\t "),
    (6, "one"), (None, "no id at all, twenty words " * 9), (None, "no id at all, twenty words " * 9), (7, "é ünï   x\x85y <|endoftext|> z 𝒳𝒴 　q"), (8, "w " * 9000 + "end"),
    (9, "x" * 5000 + " " + "Y" * 70 + "-" + "Y" * 70), (10, "has <P> inside"), (11, "a\x00b\x00" * 30), (12, "tail of blanks" + " \t" * 50),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(CASES, "doc_id long, text string")
    for name in ("key", "chunk", "carry", "n", "form", "units", "parts", "output", "start", "length", "ids", "bucket", "score", "rank", "part", "place", "sequence_id", "offset"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def grams(text):
    w = ALNUM.findall((text or "").translate(LOWER))
    return [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))], len(w)


def brute_resampling(rows, goal):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    own = [(d, *grams(t)) for d, t in rows]
    s, t = Counter(bucket(f) for _, fs, _ in own for f in fs), Counter(bucket(f) for x in goal for f in grams(x)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for d, fs, n in own:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    return out, able[: 25 * len(able) // 100]


@pytest.mark.parametrize("chunk_bytes", [64, 1 << 16])
def test_resampling_equals_brute_force(spark, sf, chunk_bytes):
    docs, goal = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want, drawn = brute_resampling([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in goal.collect()])
    got = importance.importance_resampled(docs, goal, chunk_bytes=chunk_bytes).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert [r.doc_id for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == [x[0] for x in drawn]
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(drawn) + 1))


@pytest.mark.parametrize("chunk_bytes", [1, 50, 1 << 16])
def test_resampling_odd_rows(spark, odd, chunk_bytes):
    want, drawn = brute_resampling(CASES, ["the same words", None, ""])
    goal = spark.createDataFrame([("the same words",), (None,), ("",)], "text string")
    got = [tuple(r) for r in importance.importance_resampled(odd, goal, chunk_bytes=chunk_bytes).collect()]
    assert sorted((x[:5] for x in got), key=str) == sorted(want, key=str)
    assert [x[:5] for x in sorted((x for x in got if x[5]), key=lambda x: x[5])] == drawn
    few = importance.importance_resampled(odd, goal.limit(0), chunk_bytes=chunk_bytes, share=100)
    assert few.where("rank is not null").count() == sum(x[1] >= 20 for x in want)
    assert importance.importance_resampled(odd.limit(0), goal).count() == 0


def test_chunks_own_each_word_once():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "é", " ", "-", "Z9", "\n"]) for _ in range(rng.randint(1, 60)))
        data = np.frombuffer(text.encode(), np.uint8)
        words, own = ALNUM.findall(text.translate(LOWER)), []
        for a, b, carry in importance.chunk_spans(data, rng.randint(1, 9), 2):
            part = ALNUM.findall(data[a:b].tobytes().decode().translate(LOWER))
            rest = words[len(own) + len(part) - carry :][:2] if carry else []
            assert part[len(part) - carry :] == rest[:carry] if carry else True
            own += part[: len(part) - carry]
        assert own == words


def test_many_equal_scores_keep_ranks_apart(spark):
    docs = spark.range(400).selectExpr("id % 3 as doc_id", "repeat('same few words ', 10) as text")
    got = importance.importance_resampled(docs, docs.limit(1)).where("rank is not null").collect()
    assert sorted(r.rank for r in got) == list(range(1, 101))
    ranked = sorted(got, key=lambda r: r.rank)
    assert [(-r.score, r.doc_id) for r in ranked] == sorted((-r.score, r.doc_id) for r in ranked)


def brute_middle(doc_id, text):
    text, hexa = text or "", hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexa[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    spm = h[3] % 100 < 80
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_middle_equals_brute_force_and_restores(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, odd, odd.withColumn("doc_id", F.col("doc_id") * 7 + 3), odd.limit(0)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = fill_in_middle.fill_in_middle(df).withColumn("back", fill_in_middle.restored()).collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((brute_middle(*r) for r in rows), key=str)
        assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)


def test_middle_forms_all_occur_and_digests(spark, sf):
    got = QUERIES["op12_fill_in_middle"](spark, sf)
    assert {r.form for r in got.select("form").distinct().collect()} == {"plain", "spm", "psm"}
    want = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.restored_sha256 for r in got.collect()} == want


def test_middle_of_pieces_that_look_like_sentinels(spark):
    texts = [(i, x) for i in range(60) for x in ("< P> <S M> <", "P> <M S> <P", "<<< >>> P S M")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = fill_in_middle.fill_in_middle(df, percent=100).withColumn("back", fill_in_middle.restored())
    assert sorted(r.back for r in got.collect()) == sorted(x for _, x in texts)


def laid_out(rows, capacity):
    """Checks what holds for any packing; gives tokens by sequence."""
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.start, r.length, r.doc_tokens))
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return docs, {k: sum(n for _, n in v) for k, v in bins.items()}


def test_packing_equals_library(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_packing"](spark, sf).collect()
    docs, bins = laid_out(rows, 4096)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in rows}
    assert set(docs) == set(texts)
    for d, text in texts.items():
        ids, at = [*library.encode(text, add_special_tokens=False).ids, 2], 0
        for start, length, tokens in sorted(docs[d]):
            assert start == at and tokens == len(ids)
            assert crc[d, start] == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    used = sum(bins.values())
    assert sum(4096 - n for n in bins.values()) < 0.01 * used + 4096


@pytest.mark.parametrize(("capacity", "parts", "fan_in"), [(4096, 1, 32), (64, 7, 2), (10, 5, 3), (1, 2, 2)])
def test_packing_odd_rows(spark, odd, capacity, parts, fan_in):
    out = packing.packed_pieces(odd.repartition(parts), TOKENIZER, capacity=capacity, fan_in=fan_in)
    rows = out.withColumn("ids_crc32", F.crc32("ids")).collect()
    _, bins = laid_out(rows, capacity)
    whole = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        whole[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    want = sorted([*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in CASES)
    assert sum(bins.values()) == sum(map(len, want))
    if capacity == 4096:  # then repeated rows have one piece each of a start
        made = []
        for own in whole.values():
            times = sum(s == 0 for s, _ in own)
            own.sort()
            made += [np.frombuffer(b"".join(b for _, b in own[i::times]), "<u4").tolist() for i in range(times)]
        assert sorted(made) == want
    sequences = packing.packed_sequences(out).collect()
    assert {r.sequence_id: r.n_tokens for r in sequences} == bins and all(len(r.ids) == 4 * r.n_tokens for r in sequences)


def test_packing_of_nothing(odd):
    assert packing.packed_pieces(odd.limit(0), TOKENIZER).count() == 0


def test_pieces_have_class_lengths():
    for capacity in (1, 7, 64, 4096):
        lengths = set(packing.class_lengths(capacity).tolist())
        assert lengths == {capacity // k for k in range(1, capacity + 1)}
        sizes = np.arange(1, 3 * capacity + 2)
        owner, length = packing.cut_lengths(sizes, capacity)
        assert set(length.tolist()) <= lengths and np.array_equal(np.bincount(owner, weights=length), sizes)


def test_open_bins_have_a_bound():
    rng = np.random.default_rng(1)
    bins, out = packing._Bins(4096, 5), []
    total = 0
    for _ in range(20):
        sizes = rng.integers(1, 9000, 300)
        owner, length = packing.cut_lengths(sizes, 4096)
        body = pa.array([b"\0" * (4 * n) for n in length.tolist()], pa.large_binary())
        total += int(length.sum())
        rows = pa.Table.from_arrays([pa.array(owner), pa.array(length), pa.array(length), pa.array(length), body], schema=packing._PIECES)
        out += bins.add(rows)
        assert len(bins.open) <= sum(4096 // n - 1 for n in packing.class_lengths(4096).tolist())
    out += bins.finish()
    used = Counter()
    for b in out:
        for s, n in zip(b["sequence_id"].to_pylist(), b["length"].to_pylist(), strict=True):
            used[s] += n
    assert sum(used.values()) == total and max(used.values()) <= 4096
    assert len(used) * 4096 - total < 0.004 * total + 4096


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_joined_pieces_encode_as_whole_texts(name):
    """Runs of joined pieces give the library's ids, beside odd white space, special strings and letters of many bytes."""
    path = public_tokenizers.path(name)
    library, draw = Tokenizer.from_file(path), random.Random(5)
    words = ["a", "It's", "don't", "ß", "日本語", "🙂", "é", "x1y22", "''", "...", "<|endoftext|>", "<|endoftext", "|>", "<", "\x1c", "Ǆ", "", "i̇"]
    gaps = [" "] * 8 + ["  ", "\n", "\n\n ", "\t", "\xa0", " ", " 　", "\r\n", "\x85"]
    texts = ["".join(x for _ in range(draw.randrange(400)) for x in (draw.choice(words) + draw.choice("abcdefgh") * draw.randrange(4), draw.choice(gaps))) for _ in range(300)]
    texts += ["", " ", "\n", "a", " a", "a ", "  a  "]
    for full in (0, 1 << 20):
        encoder = PieceEncoder(path, full)
        for _ in range(2):
            ids, first = encoder.ids(pa.array(texts))
            got = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
            assert got == [library.encode(x, add_special_tokens=False).ids for x in texts]
            assert encoder.counts(pa.array(texts)).tolist() == list(map(len, got))
