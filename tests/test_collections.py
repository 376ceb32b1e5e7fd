"""Stored collections, the approximate index, expansion by symbols, packets and statistics."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spindle.operators import collections, context, conversation, nearest, retrieval, vectors

QUERIES = entry.queries()


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_versions_tokens_and_keys(spark, tmp_path):
    path = collections.collection_path(f"{tmp_path}/", "r1")
    assert path.endswith("/repo_r1") and collections.count(spark, path) == 0 and collections.current(spark, path) is None
    assert collections.fetch(spark, path).count() == 0
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "id long, v string")
    assert collections.upsert(spark, path, a, ["id"], "a") == 1 == collections.upsert(spark, path, a.limit(0), ["id"], "a")
    b = spark.createDataFrame([(2, "z"), (3, "p"), (3, "q"), (None, "m")], "id long, v string")
    assert collections.upsert(spark, path, b, ["id"], "b", [F.col("v")]) == 2
    assert sorted(map(str, rows_of(collections.current(spark, path).fillna(-1), "id", "v"))) == ["(-1, 'm')", "(1, 'x')", "(2, 'z')", "(3, 'q')"]
    assert collections.append(spark, path, spark.createDataFrame([(1, "no"), (4, "new")], "id long, v string"), ["id"], "c") == 3
    assert collections.delete(spark, path, F.col("id") >= 3, "d") == 4
    assert rows_of(collections.current(spark, path).where("id is not null"), "id", "v") == [(1, "x"), (2, "z")] and collections.count(spark, path) == 3
    assert rows_of(collections.current(spark, path, 1).where("id is not null"), "id", "v") == [(1, "x"), (2, "y")]
    assert collections.versions(spark, path).count() == 4


def test_index_is_brought_up_to_date(spark, tmp_path):
    path = f"{tmp_path}/c"
    make = lambda rows: spark.createDataFrame(rows, "chunk_id string, hash string, version string, note string")
    first = collections.index_chunks(spark, path, make([("a", "1", "v", "old"), ("b", "1", "v", "old"), ("c", "1", "v", "old")]), "t1")
    assert rows_of(first, "action", "chunks") == [("inserted", 3)]
    new = make([("a", "1", "v", "kept as stored"), ("b", "2", "v", "new"), ("d", "1", "v", "new")])
    assert rows_of(collections.index_chunks(spark, path, new, "t2"), "action", "chunks") == [("deleted", 1), ("inserted", 1), ("skipped", 1), ("updated", 1)]
    assert rows_of(collections.current(spark, path), "chunk_id", "hash", "note") == [("a", "1", "old"), ("b", "2", "new"), ("d", "1", "new")]
    assert rows_of(collections.index_chunks(spark, path, new, "t3"), "action", "chunks") == [("skipped", 3)]
    assert rows_of(collections.index_chunks(spark, path, new.limit(0), "t4"), "action", "chunks") == [("deleted", 3)] and collections.count(spark, path) == 0


def test_stream_writes_each_epoch_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, v string").coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        rows = spark.readStream.schema("id long, v string").parquet(f"{tmp_path}/in")
        collections.stream_into(rows, f"{tmp_path}/c", ["id"], "s", f"{tmp_path}/{random.random()}").processAllAvailable()
    assert collections.versions(spark, f"{tmp_path}/c").count() == 1 and collections.count(spark, f"{tmp_path}/c") == 2


def test_fetch_reaches_the_scan(spark, tmp_path, capsys):
    df = spark.range(50).select(F.col("id").cast("string").alias("chunk_id"), (F.col("id") % 3).cast("int").alias("label"), F.array(F.lit(1.0)).alias("embedding"))
    collections.upsert(spark, f"{tmp_path}/c", df, ["chunk_id"], "x")
    out = collections.fetch(spark, f"{tmp_path}/c", {"label": {"$eq": 1}}, 4)
    assert rows_of(out, "chunk_id", "score") == [("1", 0.0), ("10", 0.0), ("13", 0.0), ("16", 0.0)] and "embedding" not in out.columns
    out.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "label" in plan.split("PushedFilters")[1].split("\n")[0] and "embedding" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_dependency_lists(spark):
    texts = ['[{"name":"a","module":"m","is_external":true},{"name":"b"},{"module":"x"},3,"s",null,{"name":""}]', "[]", "", "not json", None, '{"name":"a"}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", collections.decoded_dependencies(F.col("t")).alias("d"))
    got = {r.i: [tuple(x) for x in r.d] for r in df.collect()}
    assert got == {0: [("a", "m", True), ("b", "", False)], 1: [], 2: [], 3: [], 4: [], 5: []}


def test_approximate_search_finds_nine_of_ten(spark, sf):
    vecs = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = vecs.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = vectors.top_k(asked, vecs, 10)
    found = QUERIES["q69_approximate_topk"](spark, sf)
    assert nearest.recall(found, exact) >= 0.9
    scores = {(r.query_id, r.vec_id): round(r.score, 6) for r in vectors.top_k(asked, vecs, 500).collect()}
    assert all(abs(scores[r.query_id, r.vec_id] - r.score) < 2e-6 for r in found.collect())


def test_approximate_search_of_clusters_and_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(20, 8)) * 5
    rows = [(i, (heads[i % 20] + rng.normal(size=8) * 0.3).tolist()) for i in range(600)] + [(600, None), (601, []), (602, [0.0] * 8), (603, [1.0] * 3), (604, [float("nan")] * 8)]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    nearest.build_index(vecs, f"{tmp_path}/i", lists=20, sample=200)
    assert spark.read.parquet(f"{tmp_path}/i/lists").count() == 605
    asked = vecs.where("vec_id % 50 = 0 and vec_id < 600").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = vectors.top_k(asked, vecs.where("vec_id < 600"), 10)
    few = nearest.probe(spark, f"{tmp_path}/i", asked, 10, probes=3, block=5)
    assert nearest.recall(few, exact) >= 0.9
    every = nearest.probe(spark, f"{tmp_path}/i", asked, 10, probes=20)
    assert rows_of(every, "query_id", "vec_id", "rank") == rows_of(exact, "query_id", "vec_id", "rank")
    assert nearest.probe(spark, f"{tmp_path}/i", asked.limit(0), 10).count() == 0


def plain_expansion(hits, chunks, edges, depth, frontier_most, fetched, most):
    """The loop as one would write it for a single query."""
    by_id = {c: (s, p) for c, s, p in chunks}
    out, ids, names, ahead = [(c, by_id[c][0], s, 0) for c, s in hits], {c for c, _ in hits}, {by_id[c][0] for c, _ in hits}, {}

    def note(c, score, to):
        for n in [n for x, _, n, e in sorted(edges) if x == c and not e and n] + [p for p in [by_id[c][1]] if p]:
            if n not in names:
                to[n] = max(to.get(n, 0.0), score * 0.82)

    for c, s in hits:
        note(c, s, ahead)
    for d in range(1, depth + 1):
        taken = [n for n in ahead if n not in names][:frontier_most]
        if not taken:
            break
        names |= set(taken)
        after = {}
        for c in sorted(c for c, s, _ in chunks if s in taken)[:fetched]:
            if c in ids:
                continue
            score = round(ahead[by_id[c][0]] + 1e-10, 6)
            out.append((c, by_id[c][0], score, d))
            ids.add(c)
            note(c, score, after)
            if len(ids) >= most:
                break
        ahead = after
        if len(ids) >= most:
            break
    return out


def test_expansion_by_symbols_equals_the_loop(spark):
    rng = random.Random(9)
    for case in range(4):
        chunks = [(i, f"s{rng.randrange(14)}", rng.choice([None, "", f"s{rng.randrange(14)}"])) for i in range(40)]
        edges = [(rng.randrange(40), p, rng.choice([None, "", "gone", f"s{rng.randrange(14)}"]), rng.random() < 0.2) for p in range(60)]
        limits = [(5, 3, 6, 20), (3, 50, 50, 50), (2, 1, 2, 5), (2, 4, 9, 3)][case]
        hits = {q: [(c, round(0.9 - 0.1 * i, 2)) for i, c in enumerate(rng.sample(range(40), 3))] for q in range(3)}
        h = spark.createDataFrame([(q, c, s, i + 1) for q, own in hits.items() for i, (c, s) in enumerate(own)], "query_id long, chunk_id long, score double, rank int")
        got = retrieval.expand_symbols(h, spark.createDataFrame(chunks, "chunk_id long, symbol string, parent string"), spark.createDataFrame(edges, "chunk_id long, pos int, name string, external boolean"), depth=limits[0], frontier=limits[1], fetched=limits[2], most=limits[3])
        found = {}
        for r in sorted(got.collect(), key=lambda r: r.ordinal):
            found.setdefault(r.query_id, []).append((r.chunk_id, r.symbol, round(r.score, 6), r.depth))
        assert found == {q: [(c, s, round(x, 6), d) for c, s, x, d in plain_expansion(own, chunks, edges, *limits)] for q, own in hits.items()}, case


def test_a_symbol_of_many_chunks_is_looked_up_by_its_first_ones(spark, monkeypatch):
    written = []
    monkeypatch.setattr(retrieval, "stored", lambda df: written.append(df.checkpoint()) or written[-1])
    chunks = spark.range(3000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("s"), F.col("id") % 2).alias("symbol"), F.lit("s1").alias("parent"))
    hits = spark.range(50).select(F.col("id").alias("query_id"), (F.col("id") * 2 + 400).alias("chunk_id"), F.lit(0.9).alias("score"), F.lit(1).alias("rank"))
    none = spark.createDataFrame([], "chunk_id long, pos int, name string, external boolean")
    out = retrieval.expand_symbols(hits, chunks, none, depth=1, fetched=4, most=50).where("depth = 1")
    assert {(r.query_id, r.chunk_id) for r in out.collect()} == {(q, c) for q in range(50) for c in (1, 3, 5, 7)}
    assert [sorted(r.chunk_id for r in df.collect()) for df in written if sorted(df.columns) == ["chunk_id", "name"]] == [list(range(8))]


def test_expansion_plans_do_not_grow_with_depth(spark, sf):
    reads = []
    for depth in (1, 3):
        vecs = spark.range(30).select(F.col("id").alias("chunk_id"), F.concat(F.lit("s"), F.col("id")).alias("symbol"), F.concat(F.lit("s"), F.col("id") + 1).alias("parent"))
        hits = spark.createDataFrame([(1, 1, 0.9, 1)], "query_id long, chunk_id long, score double, rank int")
        none = spark.createDataFrame([], "chunk_id long, pos int, name string, external boolean")
        out = retrieval.expand_symbols(hits, vecs, none, depth=depth)
        reads.append(out._jdf.queryExecution().toString().count("Join"))
    assert reads == [0, 0]


def test_packets(spark):
    said = [
        (1, 0, "user", "build a react dashboard with charts"), (1, 1, "assistant", "done"), (1, 2, "user", "explain photosynthesis in plants"), (1, 3, "assistant", "light"),
        (2, 0, "assistant", "hello"), (2, 1, None, None),
    ]
    messages = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    asked = spark.createDataFrame([(1, "add a react dashboard filter"), (3, "hello there"), (2, None)], "conv_id long, prompt string")
    got = {r.conv_id: r for r in conversation.packets(messages, asked).collect()}
    assert (got[1].thread_id, got[1].is_new_topic, got[1].total_history, got[1].used_count) == ("t1", False, 2, 1)
    assert got[1].reason == "Reusing 1 relevant message from the current thread." and [tuple(t) for t in got[1].turns] == [("user", said[0][3]), ("user", "add a react dashboard filter")]
    assert (got[3].thread_id, got[3].is_new_topic, got[3].used_count, got[3].reason) == ("t1", True, 0, "New topic — no prior context needed.")
    assert set(got) == {1, 2, 3} and got[2].turns[-1].text == ""
    assert conversation.packets(messages, asked.limit(0)).count() == 0


def test_packets_use_the_replayed_threads(spark, sf):
    got = {r.conv_id: r for r in QUERIES["q75_context_packets"](spark, sf).collect()}
    said = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    replayed = {r.conv_id: (r.thread_id, r.is_new) for r in QUERIES["q27_thread_replay"](spark, sf).join(said, ["conv_id", "turn"]).collect()}
    assert {c: (r.thread_id, r.is_new_topic) for c, r in got.items()} == replayed and any(r.used_count for r in got.values())


def test_context_statistics_of_little(spark):
    rows = [(1, 1, "a/x", "A", "python", "", 10, "taken", 0.5), (1, 2, "a/y", "B", "go", "Gin", 0, "trimmed", 0.9), (1, 3, "a/x", "C", "go", "Gin", 5, "compressed", 0.7), (2, 1, "z", "D", None, None, 0, "trimmed", 0.1)]
    df = spark.createDataFrame(rows, "query_id long, place int, path string, symbol string, language string, framework string, tokens long, state string, final double")
    assert rows_of(context.statistics(df), "query_id", "used_tokens", "included", "compressed", "trimmed", "trimmed_symbols") == [(1, 15, 2, 1, 1, "B"), (2, 0, 0, 0, 1, "D")]
    assert rows_of(context.summary(df, F.lit("r")), "query_id", "summary") == [(1, "Repository 'r'; framework: Gin; languages: go, python; 1 relevant file(s) in context.")]
    assert rows_of(context.shown_sources(df, 1, 1), "files", "more_files", "symbols", "more_symbols", "top_score") == [("a/x", 1, "A", 1, 0.7)]
