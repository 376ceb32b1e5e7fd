from __future__ import annotations

import math
import re
from types import SimpleNamespace

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindle.functions import text as T
from spindle.operators import chunking, code, context, conversation, edits, retrieval, storage, vectors
from spindle.plans import catalog
from spindle.session import stored
from spindle.sources import files


def test_cosine_bounds(spark):
    rows = [(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [-1.0, 0.0]), (3, [0.0, 0.0], [1.0, 1.0]), (4, [1.0], [1.0, 2.0]), (5, [], [])]
    df = spark.createDataFrame(rows, "id int, a array<float>, b array<float>")
    assert [r[0] for r in df.orderBy("id").select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_predicate_nulls(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, v string")
    ids = lambda clause: sorted(r.id for r in df.where(vectors.predicate(clause, {"v": "string"})).collect())
    assert ids({"v": {"$ne": "x"}}) == [2, 3]
    assert ids({"v": {"$in": ["x"]}}) == [1]
    assert ids({"v": {"$in": []}}) == []
    assert ids({"v": None}) == [2]
    assert ids({"w": {"$ne": 1}}) == [1, 2, 3]
    assert ids({"w": 1}) == []
    assert ids({"$or": []}) == []
    assert ids(None) == [1, 2, 3]


def test_top_k_in_blocks(spark):
    rows = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.cos(F.col("id") % 20), F.sin(F.col("id") % 20)).alias("embedding"))
    asked = rows.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole, parts, none = (sorted(map(tuple, vectors.top_k(q, rows, 5, block=b).collect())) for q, b in ((asked, 1000), (asked, 4), (asked.where("false"), 4)))
    assert len(whole) == 15 * 5 and whole == parts and none == []


def test_top_k_of_odd_vectors_and_equal_scores(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(70, 5))
    some = [base[i % 70].tolist() for i in range(400)] + (-base[:20]).tolist() + [rng.normal(size=3).tolist() for _ in range(9)]
    some += [None, [], [0.0] * 5, [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 1.0, 0.0, 2.0, 1.0], [1e-120] * 5, [1e120, 2e120, 0.0, 1e120, 0.0], [1e200] * 5]
    order = rng.permutation(len(some)).tolist()
    rows = spark.createDataFrame([(i, some[j]) for i, j in enumerate(order)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 9 = 0 or vec_id in (" + ",".join(str(i) for i, j in enumerate(order) if j >= 420) + ")").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    score = {(r.query_id, r.vec_id): r.s for r in asked.crossJoin(rows).select("query_id", "vec_id", vectors.cosine(F.col("embedding"), F.col("query")).alias("s")).collect()}
    for k, block, part in ((3, 8192, 16384), (7, 10, 100), (40, 1000, 90)):
        got = {}
        for r in vectors.top_k(asked, rows, k, block=block, part=part).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
        for q in {q for q, _ in score}:
            best = sorted((-round(s, 12), v) for (a, v), s in score.items() if a == q)[:k]
            assert sorted(got[q]) == [(i, v, round(-s, 9)) for i, (s, v) in enumerate(best, 1)]


def test_readable_sizes_round_halves_to_even(spark):
    sizes = [1023, 1024, 5376, 26880, 8960, 1792, 5 * 1024**2 // 4, 3 << 30, None]
    shown = lambda *units: [r.s for r in spark.createDataFrame(list(enumerate(sizes)), "i int, n long").orderBy("i").select(T.readable_size(F.col("n"), *units).alias("s")).collect()]
    want = ["1023 B", "1.0 KB", "5.2 KB", "26.2 KB", "8.8 KB", "1.8 KB", "1.2 MB"]
    assert shown() == [*want, "3.0 GB", None] and shown(("KB", "MB")) == [*want, "3072.0 MB", None]


def test_relevance_rounds_tenths_as_sql_does(spark):
    said = [(1, "t1", t, "user", w) for t, w in ((0, "alpha"), (77, "beta"), (149, "gamma"), (281, "delta"), (300, "kappa"))]
    chat = spark.createDataFrame(said, "conv_id long, thread_id string, turn long, role string, text string")
    asked = spark.createDataFrame([(1, "omega")], "conv_id long, prompt string")
    got = {r.turn: r.score for r in conversation.relevance(chat, asked, threshold=0.0).collect()}
    sql = "SELECT t, round(15 * (t::DOUBLE / 300) + CASE WHEN t = 0 THEN 10 ELSE 0 END, 1) FROM unnest([0, 77, 149, 281, 300]) x(t)"
    assert got == dict(duckdb.sql(sql).fetchall()) == {0: 10.0, 77: 3.9, 149: 7.5, 281: 14.1, 300: 15.0}


def test_budget_skips_and_goes_on(spark):
    rows = [(1, i, "p", "s", "x" * n) for i, n in enumerate((100, 4000, 40), 1)]
    df = spark.createDataFrame(rows, "query_id int, place int, path string, symbol string, content string")
    got = {r.place: r.state for r in context.packed(df, 60).collect()}
    assert got == {1: "taken", 2: "trimmed", 3: "taken"}


def test_only_rows_that_hits_name_are_shuffled(spark, monkeypatch):
    hits = stored(spark.createDataFrame([(1, 5), (2, 5), (2, 7), (3, None), (3, 99)], "query_id long, node long"))
    rows = spark.range(0, 50).selectExpr("id AS node", "concat('t', id) AS text")
    want = [(1, 5, "t5"), (2, 5, "t5"), (2, 7, "t7")]
    found = context.with_rows(hits, rows, "node")
    assert sorted((r.query_id, r.node, r.text) for r in found.collect()) == want
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(context, "BROADCAST_IDS", 2)
    found = context.with_rows(hits, rows, "node")
    assert sorted((r.query_id, r.node, r.text) for r in found.collect()) == want
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_compressed_lines(spark):
    body = "\n".join(map(str, range(40)))
    df = spark.createDataFrame([(body,), ("a\nb",)], "t string").select(context.compressed(F.col("t")).alias("c"))
    long, short = [r.c for r in df.collect()]
    assert short is None and long.split("\n")[24] == "    // ... 8 lines omitted for brevity ..." and long.split("\n")[-1] == "39"


def islands(lines: list[str]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i, x in enumerate(lines, 1):
        if x.strip(" "):
            if out and out[-1][1] == i - 1:
                out[-1] = (out[-1][0], i)
            else:
                out.append((i, i))
    return out


def merged(spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] - out[-1][0] + 1 < least:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", " ", "x", "y z"]), min_size=1, max_size=30), min_size=1, max_size=6))
def test_islands_and_blocks(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, lines array<string>")
    got = df.select("id", chunking.islands(F.col("lines")).alias("i"), chunking.merged(chunking.islands(F.col("lines")), 3).alias("m")).collect()
    for r in got:
        want = islands(texts[r.id])
        assert [tuple(s) for s in r.i] == want
        assert [tuple(s) for s in r.m] == merged(want, 3)


def test_long_file_is_split(spark):
    text = "\n".join("" if i % 10 == 9 else f"l{i}" for i in range(60))
    df = spark.createDataFrame([("a.md", text, "document"), ("b.json", text, "data"), ("c.md", "  ", "document"), ("d.md", None, "document")], "path string, text string, kind string")
    got = chunking.file_chunks(df, most_lines=20, least_lines=12).orderBy("path", "part").collect()
    assert [(r.path, r.kind, r.start_line, r.end_line) for r in got] == [("a.md", "document", 1, 19), ("a.md", "block", 21, 39), ("a.md", "block", 41, 59), ("b.json", "data", 1, 60)]
    assert got[1].symbol == "a.md#block1" and got[1].parts == 2


def test_expand_visits_once_and_keeps_caps(spark):
    hits = spark.createDataFrame([(1, 0, 1.0, 1)], "query_id int, node int, score double, rank int")
    edges = spark.createDataFrame([(0, 1, 0, False), (0, 2, 1, False), (0, 3, 2, True), (1, 2, 0, False), (2, 0, 0, False), (2, 4, 1, False)], "src int, dst int, pos int, external boolean")
    got = retrieval.expand(hits, edges, depth=3).orderBy("ordinal").collect()
    assert [(r.node, r.depth) for r in got] == [(0, 0), (1, 1), (2, 1), (4, 2)]
    assert [round(r.score, 4) for r in got] == [1.0, 0.82, 0.82, 0.6724]
    assert retrieval.expand(hits, edges, depth=3, most=3).count() == 3
    assert [r.node for r in retrieval.expand(hits, edges, depth=2, frontier=1).orderBy("ordinal").collect()] == [0, 1, 2]


def test_reindexing_is_idempotent(spark):
    new = spark.createDataFrame([(1, "a", "v"), (2, "b", "v")], "chunk_id int, hash string, version string")
    assert {r.action for r in storage.index_actions(new, new).collect()} == {"skipped"}
    assert {r.action for r in storage.index_actions(new, new.limit(0)).collect()} == {"inserted"}
    assert {r.action for r in storage.index_actions(new.limit(0), new).collect()} == {"deleted"}
    bumped = new.withColumn("version", F.lit("w"))
    assert {r.action for r in storage.index_actions(bumped, new).collect()} == {"updated"}


def test_snapshot_is_new_each_time(spark, tmp_path):
    df = spark.range(3)
    a, b = storage.write_snapshot(df, str(tmp_path)), storage.write_snapshot(df, str(tmp_path))
    assert a != b and spark.read.parquet(a).count() == 3


def message(role, domain="general", topic=(), **flags):
    return SimpleNamespace(role=role, domain=domain, topic=topic, **{"is_followup": False, "is_reference": False, "is_new_topic": False, "continues": False} | flags)


def test_replay_rules():
    own = conversation.Replay()
    assert own.feed(message("assistant")) == (None, None, False)
    assert own.feed(message("user", "software", ["app", "login"])) == ("t1", "software", True)
    assert own.feed(message("assistant")) == ("t1", "software", False)
    assert own.feed(message("user", "knowledge", ["gravity"], is_new_topic=True)) == ("t2", "knowledge", True)
    assert own.feed(message("user", "general", is_reference=True, is_followup=True)) == ("t2", "knowledge", False)
    assert own.feed(message("user", "software", ["login"])) == ("t1", "software", False)
    assert own.feed(message("user", "general", ["tests"], continues=True)) == ("t1", "software", False)
    assert own.feed(message("user", "software", ["unrelated"])) == ("t3", "software", True)
    assert conversation.Replay(own.state()).feed(message("assistant")) == ("t3", "software", False)


def test_threads_cover_messages(spark, sf):
    rows = catalog.QUERIES["q27_thread_replay"](spark, sf).collect()
    chat = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    first = {}
    for r in sorted(chat, key=lambda r: (r.conv_id, r.turn)):
        if r.role != "assistant":
            first.setdefault(r.conv_id, r.turn)
    assert len(rows) == len(chat)
    assert all((r.thread_id is not None) == (r.turn >= first.get(r.conv_id, math.inf)) for r in rows)


def test_stream_equals_batch(spark, sf, tmp_path):
    from spindle.streaming.threads import stream_threads

    chat = spark.read.parquet(f"{sf}/conversations.parquet")
    source, out = str(tmp_path / "in"), "threads_out"
    for k in range(2):
        chat.where(f"turn {'<' if k == 0 else '>='} 3").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(chat.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = stream_threads(stream).writeStream.format("memory").queryName(out).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = {tuple(r) for r in spark.table(out).collect()}
    assert got == {tuple(r) for r in conversation.threads(chat).collect()}


def test_block_end():
    lines = ["int f(int a) { // {", "  s = \"}\"; /* } */", "  if (a) {", "  }", "}", "int g();", "x"]
    assert [code.block_end(lines, i) for i in (1, 3, 6, 7)] == [5, 4, 6, 7]


def test_python_rows():
    rows = code.python_rows("m.py", "import os\nclass A(Enum):\n  def f(self): pass\ndef _g(): pass\n")
    assert [(r[1], r[2], r[3], r[6]) for r in rows] == [("import", "os", None, False), ("enum", "A", None, True), ("method", "f", "A", False), ("function", "_g", None, False)]
    assert code.python_rows("b.py", "def (")[0][1] == "error"


def test_dependencies_and_owners(spark):
    chunks = spark.createDataFrame([("c", "p", "Button(cn(x))")], "chunk_id string, path string, content string")
    imports = spark.createDataFrame([("p", "./ui", ["Button", "Card"]), ("p", "lib/cn", [])], "path string, module string, names array<string>")
    assert {tuple(r) for r in code.dependencies(chunks, imports).collect()} == {("c", "Button", "./ui"), ("c", "cn", "lib/cn")}


def test_edit_plans(spark):
    plan = '```json\n{"edits": [{"action": "modify_file", "path": "a", "new_content": "x"}, {"action": "delete_file", "path": "b"}]}\n```'
    answers = spark.createDataFrame([(1, plan), (2, "none"), (3, '{"edits": [{"action": "move_file", "path": "a"}]}'), (4, None)], "plan_id long, answer string")
    got = edits.parsed_plans(answers).orderBy("plan_id", "pos").collect()
    assert [(r.plan_id, r.action, r.error) for r in got] == [(1, "modify_file", None), (1, "delete_file", None), (2, None, "no edits"), (3, None, "edit 0: target_path"), (4, None, "no edits")]


def test_apply_plan(spark):
    files_ = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, text string")
    sha = spark.range(1).select(T.content_hash(F.lit("1"))).first()[0]
    rows = [(1, "a", "modify_file", None, sha), (2, "a", "modify_file", None, "other"), (3, "c", "delete_file", None, None), (4, "b", "create_file", None, None), (5, "../x", "create_file", None, None), (6, "a", "move_file", "b", None), (7, "n", "create_file", None, None)]
    df = spark.createDataFrame(rows, "id int, path string, action string, target_path string, expected_hash string")
    assert [r.status for r in edits.apply_plan(df, files_).orderBy("id").collect()] == ["applied", "conflict", "missing", "conflict", "error", "conflict", "applied"]


def test_overall_risk_and_diff_lines(spark):
    rows = [
        (1, "modify_file", "src/a.py", None, "a\nb\nc\n", "a\nB\nc\nd\n"), (2, "create_file", "new.txt", None, "", "x\ny"), (3, "delete_file", "old.txt", None, "1\n2\n3\n", None),
        (4, "move_file", "p.txt", "q.txt", "same\n", "same\n"), (5, "modify_file", "conf/config.yml", None, "a: 1\n", "a: 2\n"), (6, "modify_file", "same.txt", None, "s\n", "s\n"),
        (7, "modify_file", "many.txt", None, "", "\n".join(map(str, range(31)))), (8, "modify_file", "more.txt", None, "", "\n".join(map(str, range(121)))),
    ]
    d = edits.diffs(spark.createDataFrame(rows, "id int, action string, path string, target_path string, before string, after string"))
    assert {r.id: r.risk for r in d.collect()} == {1: "low", 2: "low", 3: "high", 4: "high", 5: "medium", 6: "low", 7: "medium", 8: "high"}
    assert edits.overall_risk(d.withColumn("g", F.lit(1)), ["g"]).first().risk == "high"
    assert edits.diff_lines(d.where("id = 1"), "id").where("kind = 'added'").count() == 2


def test_tree_keeps_underscore_names(spark, tmp_path):
    (tmp_path / "pkg" / "node_modules").mkdir(parents=True)
    for name, raw in {"pkg/__init__.py": b"x = 1\r\n", "pkg/bin.dat2": b"a\0b", "pkg/node_modules/no.js": b"", "a.py": "é".encode("latin-1"), ".env": b"k", "yarn.lock": b""}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path: r for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"pkg/__init__.py", "pkg/bin.dat2", "a.py", ".env", "yarn.lock"}
    assert got["pkg/__init__.py"].text == "x = 1\n" and got["pkg/__init__.py"].skip_reason is None
    assert (got["pkg/bin.dat2"].skip_reason, got[".env"].skip_reason, got["yarn.lock"].skip_reason) == ("binary", "hidden", "ignored")
    assert files.repository_statistics(files.read_tree(spark, str(tmp_path))).first().accepted == 2


def test_text_functions(spark):
    df = spark.createDataFrame([("C++ and .NET, the C# App app",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(T.keywords(F.col("t"))).collect()]
    assert got == [[".net", "app", "c++"], [], []]
    assert [r[0] for r in df.select(T.token_estimate(F.col("t"))).collect()] == [7, 0, 0]


def test_word_pattern():
    pattern = T.word_pattern(["app", "c++", "web app"])
    java_to_python = pattern.replace(r"\p{L}\p{N}_", r"\w")
    hit = lambda s: bool(re.search(java_to_python, s))
    assert hit("an app.") and not hit("apple") and hit("my web apps") and hit("c++x") and not hit("c++ x")


def test_diffs_of_documents(spark, sf):
    got = {r.id: r for r in catalog.QUERIES["q41_edit_risk"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text, d, kind = r.text or "", got[r.doc_id], r.doc_id % 5
        lines = len(text.splitlines())
        assert (d.added, d.removed) == {0: (lines, 0), 1: (2, 0), 2: (0, lines), 3: (0, 0), 4: (0, 0)}[kind]
        assert d.risk == ("high" if kind in (2, 3) else "medium" if r.doc_id % 7 == 0 else "high" if d.added > 120 else "medium" if d.added > 30 else "low")


def test_budgets_of_windows(spark):
    names = ["8k", "128k", "nonsense", "", None, "600", "-5", "2000"]
    df = spark.createDataFrame([(n,) for n in names], "w string")
    from spindle.operators import context

    assert [r[0] for r in df.select(context.budget_column(F.col("w"))).collect()] == [context.budget(n if n is not None and not n.lstrip("-").isdigit() else int(n) if n else "") for n in names]
