from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from spindle.operators import classify, context, conversation, imports, routing
from spindle.sources import files, manifests

FILES = "repository string, path string, language string, size_bytes long, n_lines long, parse_error boolean, skip_reason string"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def tree(spark):
    return spark.createDataFrame(
        [
            ("a", "x.py", "python", 10, 1, False, None), ("a", "src/deep/y.go", "go", 30, 3, True, None), ("a", "src/z.ts", "typescript", 30, 3, None, None), ("a", "src/note", "unknown", 4, 1, False, None),
            ("a", "img/p.png", "unknown", 9, 0, False, "binary"), ("a", "big.sql", "sql", 9_000_000, 0, False, "oversized"), ("a", "locked", "unknown", 0, 0, False, "unreadable"),
            ("b", "q/.env", "unknown", 5, 0, False, "hidden"), ("a", None, "python", 1, 1, False, "ignored"), (None, "m.py", "python", 6, 2, False, None),
        ],
        FILES,
    )


def test_repository_rows(spark):
    got = {r.repository: r for r in files.repository_rows(tree(spark)).collect() if r.repository is not None}
    a, b = got["a"], got["b"]
    assert (a.files, a.supported, a.parsed, a.failed, a.ignored) == (4, 3, 2, 1, 3)  # null is no error
    assert (a.bytes, a.lines, a.mean_bytes, a.largest, a.languages, a.directories) == (74, 8, 18.5, "src/deep/y.go", "go=1,python=1,typescript=1,unknown=1", 4)
    assert (b.files, b.bytes, b.mean_bytes, b.largest, b.languages, b.directories, b.ignored) == (0, 0, 0.0, None, "", 2, 1)


def test_directory_rows_and_tally(spark):
    got = rows(files.directory_rows(tree(spark).where("repository is not null")), "repository", "directory", "files", "subdirectories", "languages")
    assert got == [
        ("a", ".", 1, 2, "python=1"), ("a", "img", 0, 0, ""), ("a", "src", 2, 1, "typescript=1,unknown=1"), ("a", "src/deep", 1, 0, "go=1"), ("b", ".", 0, 1, ""), ("b", "q", 0, 0, ""),
    ]
    assert rows(files.scan_tally(tree(spark).where("repository = 'a'"))) == [("a", 4, 2, 1, 1)]
    assert files.repository_rows(tree(spark).limit(0)).count() == files.directory_rows(tree(spark).limit(0)).count() == 0


def test_repositories_are_kept_apart(spark):
    texts = spark.createDataFrame([("a", "requirements.txt", "django"), ("b", "requirements.txt", "fastapi"), ("b", "package.json", '{"dependencies": {"react": "1"}}')], "repository string, name string, text string")
    got = manifests.frameworks(texts, ("repository",))
    assert {(r.repository, r.framework.lower(), r.place) for r in got.collect()} >= {("a", "django", 1)}
    assert {r.repository for r in got.where("lower(framework) in ('react', 'fastapi')").collect()} == {"b"}
    assert {r.place for r in got.where("repository = 'a'").collect()} == {1}
    counted = files.languages_ranked(spark.createDataFrame([("a", "go", 1), ("b", "go", 2), ("b", "css", 3), ("b", "css", 4)], "repository string, language string, ordinal int"), ("go",), ("repository",))
    assert rows(counted) == [("a", "go", 1, 1), ("b", "css", 2, 2), ("b", "go", 1, 1)]
    used = spark.createDataFrame([("a", "lib.x", False), ("b", "lib.x", False)], "repository string, module string, is_relative boolean")
    here = spark.createDataFrame([("a", "lib/x.py")], "repository string, path string")
    assert rows(imports.located(used, here, ("repository",)), "repository", "is_external") == [("a", False), ("b", True)]


def test_providers(spark):
    models = spark.createDataFrame([("groq", "m1", 0), ("groq", "Whisper-2", 1), ("gemini", "g-vision", 0), ("ollama", "embedder", 0), ("ollama", None, 1), ("new", "vision", 0)], "provider string, model string, ordinal int")
    assert rows(routing.suited_models(models), "provider", "model") == [("groq", "m1"), ("new", "vision"), ("ollama", None)]
    now = dt.datetime(2025, 1, 1, 12)
    tests = spark.createDataFrame([("groq", "m1", True, now), ("groq", "Whisper-2", True, now - dt.timedelta(hours=1)), ("gemini", "g-vision", False, now)], "provider string, model string, validated boolean, last_tested timestamp")
    records = spark.createDataFrame([("groq", True), ("gemini", True), ("gone", True)], "provider string, connected boolean")
    got = rows(routing.provider_status(records, models, tests, F.lit(now)), "provider", "connected", "model")
    assert got == [("cloudflare", False, None), ("gemini", True, None), ("groq", True, "m1"), ("ollama", False, "embedder"), ("ollama", False, None)]


def test_confidence(spark):
    cases = {"0.4": 0.4, "7": 1.0, "-2": 0.0, "true": 0.7, "null": 0.7, '"HIGH "': 0.9, '"low"': 0.4, "low": 0.7, '".5"': 0.5, '"5."': 1.0, '"1e-2"': 0.01, '"0.5f"': 0.7, '"x"': 0.7, "[1]": 0.7, "": 0.7, '"': 0.7, None: 0.7}
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", classify.confidence(F.col("v")).alias("c")).collect()
    assert {r.v: r.c for r in got} == cases


def test_client_ids_and_task_prompts(spark):
    said = spark.createDataFrame([("c", 2, "t2"), ("c", 1, "t1"), ("d", 5, None)], "conv string, id int, made string")
    assert rows(conversation.client_ids(said, "conv", F.col("made"), "id"), "id", "client_id") == [(1, "t1-0"), (2, "t2-1"), (5, "0")]
    asked = spark.createDataFrame([(1, "code_generation", "r", "s"), (2, None, "r", None)], "query_id int, task string, repository string, summary string")
    prompts = spark.createDataFrame([(1, "# Question\nwhy?"), (2, "# Question\nhow?")], "query_id int, prompt string")
    first, second = context.task_prompts(prompts, asked).orderBy("query_id").collect()
    assert first.user == "# Repository: r\n\nSummary: s\n\n# Question\nwhy?" and second.user == "# Repository: r\n\n# Question\nhow?"
    assert first.system.split("\n\n")[1].startswith("Task: Write") and context.RULES in first.system and second.task == context.GENERAL
    assert first.tokens == (len(first.system) + 2 + len(first.user)) // 4
