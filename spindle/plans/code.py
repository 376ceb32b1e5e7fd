"""File names, manifests, symbols and edits, made from documents: fixed names and texts that each document fills in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import vocabulary as V
from spindle.operators import code, edits
from spindle.plans.registry import picked, picked_sql, query, values
from spindle.plans.sources import FILES, source_files
from spindle.sources import files, manifests

NAMES = [
    ("src/__init__.py", 10), ("src/.hidden", 10), ("package-lock.json", 10), ("logo.PNG", 10), ("Makefile", 10), ("lib/App.TSX", 10), ("package.json", 10),
    ("big.sql", 3_000_000), ("a/b/page.html", 99), ("a/b/style.scss", 99), ("notes.md", 7), ("conf.toml", 7), ("x.tar.gz", 7), (".env", 7), ("src/main.go", 1), ("src/lib.rs", 1),
]
MANIFESTS = [
    ("package.json", '{"dependencies": {"React": "18", "next": "14", "Lib-@W": "1"}, "devDependencies": {"typescript": "5"}, "scripts": {"x": "y"}}'),
    ("requirements.txt", "fastapi>=0.1\nown-@W[x]>=2\n# note\n-r other.txt\nUvicorn[standard]==0.3 ; python_version > '3'\n  numpy ~= 1\n\npandas"),
    ("pyproject.toml", '[project]\ndependencies = [\n  "django>=4",\n  "tool_@W==3",\n  \'httpx[http2] < 1\',\n]\nname = "x"\npoetry = "^1"'),
    ("pom.xml", "<parent><artifactId>spring-boot-starter</artifactId></parent>"),
]
NAMED = "concat('d', CAST(doc_id AS STRING), '/', file)"
SIZED = "CASE WHEN least_size > 1000000 THEN least_size + n_chars ELSE n_chars END"
FILE_ROWS = f"(SELECT {NAMED} AS path, {SIZED} AS size FROM {picked_sql('documents', 'doc_id', NAMES, 'file, least_size')})"


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size_bytes and name: each document as a file of its own folder, with one of the fixed names."""
    own = picked(spark, sf_dir, "documents", "doc_id", NAMES, "file string, least_size long").selectExpr(f"{NAMED} AS path", f"{SIZED} AS size_bytes")
    return own.withColumn("name", F.element_at(F.split("path", "/"), -1))


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_LANGUAGE = "CASE " + " ".join(f"WHEN ext IN {_in(exts.split())} THEN '{lang}'" for lang, exts in V.LANGUAGES.items()) + " ELSE 'unknown' END"


@query(
    f"""WITH f AS (SELECT path, size, regexp_extract(path, '([^/]+)$', 1) AS name FROM {FILE_ROWS}), e AS (SELECT *, lower(regexp_extract(name, '.(\\.[^.]+)$', 1)) AS ext FROM f), l AS (SELECT *, {_LANGUAGE} AS language FROM e)
SELECT path, ext AS extension, language, CASE WHEN lower(name) IN {_in(V.CONFIG_NAMES)} THEN 'config' WHEN language IN ('html', 'xml', 'vue', 'svelte') THEN 'markup' WHEN language IN ('css', 'scss') THEN 'style' WHEN language IN ('json', 'yaml', 'toml') THEN 'data'
 WHEN language = 'markdown' THEN 'documentation' WHEN language = 'unknown' THEN 'other' ELSE 'source' END AS category,
 CASE WHEN lower(name) IN {_in(V.IGNORED_NAMES)} THEN 'ignored' WHEN name LIKE '.%' THEN 'hidden' WHEN ext IN {_in(V.BINARY_EXTENSIONS)} THEN 'binary' WHEN size > 2097152 THEN 'oversized' END AS skip_reason FROM l"""
)
def q35_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.classified(named_files(spark, sf_dir)).select("path", "extension", "language", "category", "skip_reason")


_BODY = "replace(body, '@W', CAST(doc_id AS STRING))"
_MANIFESTS = f"(SELECT name, {_BODY} AS body FROM {picked_sql('documents', 'doc_id', MANIFESTS, 'name, body')})"


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picked(spark, sf_dir, "documents", "doc_id", MANIFESTS, "name string, body string").selectExpr("name", f"{_BODY} AS text")


_DEPS = f"""deps AS (SELECT 'npm' AS ecosystem, lower(unnest(list_concat(json_keys(body->'dependencies'), coalesce(json_keys(body->'devDependencies'), []::VARCHAR[]), coalesce(json_keys(body->'peerDependencies'), []::VARCHAR[])))) AS name FROM {_MANIFESTS} WHERE name = 'package.json'
 UNION SELECT 'python', lower(trim(regexp_replace(trim(string_split(x, ';')[1]), '(==|>=|<=|~=|!=|>|<|\\[| ).*$', ''))) FROM (SELECT trim(unnest(string_split(body, chr(10)))) AS x FROM {_MANIFESTS} WHERE name = 'requirements.txt') WHERE x <> '' AND NOT regexp_matches(x, '^[#-]')
 UNION SELECT 'python', n FROM (SELECT lower(trim(regexp_replace(regexp_replace(x, '^["'']+|["'']+$', '', 'g'), '(==|>=|<=|~=|!=|>|<|\\[| |\\().*$', ''))) AS n FROM (SELECT trim(trim(unnest(string_split(body, chr(10)))), ',') AS x FROM {_MANIFESTS} WHERE name = 'pyproject.toml') WHERE regexp_matches(x, '^["'']')) WHERE regexp_matches(n, '^[a-z0-9_.-]+$'))"""


@query(f"WITH {_DEPS} SELECT ecosystem, name FROM deps WHERE name <> ''")
def q36_manifest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.manifest_names(_manifests(spark, sf_dir)).where("name <> ''")


_RULE_ROWS = [
    (i, name, kind, source, key, needle, weight)
    for i, (name, kind, npm, python, markers, needles) in enumerate(V.FRAMEWORKS)
    for source, key, needle, weight in [*(("npm", x, "", 0.9) for x in npm), *(("python", x, "", 0.9) for x in python), *(("file", x, "", 0.6) for x in markers), *(("text", x, n, 0.85) for x, n in needles)]
]


@query(
    f"""WITH {_DEPS}, have AS (SELECT ecosystem AS source, name AS key, '' AS body FROM deps UNION ALL SELECT 'file', name, lower(body) FROM {_MANIFESTS} UNION ALL SELECT 'text', name, lower(body) FROM {_MANIFESTS}),
m AS (SELECT rule, framework, category, source || ':' || key AS shown, weight FROM have JOIN {values(_RULE_ROWS, 'rule, framework, category, source, key, needle, weight')} r USING (source, key) WHERE needle = '' OR contains(body, needle)),
g AS (SELECT rule, framework, category, round(least(1.0, max(weight)::DOUBLE), 3) AS confidence, string_agg(DISTINCT shown, ',' ORDER BY shown) AS evidence FROM m GROUP BY ALL)
SELECT framework, category, confidence, evidence, row_number() OVER (ORDER BY confidence DESC, rule)::INT AS place FROM g"""
)
def q37_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.frameworks(_manifests(spark, sf_dir))


def _line_sql(language: str) -> str:
    ranks: dict[int, list[tuple[str, str]]] = {}
    for kind, rank, pattern in code.LINE_PATTERNS[language]:
        ranks.setdefault(rank, []).append((kind, pattern.replace("'", "''")))
    parts = []
    for group in ranks.values():
        cases = " ".join(f"WHEN regexp_matches(code, '{p}') THEN regexp_extract(code, '{p}', 1)" for _, p in group)
        parts.append(f"SELECT path, line, '{group[0][0]}' AS kind, CASE {cases} END AS name FROM rows")
    return f"WITH rows AS (SELECT path, unnest(string_split(body, chr(10))) AS code, generate_subscripts(string_split(body, chr(10)), 1)::INT AS line FROM {{source}}) SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE name IS NOT NULL"


def _sources(language: str) -> str:
    return f"(SELECT path, text AS body FROM ({FILES}) WHERE language = '{language}')"


@query(_line_sql("js").replace("{source}", _sources("tsx")))
def q38_js_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.line_symbols(source_files(spark, sf_dir).where("language = 'tsx'"), "js")


_N = f"(SELECT s.path, s.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n FROM ({FILES}) s JOIN documents d USING (doc_id) WHERE s.language = '@LANGUAGE')"


@query(
    f"WITH f AS {_N.replace('@LANGUAGE', 'python')} "
    + " UNION ALL ".join(
        f"SELECT path, '{kind}' AS kind, {name} AS name, {parent} AS parent, ({first})::BIGINT AS start_line, ({last})::BIGINT AS end_line, {exported} AS exported, {note} AS note FROM f"
        for kind, name, parent, first, last, exported, note in (
            ("import", "'os'", "NULL", "1", "1", "false", "''"), ("import", "'lib.tools'", "NULL", "2", "2", "false", "'helper_' || doc_id % 7"), ("function", "'load_' || doc_id", "NULL", "10", "13 + n", "true", "'cache'"),
            ("class", "'Box_' || doc_id", "NULL", "17 + n", "27 + n", "true", "'Base_' || doc_id % 7"), ("method", "'first'", "'Box_' || doc_id", "20 + n", "21 + n", "false", "''"), ("method", "'_second'", "'Box_' || doc_id", "24 + n", "27 + n", "false", "'property'"),
            ("constants", "'constants@4'", "NULL", "4", "5", "true", "''"), ("constants", "'constants@' || (29 + n)", "NULL", "29 + n", "29 + n", "true", "''"),
        )
    )
)
def q39_python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = source_files(spark, sf_dir).where("language = 'python'")
    symbols = code.python_symbols(own)
    constants = code.constant_groups(own, symbols).select("path", F.lit("constants").alias("kind"), F.concat(F.lit("constants@"), F.col("start_line").cast("string")).alias("name"), F.lit(None).cast("string").alias("parent"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.lit(True).alias("exported"), F.lit("").alias("note"))
    return symbols.unionByName(constants)


@query(
    f"WITH f AS {_N.replace('@LANGUAGE', 'java')} "
    + " UNION ALL ".join(
        f"SELECT path, '{kind}' AS kind, {name} AS name, ({first})::INT AS line, ({last})::INT AS end_line, {owner} AS owner FROM f"
        for kind, name, first, last, owner in (("class", "'I' || doc_id", "2", "4", "NULL"), ("class", "'K' || doc_id", "5", "11 + n", "NULL"), ("function", "'f' || doc_id % 7", "6 + n", "9 + n", "'K' || doc_id"), ("function", "'g'", "10 + n", "10 + n", "'K' || doc_id"))
    )
)
def q40_block_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = source_files(spark, sf_dir).where("language = 'java'")
    symbols = code.block_ends(code.line_symbols(own, "java").where("kind <> 'import'"), own)
    held = code.owners(symbols.where("kind = 'function'"), symbols.where("kind = 'class'"))
    return symbols.join(held, ["path", "line", "name"], "left").select("path", "kind", "name", "line", "end_line", "owner")


#: What an edit does to a document: nothing before it, a new line before and after, nothing after it, another place, and the same.
_ACTIONS = [("create_file",), ("modify_file",), ("delete_file",), ("move_file",), ("modify_file",)]


@query()
def q41_edit_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = picked(spark, sf_dir, "documents", "doc_id", _ACTIONS, "action string").withColumn("text", F.coalesce("text", F.lit("")))
    folder = F.when(F.col("doc_id") % 7 == 0, "config/").otherwise("src/")
    before = F.when(F.col("action") == "create_file", "").otherwise(F.col("text"))
    added = F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("first\n"), F.col("text"), F.lit("\n"), F.col("doc_id").cast("string"))).otherwise(F.col("text"))
    path = F.concat(folder, F.col("doc_id").cast("string"), F.lit(".txt"))
    own = docs.select(F.col("doc_id").alias("id"), "action", path.alias("path"), F.concat(F.lit("moved/"), path).alias("target_path"), before.alias("before"), F.when(F.col("action") != "delete_file", added).alias("after"))
    return edits.diffs(own).select("id", "added", "removed", "risk", "diff")
