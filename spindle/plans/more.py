"""Smaller operators: statistics, relations, applied plans, imports, packets and figures for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import text as T
from spindle.operators import code, context, edits, imports, retrieval
from spindle.plans.code import FILE_ROWS, named_files
from spindle.plans.registry import picked, picked_sql, query, table, values
from spindle.plans.sources import COLUMNS, FILES
from spindle.sources import files


_NAMED = f"(SELECT path, size, regexp_extract(path, '([^/]+)$', 1) AS name FROM {FILE_ROWS})"
_BAD = "(lower(name) IN ('package-lock.json') OR name LIKE '.%' OR lower(name) LIKE '%.png' OR lower(name) LIKE '%.gz' OR size > 2097152)"


@query(
    f"SELECT count(*) AS files, count(*) FILTER (WHERE NOT {_BAD}) AS accepted, count(*) FILTER (WHERE {_BAD}) AS skipped, (sum(size) FILTER (WHERE NOT {_BAD}))::BIGINT AS bytes, round(avg(size) FILTER (WHERE NOT {_BAD}), 2) AS mean_bytes, arg_min(path, (-size, path)) FILTER (WHERE NOT {_BAD}) AS largest FROM {_NAMED}"
)
def q52_repository_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.repository_statistics(files.classified(named_files(spark, sf_dir)))


@query(
    "WITH h AS (SELECT doc_id % 10 AS query_id, doc_id AS chunk, 's' || (doc_id % 37) AS symbol, doc_id AS ordinal FROM documents), e AS (SELECT doc_id AS chunk, 'depends_on' AS relation, 's' || (doc_id * 7 % 41) AS symbol FROM documents),"
    " t AS (SELECT query_id, symbol, arg_max(chunk, ordinal) AS target FROM h GROUP BY ALL) SELECT h.query_id, h.chunk, relation, e.symbol, target FROM h JOIN e USING (chunk) LEFT JOIN t ON t.query_id = h.query_id AND t.symbol = e.symbol"
)
def q53_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = lambda c: F.concat(F.lit("s"), c.cast("string"))
    hits = docs.select((F.col("doc_id") % 10).alias("query_id"), F.col("doc_id").alias("chunk"), named(F.col("doc_id") % 37).alias("symbol"), F.col("doc_id").alias("ordinal"))
    edges = docs.select(F.col("doc_id").alias("chunk"), F.lit("depends_on").alias("relation"), named(F.col("doc_id") * 7 % 41).alias("symbol"))
    return retrieval.related(hits, edges)


#: What files of a language import, by the language's place among the templates; the document's number stands for @ID, what is left of it by seven for @M.
IMPORTS = [(0, "lib.tools", "helper_@M,unused"), (0, "os", ""), (1, "react", "React,View_@ID"), (2, "java.util.List", "String,Map"), (3, "fmt", "")]
_FILLED = "replace(replace(names, '@ID', CAST(doc_id AS STRING)), '@M', CAST(doc_id % 7 AS STRING))"


@query(
    f"WITH f AS ({FILES}), u AS (SELECT path AS chunk_id, path, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*'))) AS name FROM f),"
    f" b AS (SELECT path, module, unnest(CASE WHEN names = '' THEN [regexp_extract(module, '([^./]+)$', 1)] ELSE string_split(names, ',') END) AS name FROM (SELECT path, module, {_FILLED} AS names FROM f JOIN {values(IMPORTS, 'family, module, names')} i ON doc_id % 6 = family)) SELECT chunk_id, name, module FROM u JOIN b USING (path, name)"
)
def q54_chunk_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").selectExpr(*COLUMNS, "doc_id")
    fixed = F.broadcast(spark.createDataFrame(IMPORTS, "family int, module string, names string"))
    bound = own.join(fixed, F.col("doc_id") % 6 == F.col("family")).selectExpr("path", "module", f"{_FILLED} AS names")
    bound = bound.withColumn("names", F.filter(F.split("names", ","), lambda x: x != ""))
    return code.dependencies(own.select(F.col("path").alias("chunk_id"), "path", F.col("text").alias("content")), bound)


@query(
    "WITH e AS (SELECT doc_id, doc_id || '.txt' AS path, list_element(['create_file', 'modify_file', 'delete_file', 'move_file'], (doc_id % 4)::INT + 1) AS action, CASE WHEN doc_id % 4 = 3 THEN (doc_id * 3 % 1500) || '.txt' END AS target, CASE WHEN doc_id % 5 = 0 THEN sha256('other') WHEN doc_id % 5 = 1 THEN sha256(text) END AS expected FROM documents),"
    " f AS (SELECT doc_id || '.txt' AS path, sha256(text) AS hash FROM documents WHERE doc_id % 3 <> 0)"
    " SELECT doc_id, CASE WHEN action = 'create_file' AND f.path IS NOT NULL THEN 'conflict' WHEN action <> 'create_file' AND f.path IS NULL THEN 'missing' WHEN expected IS NOT NULL AND expected <> f.hash THEN 'conflict' WHEN g.path IS NOT NULL THEN 'conflict' ELSE 'applied' END AS status FROM e LEFT JOIN f USING (path) LEFT JOIN f g ON g.path = e.target"
)
def q55_apply_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    action = F.element_at(F.array(*map(F.lit, edits.ACTIONS)), (F.col("doc_id") % 4 + 1).cast("int"))
    target = F.when(F.col("doc_id") % 4 == 3, F.concat((F.col("doc_id") * 3 % 1500).cast("string"), F.lit(".txt")))
    expected = F.when(F.col("doc_id") % 5 == 0, T.content_hash(F.lit("other"))).when(F.col("doc_id") % 5 == 1, T.content_hash(F.col("text")))
    plan = docs.select("doc_id", path.alias("path"), action.alias("action"), target.alias("target_path"), expected.alias("expected_hash"))
    return edits.apply_plan(plan, docs.where("doc_id % 3 <> 0").select(path.alias("path"), "text")).select("doc_id", "status")


@query("SELECT conv_id, greatest(128, 420 * count(*)) AS tokens, count(*) FILTER (WHERE role = 'user') AS used, round(max(turn) * 100.0::DOUBLE / count(*), 0)::BIGINT AS percent FROM conversations GROUP BY conv_id")
def q56_display_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = table(spark, sf_dir, "conversations").groupBy("conv_id")
    return chat.agg(F.greatest(F.lit(128), 420 * F.count("*")).alias("tokens"), F.count_if(F.col("role") == "user").alias("used"), F.round(F.max("turn") * 100.0 / F.count("*"), 0).cast("long").alias("percent"))


MODULES = [("app@K.services.x", False), ("@scope/pkg@K/sub", False), ("@/lib/utils", False), ("d@K-dom/client", False), ("./here@K", True), ("d@K/lib", False), ("d@K", False), ("os.path", False), ("d@K.App", False)]
_MODULE = "replace(module, '@K', CAST(doc_id * 2 AS STRING))"


@query(
    f"WITH m AS (SELECT doc_id, {_MODULE} AS module, is_relative FROM {picked_sql('documents', 'doc_id', MODULES, 'module, is_relative')}), s AS (SELECT *, CASE WHEN module LIKE '@%' AND contains(module, '/') THEN array_to_string(string_split(module, '/')[1:2], '/') WHEN contains(module, '/') THEN string_split(module, '/')[1] ELSE string_split(module, '.')[1] END AS segment FROM m),"
    f" n AS (SELECT DISTINCT string_split(path, '/')[1] AS name FROM {FILE_ROWS}) SELECT doc_id, module, segment, NOT (is_relative OR segment IN (SELECT name FROM n)) AS is_external FROM s"
)
def q57_import_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = picked(spark, sf_dir, "documents", "doc_id", MODULES, "module string, is_relative boolean").selectExpr("doc_id", f"{_MODULE} AS module", "is_relative")
    return imports.located(own, named_files(spark, sf_dir)).select("doc_id", "module", "segment", "is_external")


@query("SELECT doc_id, i::INT AS part, substr(text, i * 48 + 1, 48) AS piece FROM documents, LATERAL (SELECT unnest(generate_series(0, greatest((length(text) - 1) // 48, 0))) AS i)")
def q58_fixed_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = F.greatest(F.floor((F.length("text") - 1) / 48), F.lit(0)).cast("int")
    return docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("part")).select("doc_id", "part", F.substring(F.col("text"), F.col("part") * 48 + 1, F.lit(48)).alias("piece"))


WINDOWS = [("8k",), ("16k",), ("128k",), ("odd",), ("",)]


@query(
    f"""SELECT doc_id, greatest(256, floor(CASE w WHEN '8k' THEN 8192 WHEN '16k' THEN 16384 WHEN '128k' THEN 131072 WHEN 'odd' THEN 16384 ELSE greatest(1024, n_chars) END * 0.75::DOUBLE)::BIGINT - 700) AS budget FROM {picked_sql('documents', 'doc_id', WINDOWS, 'w')}"""
)
def q59_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = picked(spark, sf_dir, "documents", "doc_id", WINDOWS, "w string")
    return own.select("doc_id", context.budget_column(F.when(F.col("w") == "", F.col("n_chars").cast("string")).otherwise(F.col("w"))).alias("budget"))


SYMBOLS = [("python", "__init__", False, ""), ("python", "__x", True, ""), ("python", "_x", False, ""), ("python", "x", False, ""), ("tsx", "_h", True, ""), ("tsx", "App", True, ""), ("jsx", "app", False, ""), ("java", "f", False, "private int f"), ("csharp", "g", False, "int g"), ("java", "h", False, "public h"), ("go", "Éa", False, ""), ("go", "ea", True, ""), ("rust", "r", False, " pub fn r"), ("rust", "s", True, "fn s"), ("sql", "t", True, "")]


_ENDED = [(lang, name.removesuffix("__") if name.startswith("__i") else name, "__" if name.startswith("__i") else "", exported, decl) for lang, name, exported, decl in SYMBOLS]


@query(
    f"""SELECT doc_id, language, name, CASE WHEN language = 'python' THEN CASE WHEN regexp_matches(name, '^__.*__$') THEN 'public' WHEN starts_with(name, '__') THEN 'private' WHEN starts_with(name, '_') THEN 'protected' ELSE 'public' END
WHEN language IN ('javascript', 'jsx', 'typescript', 'tsx') THEN CASE WHEN regexp_matches(name, '^[#_]') THEN 'private' WHEN exported THEN 'public' ELSE 'internal' END
WHEN language IN ('java', 'csharp') THEN CASE WHEN contains(decl, 'private') THEN 'private' WHEN contains(decl, 'protected') THEN 'protected' WHEN contains(decl, 'public') THEN 'public' ELSE 'internal' END
WHEN language = 'go' THEN CASE WHEN regexp_matches(name, '^\\p{{Lu}}') THEN 'public' ELSE 'internal' END WHEN language = 'rust' THEN CASE WHEN starts_with(trim(decl), 'pub') THEN 'public' ELSE 'private' END
ELSE CASE WHEN exported THEN 'public' ELSE 'internal' END END AS visibility FROM (SELECT doc_id, language, concat(name, CAST(doc_id AS STRING), tail) AS name, exported, decl FROM {picked_sql('documents', 'doc_id', _ENDED, 'language, name, tail, exported, decl')})"""
)
def q60_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = picked(spark, sf_dir, "documents", "doc_id", _ENDED, "language string, name string, tail string, exported boolean, decl string").withColumn("name", F.concat("name", F.col("doc_id").cast("string"), "tail"))
    return own.select("doc_id", "language", "name", imports.visibility(F.col("language"), F.col("name"), F.col("exported"), F.col("decl")).alias("visibility"))
