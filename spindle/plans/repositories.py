"""Queries over repositories as wholes, providers, answers' confidences and prompts of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import text as T
from spindle.functions import vocabulary as V
from spindle.operators import classify, context, conversation, routing
from spindle.plans.code import _LANGUAGE, NAMED, NAMES, SIZED, _in
from spindle.plans.registry import picked, picked_sql, query, table, values
from spindle.plans.routes import _MODELS, _NOON, _parts_as_models
from spindle.plans.search import _PROMPT, _prompts
from spindle.sources import files

_OWN = ("coalesce(source, '') AS repository", f"{NAMED} AS path", f"{SIZED} AS size_bytes", "coalesce(text, '') AS text", "doc_id")
_FILES = f"""WITH f AS (SELECT {", ".join(_OWN)} FROM {picked_sql("documents", "doc_id", NAMES, "file, least_size")}), n AS (SELECT *, regexp_extract(path, '([^/]+)$', 1) AS name FROM f),
e AS (SELECT *, lower(regexp_extract(name, '.(\\.[^.]+)$', 1)) AS ext, text = '' AS bad, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 0 ELSE 1 END)::BIGINT AS n_lines FROM n),
l AS (SELECT *, {_LANGUAGE} AS language, CASE WHEN lower(name) IN {_in(V.IGNORED_NAMES)} OR name LIKE '.%' OR ext IN {_in(V.BINARY_EXTENSIONS)} THEN 'ignored' WHEN size_bytes > 2097152 THEN 'oversized' END AS why FROM e),
d AS (SELECT *, string_split(path, '/') AS parts FROM l), u AS (SELECT repository, unnest(list_concat(['.'], list_transform(range(1, len(parts)), lambda i: array_to_string(parts[1:i], '/')))) AS directory FROM d)"""
_SHOWN = "string_agg(language || '=' || n, ',' ORDER BY language || '=' || n)"


def _repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file of the repository that its source names; one without text counts as not parsed."""
    own = picked(spark, sf_dir, "documents", "doc_id", NAMES, "file string, least_size long").selectExpr(*_OWN)
    own = own.withColumns({"name": F.element_at(F.split("path", "/"), -1), "n_lines": T.line_count(F.col("text")), "parse_error": F.col("text") == ""})
    return files.classified(own.drop("text"))


@query(
    _FILES
    + f""", g AS (SELECT repository, {_SHOWN} AS languages FROM (SELECT repository, language, count(*) AS n FROM l WHERE why IS NULL GROUP BY ALL) GROUP BY repository)
SELECT repository, count(*) FILTER (WHERE why IS NULL) AS files, count(*) FILTER (WHERE why IS NULL AND language <> 'unknown') AS supported, count(*) FILTER (WHERE why IS NULL AND NOT bad AND language IN {_in(V.PARSED_LANGUAGES)}) AS parsed, count(*) FILTER (WHERE why IS NULL AND bad) AS failed,
 count(why) AS ignored, coalesce(sum(size_bytes) FILTER (WHERE why IS NULL), 0)::BIGINT AS bytes, coalesce(sum(n_lines) FILTER (WHERE why IS NULL), 0)::BIGINT AS lines, arg_min(path, (-size_bytes, path)) FILTER (WHERE why IS NULL) AS largest,
 any_value(coalesce(languages, '')) AS languages, coalesce(round(avg(size_bytes) FILTER (WHERE why IS NULL), 2), 0) AS mean_bytes, any_value((SELECT count(DISTINCT directory) FROM u WHERE u.repository = l.repository)) AS directories FROM l LEFT JOIN g USING (repository) GROUP BY repository"""
)
def q76_repository_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.repository_rows(_repository_files(spark, sf_dir))


@query(
    _FILES
    + f""", c AS (SELECT repository, CASE WHEN len(parts) = 1 THEN '.' ELSE array_to_string(parts[1:len(parts) - 1], '/') END AS directory, language, count(*) AS n FROM d WHERE why IS NULL GROUP BY ALL),
g AS (SELECT repository, directory, sum(n)::BIGINT AS files, {_SHOWN} AS languages FROM c GROUP BY ALL), a AS (SELECT DISTINCT repository, directory FROM u),
s AS (SELECT repository, CASE WHEN directory LIKE '%/%' THEN regexp_extract(directory, '^(.*)/[^/]*$', 1) ELSE '.' END AS directory, count(*) AS subdirectories FROM a WHERE directory <> '.' GROUP BY ALL)
SELECT repository, directory, coalesce(files, 0) AS files, coalesce(subdirectories, 0) AS subdirectories, coalesce(languages, '') AS languages FROM a LEFT JOIN g USING (repository, directory) LEFT JOIN s USING (repository, directory)"""
)
def q77_directory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.directory_rows(_repository_files(spark, sf_dir))


@query(_FILES + " SELECT repository, count(*) FILTER (WHERE why IS NULL) AS accepted, count(*) FILTER (WHERE why = 'ignored') AS ignored, count(*) FILTER (WHERE why = 'oversized') AS oversized, 0::BIGINT AS permission_errors FROM l GROUP BY repository")
def q78_scan_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scan_tally(_repository_files(spark, sf_dir))


@query(
    "WITH c AS (SELECT source AS repository, lang AS language, count(*) AS files, min(doc_id) AS first FROM documents GROUP BY ALL) SELECT repository, language, files, row_number() OVER (PARTITION BY repository ORDER BY CASE WHEN language IN ('de', 'fr') THEN 0 ELSE 1 END, files DESC, first)::INT AS place FROM c"
)
def q79_repository_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("repository"), F.col("lang").alias("language"), F.col("doc_id").alias("ordinal"))
    return files.languages_ranked(docs, ("de", "fr"), ("repository",))


RECORDS = [("groq", True), ("gemini", False), ("elsewhere", True), ("ollama", True)]


@query(
    f"""WITH k AS (SELECT l.provider, name, coalesce(connected, false) AS connected FROM {values(list(V.PROVIDER_LABELS.items()), "provider, name")} l LEFT JOIN {values(RECORDS, "provider, connected")} r USING (provider)),
o AS (SELECT m.provider, model, ordinal FROM {_MODELS} m JOIN k USING (provider) WHERE NOT connected OR (tested AND validated AND age <= 30)) SELECT provider, name, connected, model, ordinal FROM k LEFT JOIN o USING (provider)"""
)
def q80_provider_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spark.createDataFrame(RECORDS, "provider string, connected boolean")
    return routing.provider_status(records, *_parts_as_models(spark, sf_dir), F.lit(_NOON.isoformat(sep=" ") + "+00:00").cast("timestamp"))


_KINDS = ("whisper-large", "text-Embedding", "vision", "aqa", "translation", "chat", "audio", "experimental", "embed")
_NAMED_MODELS = f"SELECT p_partkey, {{pick}} AS provider, concat({{kind}}, '-', CAST(p_partkey AS STRING)) AS model FROM {{source}}"
_PICKS = {
    "pick": "CASE " + " ".join(f"WHEN p_partkey % 5 = {i} THEN '{p}'" for i, p in enumerate(V.UNSUITED_MODELS)) + " ELSE 'other' END",
    "kind": "CASE " + " ".join(f"WHEN p_size % {len(_KINDS)} = {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END",
}
_UNSUITED = " OR ".join(f"(provider = '{p}' AND contains(lower(model), '{x}'))" for p, parts in V.UNSUITED_MODELS.items() for x in parts)


@query(f"SELECT * FROM ({_NAMED_MODELS.format(source='part', **_PICKS)}) WHERE NOT ({_UNSUITED})")
def q81_suited_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_PICKS['pick']} AS provider", f"concat({_PICKS['kind']}, '-', CAST(p_partkey AS STRING)) AS model")
    return routing.suited_models(models)


ANSWERS = [('0.@N',), ('"High"',), ("true",), ('"0.3@N"',), ("null",), ("@N",), ("-1",), ('"  medium "',), ('"1e-1"',), ('"0.5f"',), ("[1]",), ('"sure"',), ("low",)]
_ANSWER = "replace(answer, '@N', CAST(n_chars AS STRING))"


@query(
    f"""WITH a AS (SELECT doc_id, {_ANSWER} AS v FROM {picked_sql("documents", "doc_id", ANSWERS, "answer")}), t AS (SELECT doc_id, v LIKE '"%' AS quoted, lower(trim(replace(v, '"', ''))) AS w FROM a)
SELECT doc_id, CASE WHEN quoted AND w = 'high' THEN 0.9 WHEN quoted AND w = 'medium' THEN 0.7 WHEN quoted AND w = 'low' THEN 0.4 WHEN regexp_full_match(w, '[+-]?[0-9.]+(e[+-]?[0-9]+)?') THEN greatest(0, least(1, w::DOUBLE)) ELSE 0.7 END::DOUBLE AS confidence FROM t"""
)
def q82_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = picked(spark, sf_dir, "documents", "doc_id", ANSWERS, "answer string").selectExpr("doc_id", f"{_ANSWER} AS value")
    return told.select("doc_id", classify.confidence(F.col("value")).alias("confidence"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '-' || (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS client_id FROM events")
def q83_client_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return conversation.client_ids(table(spark, sf_dir, "events"), "user_id", made, "event_id").select("event_id", "client_id")


_TASK_NAMES = [*context.TASKS, "unheard_of"]
_TASK_ROWS = [(i, n, "\n\n".join([r, "Task: " + t, context.RULES, x])) for i, n in enumerate(_TASK_NAMES) for r, t, x in [context.TASKS.get(n, context.TASKS[context.GENERAL])]]
_SUMMARY = "concat('vectors near ', CAST({} AS STRING), '.')"


@query(
    _PROMPT
    + f""", s AS (SELECT query_id, CASE task WHEN 'unheard_of' THEN '{context.GENERAL}' ELSE task END AS task, system, '# Repository: vectors' || chr(10) || chr(10) || 'Summary: ' || {_SUMMARY.format("query_id")} || chr(10) || chr(10) || prompt AS usr
 FROM t JOIN {values(_TASK_ROWS, "pick, task, system")} k ON k.pick = (query_id // 50) % {len(_TASK_ROWS)}) SELECT query_id, task, sha256(system) AS system_hash, sha256(usr) AS user_hash, greatest(1, (length(system) + 2 + length(usr)) // 4) AS tokens FROM s"""
)
def q84_task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = _prompts(spark, sf_dir)
    names = F.array(*map(F.lit, _TASK_NAMES))
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit("vectors").alias("repository"), F.expr(_SUMMARY.format("vec_id")).alias("summary"))
    asked = asked.withColumn("task", F.element_at(names, (F.floor(F.col("query_id") / 50) % len(_TASK_NAMES) + 1).cast("int")))
    return context.task_prompts(prompts, asked).select("query_id", "task", T.content_hash(F.col("system")).alias("system_hash"), T.content_hash(F.col("user")).alias("user_hash"), "tokens")
