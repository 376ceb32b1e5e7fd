"""Intents and routes of what conversations ask, some of it after fixed openings, and models of parts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import vocabulary as V
from spindle.functions.rules import Sql, SqlText, cases_sql, intent_rules
from spindle.operators import classify, routing
from spindle.plans.chats import analysis_sql
from spindle.plans.registry import picked, picked_sql, query, values
from spindle.session import stored

PROMPTS = [
    "", "Hi", "hello there, can you help", "thanks a lot", "How are you today?", "tell me a joke about cats", "joke please", "guide to information",
    "Translate this paper to German", "say it in french", "Summarize the article", "summary in one sentence", "give me the key points", "fix the bug in my parser",
    "debug the entire distributed system", "why does it not work", "write a haiku about rain", "write a novel about a dog", "compose a song", "prove the theorem",
    "12 + 30 = ?", "solve the equation with calculus", "literature review on caching", "design a scalable system", "explain the trade-off", "Build a website",
    "write a python function", "hello world in rust", "print hello world in java", "C++ templates", "c# class for orders", "explain recursion in depth", "what is gravity and why does it work",
    "deploy the app to kubernetes", "continue", "again", "go on", "explain again", "do the same", "add authentication to the app", "now add tests", "tl;dr", "reactive apples",
    "create a chatbot", "make a regex", "écrire une app", "  spaced   out  ", "compare python vs java", "who is ada lovelace", "improve it", "random thoughts",
]
#: A message is asked as an opening alone, an opening and the message, or the message.
_ASK = "CASE (conv_id + turn) % 3 WHEN 0 THEN opening WHEN 1 THEN concat(opening, ' ', coalesce(text, '')) ELSE coalesce(text, '') END"
_PICK = "conv_id * 7 + turn"
_PROMPTS = f"(SELECT conv_id, turn, {_ASK} AS prompt FROM {picked_sql('conversations', _PICK, [(x,) for x in PROMPTS], 'opening')})"
_RULES = intent_rules(SqlText("t"), Sql("n <= 3"))
_INTENT = cases_sql([(c, i) for c, i, *_ in _RULES], "general_chat")
_COMPLEXITY = cases_sql([(c, Sql(cases_sql(inner, other)) if inner else other) for c, _, inner, other, _ in _RULES], "medium")
_CONFIDENCE = "CASE " + " ".join(f"WHEN {c} THEN {sure}::DOUBLE" for c, *_, sure in _RULES) + " ELSE 0.3::DOUBLE END"


_TOLD = f"""SELECT conv_id, turn, {_INTENT} AS intent, {_COMPLEXITY} AS complexity, {_CONFIDENCE} AS confidence, length(prompt) > 300 AS long_context
FROM (SELECT *, len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) AS n FROM (SELECT *, regexp_replace(lower(prompt), '^\\s+|\\s+$', '', 'g') AS t FROM {_PROMPTS}))"""
_GRID = f"({_TOLD})"


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picked(spark, sf_dir, "conversations", _PICK, [(x,) for x in PROMPTS], "opening string").selectExpr("conv_id", "turn", f"{_ASK} AS prompt")


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """intent, complexity, confidence and long_context of every message, as it is asked."""
    return stored(classify.intents(_prompts(spark, sf_dir)).withColumn("long_context", F.length("prompt") > 300).drop("prompt"))


@query(f"SELECT conv_id, turn, intent, complexity, confidence FROM {_GRID}")
def q21_intent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir).select("conv_id", "turn", "intent", "complexity", "confidence")


@query(
    f"""WITH g AS (SELECT conv_id, turn, confidence, intent, complexity, CASE WHEN intent IN ('summarization', 'translation') THEN CASE WHEN complexity = 'low' THEN 'small' ELSE 'medium' END WHEN complexity = 'high' THEN 'large' WHEN complexity = 'low' THEN 'small' ELSE 'medium' END AS estimated_output FROM {_GRID}),
h AS (SELECT *, estimated_output = 'large' OR (intent IN ('summarization', 'document_analysis', 'research') AND complexity <> 'low') AS requires_long_context FROM g)
SELECT conv_id, turn, estimated_output, intent IN ('coding', 'debugging') AS requires_code, complexity = 'high' OR intent IN ('reasoning', 'mathematics', 'research') AS requires_reasoning, requires_long_context, complexity = 'low' AND NOT requires_long_context AS offline_possible, confidence < 0.85 AS needs_model FROM h"""
)
def q22_enrich_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = classify.needs_model(classify.enriched(_told(spark, sf_dir)))
    return told.select("conv_id", "turn", "estimated_output", "requires_code", "requires_reasoning", "requires_long_context", "offline_possible", "needs_model")


_PROVIDER = """CASE WHEN intent IN ('coding', 'debugging') THEN CASE WHEN complexity = 'low' THEN 'ollama' WHEN complexity = 'medium' THEN 'groq' WHEN long_context THEN 'gemini' ELSE 'groq' END
 WHEN intent IN ('reasoning', 'mathematics', 'education', 'creative_writing') THEN CASE WHEN complexity = 'low' THEN 'ollama' ELSE 'gemini' END
 WHEN intent IN ('summarization', 'document_analysis', 'translation') THEN CASE WHEN complexity = 'low' AND NOT long_context THEN 'ollama' ELSE 'gemini' END
 WHEN intent = 'research' THEN 'gemini' WHEN complexity = 'high' THEN 'gemini' ELSE 'ollama' END"""


@query(
    f"""WITH g AS (SELECT *, {_PROVIDER} AS provider, intent IN ('coding', 'debugging') AS c, complexity = 'high' OR intent IN ('reasoning', 'mathematics', 'research') AS r FROM {_GRID}),
n AS (SELECT *, list_filter([CASE WHEN c THEN 'strong code generation' END, CASE WHEN r THEN 'deep reasoning' END, CASE WHEN long_context THEN 'a large context window' END], lambda x: x IS NOT NULL) AS needs FROM g)
SELECT conv_id, turn, provider, CASE complexity WHEN 'high' THEN 'Large-scale' WHEN 'medium' THEN 'Moderate' ELSE 'Simple' END || ' ' || replace(intent, '_', ' ') || ' task '
 || CASE len(needs) WHEN 0 THEN '' WHEN 1 THEN 'requiring ' || needs[1] || ' ' WHEN 2 THEN 'requiring ' || needs[1] || ' and ' || needs[2] || ' ' ELSE 'requiring ' || needs[1] || ', ' || needs[2] || ', and ' || needs[3] || ' ' END
 || CASE provider WHEN 'ollama' THEN '— handled locally for speed' WHEN 'gemini' THEN '— routed to Google Gemini' ELSE '— routed to Groq' END || '.' AS reason FROM n"""
)
def q23_route_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = classify.enriched(_told(spark, sf_dir)).withColumn("requires_long_context", F.col("long_context"))
    told = told.withColumn("provider", routing.provider(F.col("intent"), F.col("complexity"), F.col("long_context")))
    return told.select("conv_id", "turn", "provider", routing.reason(told).alias("reason"))


PROVIDERS = [("groq", False, "llama-3.1-8b-instant"), ("gemini", True, None), ("cloudflare", True, "@cf/google/gemma-7b-it"), ("ollama", True, "qwen3:4b")]


@query(
    f"""WITH g AS (SELECT conv_id * 100000 + turn AS id, {_PROVIDER} AS p FROM {_GRID}), c AS (SELECT id, list_concat([p], list_filter(['groq', 'gemini', 'cloudflare', 'ollama'], lambda x: x <> p)) AS chain FROM g),
e AS (SELECT id, array_to_string(chain, ',') AS shown, unnest(chain) AS provider, generate_subscripts(chain, 1) AS pos FROM c)
SELECT id, any_value(shown) AS chain, arg_min(provider, pos) FILTER (WHERE connected AND model IS NOT NULL) AS provider, arg_min(model, pos) FILTER (WHERE connected AND model IS NOT NULL) AS model FROM e LEFT JOIN {values(PROVIDERS, 'provider, connected, model')} USING (provider) GROUP BY id"""
)
def q24_failover_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _told(spark, sf_dir).withColumn("id", F.col("conv_id") * 100000 + F.col("turn")).withColumn("chain", routing.failover(routing.provider(F.col("intent"), F.col("complexity"), F.col("long_context"))))
    providers = spark.createDataFrame(PROVIDERS, "provider string, connected boolean, model string")
    return asked.select("id", F.concat_ws(",", "chain").alias("chain")).join(routing.first_connected(asked, providers), "id")


_NOON = dt.datetime(2025, 1, 1, 12)
_WANTED = [(p, m) for p, names in V.PREFERRED_MODELS.items() for m in names]
_OTHERS = [(p, "") for p in V.PREFERRED_MODELS]
#: Parts as models: the first ones have the names that are preferred, all others their own.
_MODELS = (
    f"(SELECT CASE WHEN p_partkey <= {len(_WANTED)} THEN w.provider ELSE o.provider END AS provider, CASE WHEN p_partkey <= {len(_WANTED)} THEN w.name ELSE 'model-' || p_partkey END AS model, p_partkey AS ordinal, p_size % 3 <> 0 AS validated, p_size AS age, p_partkey % 5 <> 0 AS tested"
    f" FROM part JOIN {values([(i, *r) for i, r in enumerate(_WANTED)], 'pick, provider, name')} w ON w.pick = (p_partkey - 1) % {len(_WANTED)} JOIN {values([(i, *r) for i, r in enumerate(_OTHERS)], 'pick, provider, name')} o ON o.pick = p_partkey % {len(_OTHERS)})"
)
_PREFERENCE = values([(p, m, i) for p, names in V.PREFERRED_MODELS.items() for i, m in enumerate(names)], "provider, model, pref")


@query(
    f"""WITH t AS (SELECT m.*, coalesce(validated AND age <= 30, false) AS good, coalesce(NOT validated, false) AS bad FROM (SELECT provider, model, ordinal FROM {_MODELS}) m LEFT JOIN (SELECT provider, model, validated, age FROM {_MODELS} WHERE tested) v USING (provider, model)),
u AS (SELECT *, NOT bad OR bool_and(bad) OVER (PARTITION BY provider) AS usable FROM t), w AS (SELECT *, bool_or(good AND usable) OVER (PARTITION BY provider) AS has_any FROM u)
SELECT provider, arg_min(w.model, (coalesce(pref, 999), ordinal)) AS model FROM w LEFT JOIN {_PREFERENCE} p USING (provider, model) WHERE usable AND (good OR NOT has_any) GROUP BY provider"""
)
def q25_model_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.selected_models(*_parts_as_models(spark, sf_dir), F.timestamp_seconds(F.lit(int(_NOON.replace(tzinfo=dt.UTC).timestamp()))))


def _parts_as_models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Models and their latest tests."""
    wanted = picked(spark, sf_dir, "part", "p_partkey - 1", _WANTED, "wanted string, name string")
    fixed = F.element_at(F.array(*[F.lit(p) for p, _ in _OTHERS]), (F.col("p_partkey") % len(_OTHERS) + 1).cast("int"))
    first = F.col("p_partkey") <= len(_WANTED)
    model = F.when(first, F.col("name")).otherwise(F.concat(F.lit("model-"), F.col("p_partkey").cast("string")))
    models = wanted.select(F.when(first, F.col("wanted")).otherwise(fixed).alias("provider"), model.alias("model"), F.col("p_partkey").alias("ordinal"), "p_size")
    tested = models.where("ordinal % 5 <> 0").select("provider", "model", (F.col("p_size") % 3 != 0).alias("validated"), F.timestamp_seconds(F.lit(int(_NOON.replace(tzinfo=dt.UTC).timestamp())) - F.col("p_size") * 60).alias("last_tested"))
    return models.drop("p_size"), tested


@query(analysis_sql("conv_id, turn", "prompt", _PROMPTS))
def q51_prompt_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.analyzed(_prompts(spark, sf_dir), "prompt").select("conv_id", "turn", "domain", "is_followup", "is_new_topic", "n_words")
