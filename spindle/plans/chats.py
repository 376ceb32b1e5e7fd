"""Conversations: words, similarity, relevance, threads, facts; upserts over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.functions import text as T
from spindle.functions import vocabulary as V
from spindle.functions.rules import SqlText, cases_sql, domain_rules
from spindle.operators import classify, conversation, storage
from spindle.plans.registry import query, table


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def words_sql(column: str, topic: bool = False) -> str:
    stop = _list([*V.STOP_WORDS, *(V.FOLLOW_UP_WORDS if topic else ())])
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({column}), '[a-z0-9+#.]+'), lambda t: length(t) > 2 AND NOT list_contains({stop}, t))))"


def _blend_sql(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    overlap = f"(CASE WHEN {common} = 0 THEN 0.0::DOUBLE ELSE {common}::DOUBLE / least(len({a}), len({b})) END)"
    jaccard = f"(CASE WHEN {common} = 0 THEN 0.0::DOUBLE ELSE {common}::DOUBLE / (len({a}) + len({b}) - {common}) END)"
    return f"(0.5::DOUBLE * {jaccard} + 0.5::DOUBLE * {overlap})", overlap


@query(f"SELECT conv_id, turn, array_to_string({words_sql('text')}, ',') AS words, array_to_string({words_sql('text', True)}, ',') AS topic FROM conversations")
def q15_turn_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = table(spark, sf_dir, "conversations")
    return chat.select("conv_id", "turn", F.concat_ws(",", T.keywords(F.col("text"))).alias("words"), F.concat_ws(",", T.keywords(F.col("text"), topic=True)).alias("topic"))


_BLEND, _OVERLAP = _blend_sql("a", "b")


@query(
    f"WITH w AS (SELECT conv_id, turn, role, {words_sql('text')} AS a FROM conversations), f AS (SELECT conv_id, arg_min(a, turn) AS b FROM w WHERE role = 'user' GROUP BY conv_id)"
    f" SELECT conv_id, turn, round({_BLEND}, 6) AS blend, round({_OVERLAP}, 6) AS overlap FROM w JOIN f USING (conv_id)"
)
def q16_lexical_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.keywords(F.col("text")).alias("a"))
    first = chat.where("role = 'user'").groupBy("conv_id").agg(F.min_by("a", "turn").alias("b"))
    both = chat.join(first, "conv_id")
    return both.select("conv_id", "turn", F.round(T.blend(F.col("a"), F.col("b")), 6).alias("blend"), F.round(T.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query(
    "WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), q AS (SELECT * FROM p WHERE b IS NOT NULL),"
    " x AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(a), '[a-z0-9+#.]+')) AS term, 1 AS a, 0 AS b FROM q UNION ALL SELECT conv_id, turn, unnest(regexp_extract_all(lower(b), '[a-z0-9+#.]+')), 0, 1 FROM q),"
    " c AS (SELECT conv_id, turn, term, sum(a) AS a, sum(b) AS b FROM x GROUP BY ALL), s AS (SELECT conv_id, turn, sum(a * b) AS d, sum(a * a) AS aa, sum(b * b) AS bb FROM c GROUP BY ALL)"
    " SELECT q.conv_id, q.turn, round(coalesce(CASE WHEN d > 0 THEN d / (sqrt(aa::DOUBLE) * sqrt(bb::DOUBLE)) ELSE 0.0 END, 0.0), 6) AS cosine FROM q LEFT JOIN s USING (conv_id, turn)"
)
def q17_bag_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"), after.alias("b")).where("b is not null")
    return conversation.bag_cosine(pairs, ["conv_id", "turn"])


@query(
    "WITH m AS (SELECT *, min(turn) OVER w AS lo, max(turn) OVER w AS hi, min(CASE WHEN role = 'user' THEN turn END) OVER w AS f FROM conversations WINDOW w AS (PARTITION BY conv_id))"
    " SELECT conv_id, turn, round((turn - lo)::DOUBLE / greatest(1, hi - lo), 6) AS recency, coalesce(turn = f, false) AS is_anchor FROM m"
)
def q18_recency_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.recency(table(spark, sf_dir, "conversations"))


_B19, _O19 = _blend_sql("asked", "own")


@query(
    f"""WITH m AS (SELECT *, 't1' AS thread_id FROM conversations), pr AS (SELECT conv_id, arg_max(text, turn) AS prompt FROM conversations GROUP BY conv_id),
u AS (SELECT m.conv_id, thread_id, turn, {words_sql('m.text')} AS own, {words_sql('prompt')} AS asked, min(turn) OVER w AS lo, max(turn) OVER w AS hi, row_number() OVER (PARTITION BY m.conv_id ORDER BY turn) = 1 AS first
  FROM m JOIN pr USING (conv_id) WHERE role <> 'assistant' WINDOW w AS (PARTITION BY m.conv_id)),
s AS (SELECT *, round(55 * {_B19} + 20 * {_O19} + 15 * ((turn - lo)::DOUBLE / greatest(1, hi - lo)) + CASE WHEN first THEN 10 ELSE 0 END, 1) AS score, len(asked) = 0 AS bare FROM u),
e AS (SELECT *, score >= 20 AND NOT bare AS enough, max((score >= 20 AND NOT bare)::INT) OVER (PARTITION BY conv_id) AS has_any FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN bare THEN 0 ELSE score END DESC, turn DESC) AS r FROM e WHERE enough OR has_any = 0)
SELECT conv_id, turn, score FROM r WHERE r <= 3"""
)
def q19_relevance_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = table(spark, sf_dir, "conversations").withColumn("thread_id", F.lit("t1"))
    prompt = chat.groupBy("conv_id").agg(F.max_by("text", "turn").alias("prompt"))
    return conversation.relevance(chat, prompt, top=3, threshold=20.0).select("conv_id", "turn", "score")


@query(
    "WITH m AS (SELECT *, lead(role) OVER w AS r, lead(turn) OVER w AS t, lead(text) OVER w AS x FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
    " SELECT conv_id, turn, CASE WHEN r = 'assistant' THEN t END AS reply_turn, CASE WHEN r = 'assistant' THEN length(x) END::BIGINT AS reply_chars FROM m WHERE role = 'user'"
)
def q20_reply_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.replies(table(spark, sf_dir, "conversations"))


_T = SqlText("t")
_BARE = "|".join(V.BARE_REFERENCES)
_MARKED = _T.parts(*V.FOLLOW_UP_MARKERS)
def analysis_sql(keys: str, text: str, source: str) -> str:
    return f"""SELECT {keys}, {cases_sql(domain_rules(_T), 'general')} AS domain,
 ({_MARKED} OR (n <= 3 AND (list_contains({_list([*V.BARE_REFERENCES, *[p.replace(' ', '') for p in V.BARE_REFERENCES]])}, bare) OR regexp_matches(bare, '^({_BARE}) ')))) AS is_followup,
 ({_T.opens(*V.NEW_TOPIC_OPENERS)} AND NOT {_MARKED}) AS is_new_topic, n::INT AS n_words
 FROM (SELECT *, trim(regexp_replace(t, '[^a-z ]', '', 'g')) AS bare, len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) AS n FROM (SELECT *, regexp_replace(lower({text}), '^\\s+|\\s+$', '', 'g') AS t FROM {source}))"""


@query(analysis_sql("conv_id, turn", "text", "conversations"))
def q26_domains_and_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = classify.analyzed(table(spark, sf_dir, "conversations"), "text")
    return told.select("conv_id", "turn", "domain", "is_followup", "is_new_topic", "n_words")


@query()
def q27_thread_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.threads(table(spark, sf_dir, "conversations"))


@query("WITH n AS (SELECT max(ts) AS now FROM events) SELECT user_id, count(*) AS fresh FROM events, n WHERE ts >= now - INTERVAL 30 MINUTES GROUP BY user_id")
def q42_fresh_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = F.broadcast(events.agg(F.max("ts").alias("now")))  # one row
    return events.crossJoin(now).where("ts >= now - INTERVAL 30 MINUTES").groupBy("user_id").agg(F.count("*").alias("fresh"))


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def q43_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = storage.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return last.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_prompt, count(*) FILTER (WHERE role = 'user') AS prompts, max(turn) FILTER (WHERE role = 'assistant') AS last_answer FROM conversations GROUP BY conv_id")
def q44_memory_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.facts(table(spark, sf_dir, "conversations"))




@query()
def q75_context_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet of each conversation's last user message, with what was said before it as history."""
    said = table(spark, sf_dir, "conversations")
    asked = said.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("prompt"), F.max("turn").alias("at"))
    history = said.join(asked.select("conv_id", "at"), "conv_id").where("turn < at").drop("at")
    out = conversation.packets(history, asked.select("conv_id", "prompt"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    return out.withColumns({"topic_keywords": F.array_join("topic_keywords", ","), "turns": turns})
