"""Conversations: topic threads, relevance of earlier messages, replies, facts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.functions import text as T
from spindle.operators.classify import analyzed
from spindle.session import stored

REJOIN, JOIN = 0.5, 0.18
THREADS = "conv_id long, turn long, thread_id string, domain string, is_new boolean"


class Replay:
    """Threads of one conversation so far; feed() takes its messages in order.

    A message by the assistant belongs to the current thread. Any other message joins a thread of its
    own domain or opens one: a bare reference stays; a follow-up or continuing verb stays if the
    domain is the current thread's, else joins the likeliest one; an opener of new topics joins only a
    close thread, other messages a fairly close one.
    """

    def __init__(self, state: tuple | None = None):
        threads, self.current = state or ((), -1)
        self.threads = [(d, set(w)) for d, w in threads]

    def state(self) -> tuple:
        return [(d, sorted(w)) for d, w in self.threads], self.current

    def _nearness(self, topic: set[str], i: int) -> float:
        own = self.threads[i][1]
        common = len(topic & own)
        return 0.5 * common / len(topic | own) + 0.5 * common / min(len(topic), len(own)) if common else 0.0

    def _target(self, domain: str, row) -> int:
        if not self.threads:
            return -1
        if row.is_reference and self.current >= 0:
            return self.current
        near = [(self._nearness(set(row.topic), i), -i) for i, (d, _) in enumerate(self.threads) if d == domain]
        if not near:
            return -1
        score, best = max(near)
        if row.is_followup or row.continues:
            return self.current if self.threads[self.current][0] == domain else -best
        return -best if score >= (REJOIN if row.is_new_topic else JOIN) else -1

    def feed(self, row) -> tuple[str | None, str | None, bool]:
        if row.role == "assistant":
            return (None, None, False) if self.current < 0 else (f"t{self.current + 1}", self.threads[self.current][0], False)
        domain = row.domain
        if domain in ("general", "chat") and self.current >= 0 and row.continues:
            domain = self.threads[self.current][0]
        at = self._target(domain, row)
        new = at < 0
        if new:
            at = len(self.threads)
            self.threads.append((domain, set()))
        self.threads[at][1].update(row.topic)
        self.current = at
        return f"t{at + 1}", self.threads[at][0], new


def threads(messages: DataFrame) -> DataFrame:
    """conv_id, turn, thread_id, domain and is_new of every message (conv_id, turn, role, text).

    The text of a message is analysed with DataFrame functions; only the replay, where each message
    depends on those before it, runs over a conversation at a time.
    """
    told = analyzed(messages.select("conv_id", "turn", "role", "text"), "text").select("conv_id", "turn", "role", "domain", "is_followup", "is_reference", "is_new_topic", "continues", "topic")

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        own = Replay()
        out = [(r.conv_id, r.turn, *own.feed(r)) for r in rows.sort_values("turn").itertuples(index=False)]
        return pd.DataFrame(out, columns=["conv_id", "turn", "thread_id", "domain", "is_new"])

    return told.groupBy("conv_id").applyInPandas(replay, THREADS)


def relevance(messages: DataFrame, prompts: DataFrame, *, top: int = 5, threshold: float = 3.0) -> DataFrame:
    """The user messages of a thread that matter for its conversation's prompt: conv_id, turn, score.

    messages: (conv_id, thread_id, turn, role, text); prompts: (conv_id, prompt). A score adds up
    similarity of topic words, their overlap, recency and whether it is the thread's first user
    message. Those of threshold or more come first, by score and then by turn; if there are none, all
    count; a prompt without words takes the newest.
    """
    thread = Window.partitionBy("conv_id", "thread_id")
    users = messages.where("role <> 'assistant'").join(prompts, "conv_id")
    own, asked = T.keywords(F.col("text")), T.keywords(F.col("prompt"))
    users = users.withColumns({"_own": own, "_asked": asked, "_old": F.min("turn").over(thread), "_new": F.max("turn").over(thread), "_first": F.row_number().over(thread.orderBy("turn")) == 1})
    recency = (F.col("turn") - F.col("_old")) / F.greatest(F.lit(1), F.col("_new") - F.col("_old"))
    score = 55 * T.blend(F.col("_asked"), F.col("_own")) + 20 * T.overlap(F.col("_asked"), F.col("_own")) + 15 * recency + F.when(F.col("_first"), 10).otherwise(0)
    score = F.round(score * 10) / 10  # tenths as doubles have them: round(score, 1) goes by decimal digits, which a double as 13.649999999999999 just misses
    users = users.withColumns({"score": score, "_bare": F.size("_asked") == 0}).withColumn("_enough", (F.col("score") >= threshold) & ~F.col("_bare"))
    users = users.withColumn("_any", F.max(F.col("_enough").cast("int")).over(thread))
    order = thread.orderBy(F.when(F.col("_bare"), 0).otherwise(F.col("score")).desc(), F.desc("turn"))
    kept = users.where("_enough or _any = 0").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top)
    return kept.select("conv_id", "thread_id", "turn", "score")


def packets(messages: DataFrame, prompts: DataFrame, *, top: int = 5, threshold: float = 3.0) -> DataFrame:
    """What a model gets for a new prompt of a conversation: conv_id, thread_id, is_new_topic, total_history, used_count, reason, topic_keywords, turns.

    messages: the history (conv_id, turn, role, text); prompts: (conv_id, prompt), one each. The prompt
    takes part in the replay as a last message, so its thread is found as any message's, and the
    history's threads stay as they are. Without history it opens t1. turns: the relevant user
    messages of its thread, by score, and the prompt, as (role, text). Conversations without a prompt have no
    packet; a null prompt is empty.
    """
    asked = prompts.select("conv_id", F.coalesce("prompt", F.lit("")).alias("prompt"))
    own = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).join(asked.select("conv_id"), "conv_id", "left_semi")
    past = asked.join(own.groupBy("conv_id").agg(F.max("turn").alias("last"), F.count_if(F.col("role") == "user").alias("total")), "conv_id", "left")
    asked = past.select("conv_id", "prompt", (F.coalesce("last", F.lit(-1)) + 1).alias("at"), F.coalesce("total", F.lit(0)).alias("total_history"))
    told = stored(threads(own.unionByName(asked.select("conv_id", F.col("at").alias("turn"), F.lit("user").alias("role"), F.col("prompt").alias("text")))))
    new = told.join(asked, (told["conv_id"] == asked["conv_id"]) & (told["turn"] == asked["at"])).select(asked["conv_id"], "prompt", "at", "total_history", "thread_id", "is_new")
    held = own.join(told.select("conv_id", "turn", "thread_id"), ["conv_id", "turn"])
    of_thread = held.join(new.where("not is_new").select("conv_id", "thread_id"), ["conv_id", "thread_id"], "left_semi")
    chosen = relevance(of_thread, new.where("not is_new").select("conv_id", "prompt"), top=top, threshold=threshold)
    chosen = chosen.join(own, ["conv_id", "turn"]).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), (-F.col("turn")).alias("then"), "role", "text"))).alias("own"))
    out = new.join(chosen, "conv_id", "left").withColumn("context", F.coalesce(F.transform("own", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))), F.array().cast("array<struct<role:string,text:string>>")))
    n = F.size("context")
    reason = F.when(n > 0, F.concat(F.lit("Reusing "), n.cast("string"), F.lit(" relevant message"), F.when(n == 1, "").otherwise("s"), F.lit(" from the current thread.")))
    reason = reason.otherwise(F.when(F.col("is_new"), "New topic — no prior context needed.").otherwise("No related earlier messages found."))
    turns = F.concat("context", F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("text"))))
    words = T.keywords(F.col("prompt"), topic=True)
    return out.select("conv_id", "thread_id", F.col("is_new").alias("is_new_topic"), "total_history", n.cast("long").alias("used_count"), reason.alias("reason"), words.alias("topic_keywords"), turns.alias("turns"))


def replies(messages: DataFrame) -> DataFrame:
    """Each user message with the assistant's message right after it, if there is one."""
    turn = Window.partitionBy("conv_id").orderBy("turn")
    paired = messages.withColumns({"_role": F.lead("role").over(turn), "_turn": F.lead("turn").over(turn), "_text": F.lead("text").over(turn)})
    answered = F.col("_role") == "assistant"
    return paired.where("role = 'user'").select("conv_id", "turn", F.when(answered, F.col("_turn")).alias("reply_turn"), F.when(answered, F.length("_text")).cast("long").alias("reply_chars"))


def recency(messages: DataFrame) -> DataFrame:
    """Place of each message between a conversation's oldest and newest, and whether it is its first user message."""
    own = Window.partitionBy("conv_id")
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(own)
    place = (F.col("turn") - F.min("turn").over(own)) / F.greatest(F.lit(1), F.max("turn").over(own) - F.min("turn").over(own))
    return messages.select("conv_id", "turn", F.round(place, 6).alias("recency"), F.coalesce(F.col("turn") == first, F.lit(False)).alias("is_anchor"))


def bag_cosine(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the cosine of the term counts of columns a and b."""
    terms = lambda c: pairs.select(*keys, F.explode(T.tokens(F.col(c))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias(c))
    both = terms("a").join(terms("b"), [*keys, "term"], "full_outer").groupBy(*keys).agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    value = F.when(F.coalesce(F.col("dot"), F.lit(0)) > 0, F.col("dot") / (F.sqrt("aa") * F.sqrt("bb"))).otherwise(0.0)
    return pairs.select(*keys).join(both, keys, "left").select(*keys, F.round(F.coalesce(value, F.lit(0.0)), 6).alias("cosine"))


def facts(messages: DataFrame) -> DataFrame:
    """A conversation's first user message, number of user messages and last turn of the assistant."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return messages.groupBy("conv_id").agg(
        F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("first_prompt"),
        F.count_if(user).alias("prompts"),
        F.max(F.when(assistant, F.col("turn"))).alias("last_answer"),
    )



def client_ids(history: DataFrame, key: str, created: Column, order: str) -> DataFrame:
    """history with client_id: when a row was made and its place, from 0, among the rows of key in the order of a unique column."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return history.withColumn("client_id", F.concat_ws("-", created, place.cast("string")))
