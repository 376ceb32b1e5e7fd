"""First-match rules that can be rendered as Columns or as SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindle.functions import vocabulary as V
from spindle.functions.text import any_pattern, word_pattern


class Sql(str):
    """SQL text of a condition, combined like a Column."""

    def __and__(self, other):
        return Sql(f"({self} AND {other})")

    def __or__(self, other):
        return Sql(f"({self} OR {other})")

    def __invert__(self):
        return Sql(f"(NOT {self})")


class Text:
    """Tests on a lower-case, trimmed text."""

    def __init__(self, column: Column):
        self.column = column

    def matches(self, pattern: str):
        return self.column.rlike(pattern)

    def words(self, *words: str):
        return self.matches(word_pattern(words))

    def parts(self, *parts: str):
        return self.matches(any_pattern(parts))

    def starts(self, *heads: str):
        return self.matches("^(" + any_pattern(heads) + ")")

    def opens(self, *heads: str):
        """One of heads at the start or after a blank."""
        return self.matches("(^| )(" + any_pattern(heads) + ")")


class SqlText(Text):
    def __init__(self, name: str):
        self.name = name

    def matches(self, pattern: str):
        return Sql("regexp_matches(" + self.name + ", '" + pattern.replace("'", "''") + "')")


def cases(rules: list[tuple], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def cases_sql(rules: list[tuple], otherwise: str) -> str:
    quoted = lambda v: v if isinstance(v, Sql) else f"'{v}'"
    return "CASE " + " ".join(f"WHEN {c} THEN {quoted(v)}" for c, v in rules) + f" ELSE '{otherwise}' END"


def code_complexity(t: Text) -> list[tuple]:
    builds, systems, small = t.words(*V.BUILD_VERBS), t.words(*V.SYSTEM_NOUNS), t.words(*V.SMALL_ARTIFACTS)
    return [(t.parts(*V.TRIVIAL_CODE), "low"), (t.parts(*V.SCALE_MARKERS), "high"), (builds & systems, "high"), (systems & ~small, "high")]


def intent_rules(t: Text, few_words) -> list[tuple]:
    """(condition, intent, complexity rules, complexity otherwise, confidence), first match wins.

    few_words: whether the text has at most three words.
    """
    greeting = r"^(hi|hello|hey|yo|hiya|sup|howdy|good\s+(morning|afternoon|evening)|how('?s| is| are)($|[^\p{L}\p{N}_]).*|what'?s up|thanks?|thank you|bye|good night)($|[^\p{L}\p{N}_])"
    greeting_only = r"^how('?s| is| are)$"
    tongues = r"(^|[^\p{L}\p{N}_])(in|to)\s+(french|spanish|german|hindi|chinese|japanese|arabic|italian|portuguese|russian|korean)($|[^\p{L}\p{N}_])"
    small_talk = few_words & ~t.matches(r"\?$") & ~t.words(*V.SMALL_ARTIFACTS, *V.SYSTEM_NOUNS) & t.words("joke", "hi", "hello", "hey", "thanks")
    broken = t.words("bug", "error", "issue", "exception", "crash", "not working", "broken", "fails", "failing")
    debugging = t.words("debug", "traceback", "stack trace", "stacktrace") | (t.words("fix", "solve", "resolve") & broken) | t.matches(r"why (is|does|isn'?t|doesn'?t).*(not work|error|fail|break)")
    writes = t.words("story", "poem", "poetry", "haiku", "novel", "song", "lyrics", "screenplay", "script", "fiction", "essay") & t.words("write", "compose", "create", "generate", "tell")
    maths = t.words("integral", "derivative", "equation", "theorem", "probability", "matrix", "calculus", "algebra", "prove", "proof") | t.matches(r"[0-9]\s*[\+\-\*/x=]\s*[0-9]")
    designs = t.words("architecture", "microservices", "system design") | (t.words("design", "architect") & t.words("scalable", "distributed", "architecture", "system")) | t.words("trade-off", "tradeoff", "logic puzzle")
    codes = t.words(*V.CODE_LANGUAGES) | t.words(*V.SMALL_ARTIFACTS) | (t.words(*V.BUILD_VERBS) & t.words(*V.SYSTEM_NOUNS))
    teaches = t.words("explain", "teach", "understand", "concept", "learn") | t.matches(r"^(what|how|why|when)($|[^\p{L}\p{N}_]).*(is|are|does|do|work|mean)")
    long = t.words(*V.LONG_SOURCES)
    return [
        (t.matches(r"^$"), "general_chat", [], "low", 0.9),
        (t.matches(greeting) | t.matches(greeting_only) | t.parts(*V.CHITCHAT), "conversation", [], "low", 0.95),
        (small_talk, "conversation", [], "low", 0.9),
        (t.words("translate", "translation") | t.matches(tongues), "translation", [(long, "high")], "low", 0.95),
        (t.words("summarize", "summarise", "summary", "tldr", "tl;dr") | t.parts("key points", "main points"), "summarization", [(t.words("sentence", "tweet", "line"), "low"), (long, "high")], "medium", 0.95),
        (debugging, "debugging", [(t.words("across", "entire", "whole", "multiple"), "medium"), (t.parts(*V.SCALE_MARKERS), "high")], "low", 0.9),
        (writes, "creative_writing", [(t.words("novel", "book", "screenplay", "chapter", "saga"), "high"), (t.words("haiku", "tweet", "one-liner", "limerick"), "low")], "medium", 0.9),
        (maths, "mathematics", [(t.matches(r"^[0-9\s\+\-\*/x=().]+\??$"), "low"), (t.words("prove", "proof", "theorem"), "high")], "medium", 0.9),
        (t.words("research", "literature review", "investigate", "state of the art", "survey the", "find sources"), "research", [], "high", 0.9),
        (designs, "reasoning", [], "high", 0.9),
        (codes, "coding", code_complexity(t), "medium", 0.9),
        (teaches, "education", [(t.words("in depth", "in-depth", "comprehensive", "advanced"), "high")], "medium", 0.9),
    ]


def domain_rules(t: Text) -> list[tuple]:
    """A coarse subject; words of three rules are looked for inside other words as well, on purpose."""
    return [
        (t.matches("^$"), "general"),
        (t.matches(r"^(hi|hello|hey|yo|thanks|thank you|bye)($|[^\p{L}\p{N}_])"), "chat"),
        (t.opens(*V.KNOWLEDGE_OPENERS), "knowledge"),
        (t.parts("translate", "translation"), "translation"),
        (t.parts("summarize", "summarise", "summary", "tldr", "tl;dr"), "documents"),
        (t.matches(word_pattern(V.CREATIVE_MARKERS)), "creative"),
        (t.parts(*V.SOFTWARE_MARKERS) | t.matches(r"(^|[^\p{L}\p{N}_])(" + any_pattern(V.DEBUG_MARKERS) + r")($|[^\p{L}\p{N}_])"), "software"),
    ]
