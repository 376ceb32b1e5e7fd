"""Intent and complexity of prompts by rules, what follows from them, and prompt analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions import text as T
from spindle.functions import vocabulary as V
from spindle.functions.rules import Text, cases, domain_rules, intent_rules


def stripped(text: Column) -> Column:
    """Lower-case, without white space of any kind around it."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def intents(prompts: DataFrame, column: str = "prompt") -> DataFrame:
    """Adds intent, complexity and confidence by the first rule that matches."""
    own = prompts.withColumn("_t", stripped(F.col(column)))
    rules = intent_rules(Text(F.col("_t")), word_count(F.col("_t")) <= 3)
    own = own.withColumn("_rule", cases([(c, i) for i, (c, *_) in enumerate(rules)], -1))  # each condition is looked at once
    intent, complexity, confidence = F.lit("general_chat"), F.lit("medium"), F.lit(0.3)
    for at, (_, name, inner, other, sure) in enumerate(rules):
        met = F.col("_rule") == at
        intent = F.when(met, F.lit(name)).otherwise(intent)
        complexity = F.when(met, cases(inner, other)).otherwise(complexity)
        confidence = F.when(met, F.lit(sure)).otherwise(confidence)
    return own.select("*", intent.alias("intent"), complexity.alias("complexity"), confidence.alias("confidence")).drop("_t", "_rule")


def enriched(results: DataFrame) -> DataFrame:
    """Adds what intent, complexity and confidence imply; unknown values become general_chat and medium."""
    intent, complexity = F.lower(F.trim("intent")), F.lower(F.trim("complexity"))
    own = results.withColumns(
        {
            "intent": F.when(intent.isin(*V.INTENTS), intent).otherwise("general_chat"),
            "complexity": F.when(complexity.isin("low", "medium", "high"), complexity).otherwise("medium"),
            "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence").cast("double"))),
        }
    )
    condensing = F.col("intent").isin("summarization", "translation")
    output = F.when(condensing & (F.col("complexity") == "low"), "small").when(condensing, "medium").when(F.col("complexity") == "high", "large").when(F.col("complexity") == "low", "small").otherwise("medium")
    own = own.withColumn("estimated_output", output)
    long = (F.col("estimated_output") == "large") | (F.col("intent").isin("summarization", "document_analysis", "research") & F.col("complexity").isin("medium", "high"))
    own = own.withColumns({"requires_code": F.col("intent").isin("coding", "debugging"), "requires_reasoning": (F.col("complexity") == "high") | F.col("intent").isin("reasoning", "mathematics", "research"), "requires_long_context": long})
    return own.withColumn("offline_possible", (F.col("complexity") == "low") & ~F.col("requires_long_context"))


def needs_model(results: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Adds whether a rule's result is too unsure to stand."""
    return results.withColumn("needs_model", F.col("confidence") < threshold)


def analyzed(prompts: DataFrame, column: str = "prompt") -> DataFrame:
    """Adds domain, is_followup, is_reference, is_new_topic, n_words and the keyword sets."""
    t = stripped(F.col(column))
    own = prompts.withColumns({"_t": t, "_bare": F.trim(F.regexp_replace(t, "[^a-z ]", ""))})
    text = Text(F.col("_t"))
    heads = [p for p in V.BARE_REFERENCES]
    bare = F.col("_bare").isin(*heads, *[p.replace(" ", "") for p in heads]) | F.col("_bare").rlike("^(" + "|".join(heads) + ") ")
    own = own.withColumns({"n_words": word_count(F.col("_t")), "_marked": text.parts(*V.FOLLOW_UP_MARKERS)})
    own = own.withColumns({"is_reference": (F.col("n_words") <= 3) & bare, "is_new_topic": text.opens(*V.NEW_TOPIC_OPENERS) & ~F.col("_marked")})
    own = own.withColumns({"is_followup": F.col("_marked") | F.col("is_reference"), "domain": cases(domain_rules(text), "general"), "continues": F.regexp_extract("_t", r"(?U)^(\S*)", 1).isin(*V.CONTINUATION_VERBS)})
    return own.withColumns({"words": T.keywords(F.col(column)), "topic": T.keywords(F.col(column), topic=True)}).drop("_t", "_bare", "_marked")


def confidence(value: Column) -> Column:
    """A model's confidence from 0 to 1, of a JSON value as text: numbers and numbers as text are clamped, three words have values.

    Booleans, other words, null, lists, objects and missing values give the default.
    """
    text = F.when(value.startswith('"'), F.lower(F.trim(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")))).otherwise(F.lower(F.trim(value)))
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), text.try_cast("double"))
    words = F.create_map(*[F.lit(x) for kv in V.CONFIDENCE_WORDS.items() for x in kv])
    worded = F.when(value.startswith('"'), F.element_at(words, text))
    return F.coalesce(worded, F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))), F.lit(V.DEFAULT_CONFIDENCE))
