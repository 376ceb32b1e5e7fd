"""Which provider and model a classified prompt goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.functions import vocabulary as V
from spindle.functions.text import english_list


def provider(intent: Column, complexity: Column, long_context: Column) -> Column:
    low, medium, high = (complexity == c for c in ("low", "medium", "high"))
    code = F.when(low, "ollama").when(medium, "groq").when(long_context, "gemini").otherwise("groq")
    thought = F.when(low, "ollama").otherwise("gemini")
    source = F.when(low & ~long_context, "ollama").otherwise("gemini")
    return (
        F.when(intent.isin("coding", "debugging"), code)
        .when(intent.isin("reasoning", "mathematics", "education", "creative_writing"), thought)
        .when(intent.isin("summarization", "document_analysis", "translation"), source)
        .when(intent == "research", "gemini")
        .otherwise(F.when(high, "gemini").otherwise("ollama"))
    )


def reason(routed: DataFrame) -> Column:
    """A sentence from intent, complexity, the requires_ flags and provider."""
    size = F.when(F.col("complexity") == "high", "Large-scale").when(F.col("complexity") == "medium", "Moderate").otherwise("Simple")
    needs = F.filter(F.array(*[F.when(F.col(c), n) for c, n in (("requires_code", "strong code generation"), ("requires_reasoning", "deep reasoning"), ("requires_long_context", "a large context window"))]), lambda x: x.isNotNull())
    label = F.element_at(F.create_map(*[F.lit(x) for kv in V.PROVIDER_LABELS.items() for x in kv]), F.col("provider"))
    where = F.when(F.col("provider") == "ollama", "— handled locally for speed").otherwise(F.concat(F.lit("— routed to "), label))
    asks = F.when(F.size(needs) > 0, F.concat(F.lit("requiring "), english_list(needs), F.lit(" "))).otherwise("")
    return F.concat(size, F.lit(" "), F.replace(F.col("intent"), F.lit("_"), F.lit(" ")), F.lit(" task "), asks, where, F.lit("."))


def failover(primary: Column) -> Column:
    order = F.array(*map(F.lit, V.FAILOVER))
    return F.concat(F.array(primary), F.array_remove(order, primary))


def first_connected(requests: DataFrame, providers: DataFrame, key: str = "id") -> DataFrame:
    """key and the first provider of each request's chain that is connected and has a model; null if none."""
    chain = requests.select(key, F.posexplode("chain").alias("pos", "provider"))
    usable = providers.where("connected and model is not null").select("provider", "model")
    best = chain.join(usable, "provider").groupBy(key).agg(F.min_by(F.struct("provider", "model"), "pos").alias("b"))
    return requests.select(key).join(best, key, "left").select(key, F.col("b.provider").alias("provider"), F.col("b.model").alias("model"))


def selected_models(models: DataFrame, validations: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """The model of each provider: freshly valid ones first, then by preference, then in their order.

    models: (provider, model, ordinal). validations: the latest (provider, model, validated,
    last_tested). Models whose latest test failed are left out unless all of them failed.
    """
    fresh = F.col("validated") & (F.col("last_tested") >= now - F.expr(f"INTERVAL {minutes} MINUTES"))
    tested = models.join(validations, ["provider", "model"], "left").withColumns({"good": F.coalesce(fresh, F.lit(False)), "bad": F.coalesce(~F.col("validated"), F.lit(False))})
    own = Window.partitionBy("provider")
    tested = tested.withColumn("usable", ~F.col("bad") | (F.min(F.col("bad").cast("int")).over(own) == 1))
    tested = tested.withColumn("any_good", F.max((F.col("good") & F.col("usable")).cast("int")).over(own) == 1)
    candidates = tested.where("usable and (good or not any_good)")
    ranks = [(p, m, i) for p, names in V.PREFERRED_MODELS.items() for i, m in enumerate(names)]
    wanted = F.create_map(*[F.lit(x) for p, m, i in ranks for x in (f"{p}/{m}", i)])
    rank = F.coalesce(F.element_at(wanted, F.concat_ws("/", "provider", "model")), F.lit(len(ranks)))
    return candidates.groupBy("provider").agg(F.min_by("model", F.struct(rank, F.col("ordinal"))).alias("model"))


def suited_models(models: DataFrame) -> DataFrame:
    """models (provider, model, ...) without those whose names tell that they don't chat; providers without such parts keep all."""
    name = F.lower("model")
    unsuited = [(F.col("provider") == p) & F.greatest(*[name.contains(x) for x in parts], F.lit(False)) for p, parts in V.UNSUITED_MODELS.items()]
    return models.where(~F.coalesce(F.greatest(*unsuited), F.lit(False)))


def provider_status(records: DataFrame, models: DataFrame, validations: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """provider, name, connected and model: every known provider with each model that it offers, null if it offers none.

    records: at most one (provider, connected) each; records of unknown providers count for nothing. A connected
    provider offers freshly valid models only, any other all of its list.
    """
    labels = models.sparkSession.createDataFrame(list(V.PROVIDER_LABELS.items()), "provider string, name string")  # four rows
    known = labels.join(records.select("provider", "connected"), "provider", "left").select("provider", "name", F.coalesce("connected", F.lit(False)).alias("connected"))
    fresh = validations.where(F.col("validated") & (F.col("last_tested") >= now - F.expr(f"INTERVAL {minutes} MINUTES"))).select("provider", "model", F.lit(True).alias("valid")).distinct()
    offered = models.select("provider", "model", "ordinal").join(fresh, ["provider", "model"], "left").join(F.broadcast(known.select("provider", "connected")), "provider")
    offered = offered.where(~F.col("connected") | F.col("valid")).select("provider", "model", "ordinal")
    return known.join(offered, "provider", "left")
