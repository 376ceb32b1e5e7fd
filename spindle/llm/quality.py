"""Quality rules with thresholds that adapt to each language and source.

Only DataFrame functions are used. Thresholds come from mergeable quantile sketches: counts per bin,
where bins are exact below 64 and have a relative width of 1/32 above. Sketches of the same metric
are merged by adding counts, so a language's sketch is the sum of its sources' and all results are
the same whatever the order of merging.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.llm.common import checkpointed

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Metrics, as whole numbers: characters per 10,000 words, and events per 100,000 words or lines.
METRICS = ("word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "stutter_rate")
#: What one event adds to a metric times its denominator: 20 more characters, a symbol, a line, a window found twice, a word.
EVENTS = {"word_length": (200_000, "n_words"), "symbol_rate": (100_000, "n_words"), "dup_line_rate": (100_000, "n_lines"), "repeat_rate": (1_600_000, "n_words"), "stutter_rate": (100_000, "n_words")}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once, however often body refers to it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight that the list holds twice or more, first ones included."""

    def covered(hashes: Column) -> Column:
        def marked(s: Column) -> Column:  # s: (hash, position), sorted
            last = F.size(s) - 1
            same = lambda e, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))].h == e.h)) | ((k < last) & (s[F.least(k + 1, last)].h == e.h))
            return F.sort_array(F.filter(F.transform(s, lambda e, k: F.when(same(e, k), e.p)), lambda p: p.isNotNull()))

        def total(at: Column) -> Column:
            last = F.size(at) - 1
            gap = lambda p, k: F.when(k < last, F.least(F.lit(WINDOW), at[F.least(k + 1, last)] - p)).otherwise(WINDOW)
            return F.aggregate(F.transform(at, gap), F.lit(0).cast("long"), lambda a, x: a + x)

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(pairs, marked), total))

    def windows(codes: Column) -> Column:
        each = lambda i: F.xxhash64(*[codes[i + j] for j in range(WINDOW)])
        return F.transform(F.sequence(F.lit(0), F.size(codes) - WINDOW), each)

    codes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(let(codes, windows), covered))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text; no words in a null text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))

    def counted(words: Column) -> Column:
        stutters = F.size(F.filter(words, lambda w, i: (i > 0) & (w == words[F.greatest(i - 1, F.lit(0))]))).cast("long")
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).alias("n_repeat_words"), stutters.alias("n_stutters"))

    def lines(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"))

    with_words = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        "doc_id",
        "lang",
        "source",
        let(words_of(F.col("text")), counted).alias("w"),
        let(with_words, lines).alias("l"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    ).select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "l.n_lines", "w.n_repeat_words", "w.n_stutters")


def with_metrics(measured: DataFrame) -> DataFrame:
    per = lambda a, b, k: F.when(F.col(b) > 0, F.floor(k * F.col(a) / F.col(b))).otherwise(0).cast("long")
    return measured.withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "word_length": per("word_chars", "n_words", 10_000),
            "symbol_rate": per("n_symbols", "n_words", 100_000),
            "dup_line_rate": per("n_dup_lines", "n_lines", 100_000),
            "repeat_rate": per("n_repeat_words", "n_words", 100_000),
            "stutter_rate": per("n_stutters", "n_words", 100_000),
        }
    )


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, bin, n: the number of documents that passed the base rules in each bin."""
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
    spread = measured.where("not base_failed").select(*keys, entries.alias("e")).select(*keys, "e.metric", "e.value")
    shift = F.greatest(F.length(F.bin("value")) - 6, F.lit(0))
    width = F.pow(F.lit(2.0), shift).cast("long")
    return spread.withColumn("bin", F.floor(F.col("value") / width) * width).groupBy(*keys, "metric", "bin").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, docs, lo and hi: the lower edge of the bin that holds the first quartile, and the upper edge of the third one's."""
    group = Window.partitionBy(*keys, "metric")
    ranked = sketch.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "docs": F.sum("n").over(group)})
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("docs") * q, F.col("bin")))
    found = ranked.groupBy(*keys, "metric").agg(F.first("docs").alias("docs"), at(0.25).alias("lo"), at(0.75).alias("hi"))
    width = F.pow(F.lit(2.0), F.greatest(F.length(F.bin("hi")) - 6, F.lit(0))).cast("long")
    return found.withColumn("hi", F.col("hi") + width - 1)


def thresholds(measured: DataFrame, *, min_docs: int = 100) -> DataFrame:
    """lang, source and, for each metric, a struct of lo and hi, between which half of the group's documents lie.

    Groups of fewer than min_docs documents take their language's sketch, and languages of fewer the
    sketch of all. Quartiles hold as long as less than a quarter of a group is junk.
    """
    fine = sketches(measured, ["lang", "source"])
    by_lang = fine.groupBy("lang", "metric", "bin").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("metric", "bin").agg(F.sum("n").alias("n"))
    held = F.struct("docs", "lo", "hi")
    one = quantiles(fine, ["lang", "source"])
    two = quantiles(by_lang, ["lang"]).select(F.col("lang").alias("lang2"), F.col("metric").alias("metric2"), held.alias("two"))
    all_ = quantiles(overall, []).select(F.col("metric").alias("metric3"), held.alias("three"))
    same = F.col("lang").eqNullSafe(F.col("lang2")) & (F.col("metric") == F.col("metric2"))
    both = one.join(two, same).join(all_, F.col("metric") == F.col("metric3"))
    used = F.when(F.col("docs") >= min_docs, held).when(F.col("two.docs") >= min_docs, F.col("two")).otherwise(F.col("three"))
    return both.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, used)).alias(m) for m in METRICS])


def within(reach: int = 4) -> Column:
    """Whether a document's metrics are within its group's bounds, bound_ and the metric's name.

    A bound lies reach spreads beyond hi, that of the word length also below lo. A spread is what lies
    between lo and hi, and at least what one event makes of the metric in a document of this size: a
    metric that is zero in most documents has no spread of its own, and a few events are no junk, in
    short documents or in long ones.
    """
    inside = F.lit(True)
    for m in METRICS:
        event, size = EVENTS[m]
        lo, hi = F.col(f"bound_{m}.lo"), F.col(f"bound_{m}.hi")
        gap = reach * F.greatest((hi - lo).cast("double"), F.lit(float(event)) / F.greatest(F.col(size), F.lit(1)))
        inside &= F.col(m) <= hi + gap
        if m == "word_length":
            inside &= F.col(m) >= lo - gap
    return F.coalesce(inside, F.lit(True))


def quality_rules(docs: DataFrame, *, min_docs: int = 100, reach: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, counts, base_failed and kept.

    kept: the base rules hold and every metric is within its group's bounds. Null and empty texts have
    no words and fail the base rules; null languages and sources are groups like others; repeated rows
    are judged alike.
    """
    measured = checkpointed(with_metrics(measures(docs)))  # counts of words are used twice
    bounds = thresholds(measured, min_docs=min_docs).select(F.col("lang").alias("b_lang"), F.col("source").alias("b_source"), *[F.col(m).alias(f"bound_{m}") for m in METRICS])
    # one row a group, and groups are few: a broadcast if Spark's own size check allows it
    joined = measured.join(bounds, F.col("lang").eqNullSafe(F.col("b_lang")) & F.col("source").eqNullSafe(F.col("b_source")), "left")
    kept = ~F.col("base_failed") & within(reach)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
