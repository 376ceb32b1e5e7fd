"""Texts as chunks: islands of lines, logical blocks, whole-file chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions import text as T


def islands(all_lines: Column, gap: int = 0) -> Column:
    """Runs of lines with something visible, as an array of (first, last) counted from 1.

    gap: blank lines that a run may hold between two of its lines.
    """
    numbered = F.filter(F.transform(all_lines, lambda x, i: F.when(F.trim(x) != "", i + 1)), lambda i: i.isNotNull())
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def step(acc: Column, i: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), i.alias("last"))))
        return F.when((F.size(acc) > 0) & (i - last["last"] <= gap + 1), grown).otherwise(F.concat(acc, F.array(F.struct(i.alias("first"), i.alias("last")))))

    return F.aggregate(numbered, empty, step)


def merged(spans: Column, least: int) -> Column:
    """Spans joined forward while the one before has fewer than least lines; the last may stay short."""
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), s["last"].alias("last"))))
        return F.when((F.size(acc) > 0) & (last["last"] - last["first"] + 1 < least), grown).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, empty, step)


def adjacent(numbers: Column, gap: int = 2) -> Column:
    """Sorted numbers as spans whose neighbours are at most gap apart."""
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def step(acc: Column, i: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), i.alias("last"))))
        return F.when((F.size(acc) > 0) & (i - last["last"] <= gap), grown).otherwise(F.concat(acc, F.array(F.struct(i.alias("first"), i.alias("last")))))

    return F.aggregate(numbers, empty, step)


def file_chunks(files: DataFrame, *, most_lines: int = 200, least_lines: int = 8) -> DataFrame:
    """Chunks of whole files (path, text, kind): one a file, or for long documents and markup a head and blocks.

    A file of more than most_lines lines is split at blank lines into blocks of least_lines at least.
    The first block stands for the file; the others are numbered parts of it. Blank files give none.
    """
    own = files.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_lines", T.lines(F.col("text")))
    n = F.size("_lines")
    blocks = F.when((n > most_lines) & F.col("kind").isin("document", "markup"), merged(islands(F.col("_lines")), least_lines)).otherwise(F.array().cast("array<struct<first:int,last:int>>"))
    own = own.withColumn("_blocks", blocks)
    whole = F.array(F.struct(F.lit(1).alias("first"), n.alias("last")))
    head = F.transform(F.slice("_blocks", 1, 1), lambda b: F.struct(F.lit(1).alias("first"), b["last"].alias("last")))
    spans = F.when(F.size("_blocks") > 1, F.concat(head, F.slice("_blocks", F.lit(2), F.greatest(F.size("_blocks") - 1, F.lit(1))))).otherwise(whole)
    out = own.withColumn("_total", F.greatest(F.size("_blocks") - 1, F.lit(0))).select("path", "kind", "_lines", "_total", F.posexplode(spans).alias("part", "_span"))
    body = T.span(F.col("_lines"), F.col("_span.first"), F.col("_span.last"))
    out = out.select("path", F.when(F.col("part") > 0, "block").otherwise(F.col("kind")).alias("kind"), F.when(F.col("part") > 0, F.concat("path", F.lit("#block"), F.col("part").cast("string"))).otherwise(F.col("path")).alias("symbol"), F.col("_span.first").alias("start_line"), F.col("_span.last").alias("end_line"), "part", F.when(F.col("part") > 0, F.col("_total")).alias("parts"), body.alias("body"))
    prefix = F.when(F.col("part") > 0, F.concat(F.lit("# section "), F.col("part").cast("string"), F.lit(" of "), F.col("path"), F.lit("\n\n"))).otherwise("")
    return out.withColumns({"hash": T.content_hash(F.concat(prefix, F.col("body"))), "n_lines": T.line_count(F.col("body")), "n_chars": F.length("body").cast("long"), "n_tokens": T.token_estimate(F.col("body"))})


def chunk_counts(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Number, mean characters and mean lines of chunks for each value of each column of by, in one pass."""
    kinds = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in by])
    spread = chunks.select("n_chars", "n_lines", F.explode(kinds).alias("k")).select("n_chars", "n_lines", "k.field", "k.value")
    return spread.groupBy("field", "value").agg(F.count("*").alias("chunks"), F.round(F.avg("n_chars"), 2).alias("mean_chars"), F.round(F.avg("n_lines"), 2).alias("mean_lines"))
