"""Fill-in-the-middle transformation with built-in functions: units of a text are cut twice and put in another order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word with the white space before it, or the white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SENTINEL = "<[PSM]>"


def _digits(doc_id: str, seed: str, group: int) -> Column:
    """The group-th eight hex digits of sha256 of seed:doc_id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, *, seed: str = "42", percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output.

    n: units of the text. form: plain, where output is the text, for empty texts, texts with a
    sentinel, and all but percent hundredths; else spm or psm, where output is prefix, suffix and
    middle in the order of the form, behind their sentinels. prefix_chars and middle_chars are null
    for plain. A null text is empty; rows without doc_id are cut as the word null says; repeated
    rows are cut alike. Each text stays in its row, so no column or order of docs matters.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("units"))
    one, two = (_digits("doc_id", seed, g) % (F.col("n") + 1) for g in (0, 1))
    held = F.rlike("text", F.lit(_SENTINEL))
    form = F.when((F.col("text") == "") | held | (_digits("doc_id", seed, 2) % 100 >= percent), "plain").when(_digits("doc_id", seed, 3) % 100 < spm_percent, "spm").otherwise("psm")
    cut = cut.withColumn("n", F.size("units").cast("long"))
    cut = cut.select("doc_id", "text", "units", "n", form.alias("form"), F.least(one, two).cast("int").alias("low"), F.greatest(one, two).cast("int").alias("high"))
    part = lambda begin, size: F.array_join(F.slice("units", begin + 1, size), "")
    low, high = F.col("low"), F.col("high")
    parts = F.when(F.col("form") != "plain", F.struct(part(F.lit(0), low).alias("prefix"), part(low, high - low).alias("middle"), part(high, F.col("n").cast("int") - high).alias("suffix")))
    made = cut.select("doc_id", "text", "n", "form", parts.alias("parts"))
    p, m, s = (F.col(f"parts.{x}") for x in ("prefix", "middle", "suffix"))
    psm = F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)
    spm = F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return made.select("doc_id", "n", "form", F.char_length(p).cast("long").alias("prefix_chars"), F.char_length(m).cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of; the pieces hold no sentinel, nor do a piece's end and a sentinel make one."""
    piece = F.split(F.col(output), _SENTINEL, -1)
    prefix, suffix = (F.when(F.col(form) == "psm", piece[i]).otherwise(piece[j]) for i, j in ((1, 2), (2, 1)))
    return F.when(F.col(form) == "plain", F.col(output)).otherwise(F.concat(prefix, piece[3], suffix))
