"""Dependencies named in manifests, and the frameworks they tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions import vocabulary as V

_SECTIONS = ("dependencies", "devDependencies", "peerDependencies")


def npm_names(text: Column) -> Column:
    """Lower-case keys of the three dependency sections; none if the text isn't an object."""
    parsed = F.from_json(text, "struct<" + ", ".join(f"{s}: map<string,string>" for s in _SECTIONS) + ">")
    keys = [F.coalesce(F.map_keys(parsed[s]), F.array().cast("array<string>")) for s in _SECTIONS]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*keys), lambda k: F.lower(k))))


def _cut(line: Column, signs: str) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, rf"({signs}).*$", "")))


def requirement_names(text: Column) -> Column:
    """Names at the start of lines, up to a version, an extra, a marker or a blank; comments and flags left out."""
    own = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^[#-]"))
    names = F.transform(own, lambda x: _cut(F.trim(F.split(x, ";")[0]), r"==|>=|<=|~=|!=|>|<|\[| "))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "")))


def quoted_names(text: Column) -> Column:
    """Names in lines that begin with a quote, as in lists of a TOML file."""
    own = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.trim(x), "^,+|,+$", "")), lambda x: x.rlike("^[\"']"))
    names = F.transform(own, lambda x: _cut(F.regexp_replace(x, "^[\"']+|[\"']+$", ""), r"==|>=|<=|~=|!=|>|<|\[| |\("))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x.rlike(r"^[\p{L}\p{N}_.-]+$"))))


def manifest_names(manifests: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """ecosystem and name of every dependency of manifests (name, text); by: columns that name a repository."""
    file = F.lower("name")
    rows = manifests.select(
        *by,
        F.when(file == "package.json", "npm").otherwise("python").alias("ecosystem"),
        F.when(file == "package.json", npm_names(F.col("text"))).when(file == "pyproject.toml", quoted_names(F.col("text"))).when(file.isin("requirements.txt", "pipfile"), requirement_names(F.col("text"))).alias("names"),
    )
    return rows.select(*by, "ecosystem", F.explode("names").alias("name")).distinct()


def frameworks(manifests: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """framework, category, confidence, evidence and place, by the strongest evidence of each rule; by: columns that name a repository."""
    spark = manifests.sparkSession
    rules = []
    for i, (name, kind, npm, python, markers, needles) in enumerate(V.FRAMEWORKS):
        rules += [(i, name, kind, "npm", x, None, V.DEPENDENCY_CONFIDENCE) for x in npm]
        rules += [(i, name, kind, "python", x, None, V.DEPENDENCY_CONFIDENCE) for x in python]
        rules += [(i, name, kind, "file", x, None, V.MARKER_CONFIDENCE) for x in markers]
        rules += [(i, name, kind, "text", x, needle, V.MANIFEST_CONFIDENCE) for x, needle in needles]
    table = F.broadcast(spark.createDataFrame(rules, "rule int, framework string, category string, source string, key string, needle string, weight double"))  # a fixed table
    deps = manifest_names(manifests, by).select(*by, F.col("ecosystem").alias("source"), F.col("name").alias("key"), F.lit(None).cast("string").alias("body"))
    present = manifests.select(*by, F.explode(F.array(F.lit("file"), F.lit("text"))).alias("source"), F.lower("name").alias("key"), F.lower("text").alias("body"))
    met = deps.unionByName(present).join(table, ["source", "key"]).where("needle is null or contains(body, needle)")
    shown = F.concat_ws(":", "source", "key")
    grouped = met.groupBy(*by, "rule", "framework", "category").agg(F.round(F.least(F.lit(1.0), F.max("weight")), 3).alias("confidence"), F.concat_ws(",", F.array_sort(F.collect_set(shown))).alias("evidence"))
    from pyspark.sql.window import Window

    order = Window.partitionBy(*by).orderBy(F.desc("confidence"), "rule")  # at most a row a rule
    return grouped.withColumn("place", F.row_number().over(order)).select(*by, "framework", "category", "confidence", "evidence", "place")
