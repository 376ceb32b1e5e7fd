"""Import specifiers: their first segment, and whether they stay inside the repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_segment(module: Column) -> Column:
    """The scope and package of a scoped name, else what comes before the first slash, else before the first dot."""
    m = F.trim(module)
    return (
        F.when(m.startswith("@") & m.contains("/"), F.array_join(F.slice(F.split(m, "/"), 1, 2), "/"))
        .when(m.contains("/"), F.split(m, "/")[0])
        .otherwise(F.split(m, r"\.")[0])
    )


def top_names(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """name: the top folders of paths, and the stems of files at the top."""
    nested = F.col("path").contains("/")
    return files.select(*by, F.when(nested, F.split("path", "/")[0]).otherwise(F.regexp_replace("path", r"(.)\.[^.]*$", "$1")).alias("name")).distinct()


def located(imports: DataFrame, files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """imports (module, is_relative, ...) with segment and is_external; by: columns of both that name a repository."""
    names = top_names(files, by).select(*by, F.col("name").alias("segment"), F.lit(True).alias("_here"))
    own = imports.withColumn("segment", top_segment(F.col("module"))).join(names, [*by, "segment"], "left")
    return own.withColumn("is_external", ~(F.col("is_relative") | F.coalesce("_here", F.lit(False)))).drop("_here")


def visibility(language: Column, name: Column, exported: Column, declaration: Column) -> Column:
    """public, protected, private or internal, by the rules of each language."""
    d = F.trim(declaration)
    python = F.when(name.rlike("^__.*__$"), "public").when(name.startswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public")
    script = F.when(name.rlike("^[#_]"), "private").when(exported, "public").otherwise("internal")
    worded = F.when(d.contains("private"), "private").when(d.contains("protected"), "protected").when(d.contains("public"), "public").otherwise("internal")
    return (
        F.when(language == "python", python)
        .when(language.isin("javascript", "jsx", "typescript", "tsx"), script)
        .when(language.isin("java", "csharp"), worded)
        .when(language == "go", F.when(name.rlike(r"^\p{Lu}"), "public").otherwise("internal"))
        .when(language == "rust", F.when(d.startswith("pub"), "public").otherwise("private"))
        .otherwise(F.when(exported, "public").otherwise("internal"))
    )
