"""Files of a tree: a data source that lists and reads them, and what names and sizes tell."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spindle.functions import vocabulary as V
from spindle.functions.text import extension
from spindle.session import ship

_SCHEMA = "path string, name string, size_bytes long, binary boolean, readable boolean, content binary"


def decoded(raw: bytes) -> str:
    """Text of a file by the first encoding that fits, with line ends as \\n."""
    for name in ("utf-8", "utf-8-sig", "utf-16", "latin-1"):
        try:
            return raw.decode(name).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeError:
            continue
    return ""


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(os.path.expanduser(options["path"]))
        self.most = int(options.get("maxBytes", V.MAX_FILE_BYTES))

    def partitions(self) -> list[_Part]:
        """The root's own files, and each folder below it that isn't pruned."""
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        inner = sorted(d.path for d in os.scandir(self.root) if d.is_dir(follow_symlinks=False) and not pruned(d.name))
        return [_Part(self.root, False), *[_Part(d, True) for d in inner]]

    def read(self, part: _Part) -> Iterator[tuple]:
        for folder, inner, names in os.walk(part.folder):
            inner[:] = sorted(d for d in inner if not pruned(d)) if part.deep else []
            for name in sorted(names):
                full = os.path.join(folder, name)
                path = os.path.relpath(full, self.root).replace(os.sep, "/")
                try:
                    size = os.stat(full).st_size
                    raw = b""
                    if size <= self.most:
                        with open(full, "rb") as f:
                            raw = f.read()
                    yield path, name, size, b"\0" in raw[: V.SNIFFED_BYTES], True, raw
                except OSError:
                    yield path, name, 0, False, False, b""


class FileTree(DataSource):
    """spark.read.format("filetree").load(root): every file below root outside pruned folders.

    Names with a leading underscore are kept, which Spark's own file sources drop. The root is on a
    file system that all executors mount.
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def pruned(folder: str) -> bool:
    return folder in V.IGNORED_DIRECTORIES or folder.startswith(".")


def read_tree(spark: SparkSession, root: str, max_bytes: int = V.MAX_FILE_BYTES) -> DataFrame:
    """All files with skip_reason (null if accepted), language, category and text."""
    ship(spark)
    spark.dataSource.register(FileTree)
    files = spark.read.format("filetree").option("maxBytes", str(max_bytes)).load(root)
    text = F.udf(decoded, "string", useArrow=True)
    files = classified(files, max_bytes, binary=F.col("binary"), readable=F.col("readable"))
    accepted = files.where("skip_reason is null").withColumn("text", text("content"))
    return accepted.drop("content", "binary", "readable").unionByName(files.where("skip_reason is not null").drop("content", "binary", "readable").withColumn("text", F.lit(None).cast("string")))


def skip_reason(name: Column, size: Column, max_bytes: int, binary: Column, readable: Column) -> Column:
    return (
        F.when(F.lower(name).isin(V.IGNORED_NAMES), "ignored")
        .when(name.startswith(".") & ~name.isin(".", ".."), "hidden")
        .when(extension(name).isin(V.BINARY_EXTENSIONS), "binary")
        .when(~readable, "unreadable")
        .when(size > max_bytes, "oversized")
        .when(binary, "binary")
    )


def language(name: Column) -> Column:
    by = [F.lit(x) for lang, exts in V.LANGUAGES.items() for e in exts.split() for x in (e, lang)]
    return F.coalesce(F.element_at(F.create_map(*by), extension(name)), F.lit("unknown"))


def category(lang: Column, name: Column) -> Column:
    return (
        F.when(F.lower(name).isin(V.CONFIG_NAMES), "config")
        .when(lang.isin("python", "javascript", "jsx", "typescript", "tsx", "java", "kotlin", "go", "rust", "csharp", "dart", "shell", "sql"), "source")
        .when(lang.isin("html", "xml", "vue", "svelte"), "markup")
        .when(lang.isin("css", "scss"), "style")
        .when(lang.isin("json", "yaml", "toml"), "data")
        .when(lang == "markdown", "documentation")
        .otherwise("other")
    )


def classified(files: DataFrame, max_bytes: int = V.MAX_FILE_BYTES, *, binary: Column | None = None, readable: Column | None = None) -> DataFrame:
    """files (name, size_bytes) with extension, language, category, is_config and skip_reason."""
    name = F.col("name")
    own = files.withColumns({"extension": extension(name), "language": language(name), "is_config": F.lower(name).isin(V.CONFIG_NAMES)})
    why = skip_reason(name, F.col("size_bytes"), max_bytes, F.lit(False) if binary is None else binary, F.lit(True) if readable is None else readable)
    return own.withColumns({"category": category(F.col("language"), name), "skip_reason": why})


def directories(files: DataFrame) -> DataFrame:
    """directory, files and languages of the folders of paths; a folder's own files only."""
    folder = F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    counts = files.groupBy(folder.alias("directory"), "language").agg(F.count("*").alias("n"))
    each = F.concat_ws("=", "language", F.col("n").cast("string"))
    return counts.groupBy("directory").agg(F.sum("n").alias("files"), F.concat_ws(",", F.array_sort(F.collect_list(each))).alias("languages"))


def repository_statistics(files: DataFrame) -> DataFrame:
    """One row: files, accepted and skipped ones, bytes, mean size and the largest accepted file."""
    ok = F.col("skip_reason").isNull()
    return files.agg(
        F.count("*").alias("files"),
        F.count_if(ok).alias("accepted"),
        F.count_if(~ok).alias("skipped"),
        F.coalesce(F.sum(F.when(ok, F.col("size_bytes"))), F.lit(0)).alias("bytes"),
        F.round(F.avg(F.when(ok, F.col("size_bytes"))), 2).alias("mean_bytes"),
        F.min_by(F.when(ok, F.col("path")), F.when(ok, F.struct((-F.col("size_bytes")).alias("s"), "path"))).alias("largest"),
    )


def languages_ranked(files: DataFrame, code: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """language, files and place: languages of code before others, then by number of files, ties by the first seen.

    by: columns that name a repository, where the table holds several; each has places of its own.
    """
    from pyspark.sql.window import Window

    counts = files.groupBy(*by, "language").agg(F.count("*").alias("files"), F.min("ordinal").alias("first"))
    order = Window.partitionBy(*by).orderBy(F.when(F.col("language").isin(*code), 0).otherwise(1), F.desc("files"), "first")  # a row a language
    return counts.withColumn("place", F.row_number().over(order)).select(*by, "language", "files", "place")


def scan_tally(files: DataFrame) -> DataFrame:
    """repository with how many of its files (repository, skip_reason) were accepted, ignored by name or content, oversized or unreadable."""
    why = F.col("skip_reason")
    return files.groupBy("repository").agg(
        F.count_if(why.isNull()).alias("accepted"), F.count_if(why.isin("ignored", "hidden", "binary")).alias("ignored"),
        F.count_if(why == "oversized").alias("oversized"), F.count_if(why == "unreadable").alias("permission_errors"),
    )


def directory_rows(files: DataFrame) -> DataFrame:
    """repository, directory, files, subdirectories and languages of every folder of files (repository, path, language, skip_reason).

    A folder is there if a file lies below it, skipped or not; the root is ".". Files count where they lie
    themselves, if accepted. Files without path are left out.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(i == 1, ".").otherwise(F.array_join(F.slice(parts, 1, i - 1), "/")))
    above = files.where("path is not null").select("repository", "language", "skip_reason", folders.alias("folders"))
    at = above.select("repository", "language", "skip_reason", "folders", F.posexplode("folders").alias("depth", "directory"))
    own = (F.col("depth") == F.size("folders") - 1) & F.col("skip_reason").isNull()
    parent = F.when(F.col("depth") > 0, F.col("folders")[F.col("depth") - 1])
    counts = at.groupBy("repository", "directory", "language").agg(F.count_if(own).alias("n"), F.max(parent).alias("parent"))
    shown = F.when(F.col("n") > 0, F.concat_ws("=", "language", F.col("n").cast("string")))
    rows = counts.groupBy("repository", "directory").agg(F.sum("n").alias("files"), F.concat_ws(",", F.array_sort(F.collect_list(shown))).alias("languages"), F.max("parent").alias("parent"))
    below = rows.where("parent is not null").groupBy("repository", F.col("parent").alias("directory")).agg(F.count("*").alias("n"))
    return rows.drop("parent").join(below, ["repository", "directory"], "left").select("repository", "directory", "files", F.coalesce("n", F.lit(0)).cast("long").alias("subdirectories"), "languages")


def repository_rows(files: DataFrame) -> DataFrame:
    """One row a repository of files (repository, path, language, size_bytes, n_lines, parse_error, skip_reason).

    Accepted files, those of a known language, parsed and failed ones, skipped ones (unreadable ones are none of
    these; a null parse_error is none), folders, bytes, lines, the mean size to two places, the largest file (of equal ones the first path)
    and the files of each language. A repository without accepted files has zeros and no largest file.
    """
    ok = F.col("skip_reason").isNull()
    when = lambda c: F.when(ok, F.col(c))
    largest = F.min(F.when(ok, F.struct((-F.col("size_bytes")).alias("s"), F.col("path").alias("path"))))
    by_language = files.groupBy("repository", "language").agg(
        F.count_if(ok).alias("n"), F.count_if(ok & F.col("parse_error")).alias("failed"), F.count_if(~ok & (F.col("skip_reason") != "unreadable")).alias("ignored"),
        F.sum(when("size_bytes")).alias("bytes"), F.sum(when("n_lines")).alias("lines"), largest.alias("largest"),
    )
    known, n = F.col("language") != "unknown", F.col("n")
    parsed = F.when(F.col("language").isin(*V.PARSED_LANGUAGES), n - F.col("failed"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    shown = F.when(n > 0, F.concat_ws("=", "language", n.cast("string")))
    rows = by_language.groupBy("repository").agg(
        total(n).alias("files"), total(F.when(known, n)).alias("supported"), total(parsed).alias("parsed"), total("failed").alias("failed"), total("ignored").alias("ignored"),
        total("bytes").alias("bytes"), total("lines").alias("lines"), F.min("largest").getField("path").alias("largest"), F.concat_ws(",", F.array_sort(F.collect_list(shown))).alias("languages"),
    )
    folders = directory_rows(files).groupBy("repository").agg(F.count("*").alias("directories"))
    mean = F.when(F.col("files") > 0, F.round(F.col("bytes") / F.col("files"), 2)).otherwise(F.lit(0.0))
    return rows.join(folders, "repository", "left").withColumns({"mean_bytes": mean, "directories": F.coalesce("directories", F.lit(0)).cast("long")})
