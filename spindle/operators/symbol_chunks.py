"""Chunks by symbol: one table out of files of any language, and typed relations between its chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.functions import text as T
from spindle.functions import vocabulary as V
from spindle.operators import imports
from spindle.operators.chunking import islands, merged
from spindle.operators.symbols import FAMILIES, FILE, symbols

#: Kinds of chunks that stand for a whole file, by language; others are modules.
WHOLE_KINDS = {"markdown": "document", "css": "style", "scss": "style", "html": "markup", "xml": "markup", "vue": "markup", "svelte": "markup", "json": "data", "yaml": "data", "toml": "data"}
#: Kinds that stay whole, however long.
WHOLE = ("config_file", "data", "style", "interface", "type_alias", "enum", "record", "struct", "trait", "module_constants")
_PYTHON_TYPES = ("class", "dataclass", "enum")
_IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"


def _named(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_kind() -> Column:
    """config_file for configuration by name, else by language."""
    by_language = F.lit("module")
    for language, kind in WHOLE_KINDS.items():
        by_language = F.when(F.col("language") == language, kind).otherwise(by_language)
    return F.when(F.lower(_named(F.col("path"))).isin(*V.CONFIG_NAMES), "config_file").otherwise(by_language)


def _pieces(most_lines: int, least_lines: int) -> Column:
    """Spans of a symbol as (first, last, part, parts): one, or for a long one the head and its blocks."""
    n = F.col("s.last") - F.col("s.first") + 1
    body = F.slice("all_lines", F.col("s.first"), F.greatest(n, F.lit(0)))
    shifted = F.transform(merged(islands(body), least_lines), lambda b: F.struct((b["first"] + F.col("s.first") - 1).alias("first"), (b["last"] + F.col("s.first") - 1).alias("last")))
    fixed = F.col("s.kind").isin(*WHOLE) | (F.col("language") == "python") & F.col("s.kind").isin(*_PYTHON_TYPES) | F.col("language").isin("java", "go", "rust", "csharp") & (F.col("s.kind") == "class")
    blocks = F.when((n > most_lines) & ~fixed, shifted)
    whole = F.array(F.struct(F.col("s.first").alias("first"), F.col("s.last").alias("last"), F.lit(0).alias("part"), F.lit(0).alias("parts")))
    return T.let(
        F.coalesce(blocks, F.array().cast("array<struct<first:int,last:int>>")),
        lambda bs: F.when(F.size(bs) < 2, whole).otherwise(
            F.transform(bs, lambda b, i: F.struct(F.when(i == 0, F.col("s.first")).otherwise(b["first"]).alias("first"), b["last"].alias("last"), i.cast("int").alias("part"), (F.size(bs) - 1).alias("parts")))
        ),
    )


def symbol_chunks(files: DataFrame, *, most_lines: int = 200, least_lines: int = 8) -> DataFrame:
    """Chunks of files (repository, path, language, text), one row each.

    Columns: chunk_id, repository, path, language, kind, symbol, parent, start_line, end_line,
    signature, is_async, exported, decorators, bases, visibility, part, parts, hash, content, n_lines, n_chars,
    n_tokens. Code is cut by its symbols; a file without any, a configuration file and any other
    language is one chunk of its own. Symbols, documents and markup of more than most_lines lines are
    split at blank lines into blocks of least_lines at least: the head keeps the symbol, blocks are parts of it.
    Content has the class's declaring line before a method and the block's number before a block;
    counts are those of the lines alone. Blank and null texts give no chunk. Files are keyed by repository and
    path, empty if null; of rows that repeat a key, the one of the greatest text counts.
    """
    files = files.withColumns({c: F.coalesce(c, F.lit("")) for c in FILE})
    own = files.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy(*FILE).agg(F.max(F.struct("text", "language")).alias("f")).select(*FILE, F.coalesce("f.language", F.lit("unknown")).alias("language"), "f.text")
    config = file_kind() == "config_file"
    coded = own.where(F.col("language").isin(*FAMILIES) & ~config)
    held = symbols(coded).groupBy(*FILE).agg(F.collect_list(F.struct("kind", "symbol", "parent", "first", "last", "is_async", "exported", "decorators", "bases", "prefix")).alias("own"))
    joined = own.join(held, list(FILE), "left").withColumn("all_lines", T.lines(F.col("text")))
    none = F.array().cast("array<string>")
    whole = F.struct(file_kind().alias("kind"), _named(F.col("path")).alias("symbol"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("first"), F.size("all_lines").alias("last"), F.lit(False).alias("is_async"), F.lit(False).alias("exported"), none.alias("decorators"), none.alias("bases"), F.lit(None).cast("string").alias("prefix"))
    # a coded file's fallback is a module, which may be split; a file of an unknown language stays whole
    joined = joined.withColumn("fixed", F.col("own").isNull() & ~F.col("language").isin(*FAMILIES) & (file_kind() == "module"))
    spread = joined.select(*FILE, "language", "all_lines", "fixed", F.explode(F.coalesce("own", F.array(whole))).alias("s"))
    cut = spread.select(*FILE, "language", "all_lines", "s", F.explode(F.when(F.col("fixed"), _pieces(1 << 30, least_lines)).otherwise(_pieces(most_lines, least_lines))).alias("p"))
    part = F.col("p.part")
    body = T.span(F.col("all_lines"), F.col("p.first"), F.col("p.last"))
    number = part.cast("string")
    made = cut.select(
        *FILE, "language",
        F.when(part > 0, "block").otherwise(F.col("s.kind")).alias("kind"),
        F.when(part > 0, F.concat("s.symbol", F.lit("#block"), number)).otherwise(F.col("s.symbol")).alias("symbol"),
        F.when(part > 0, F.col("s.symbol")).otherwise(F.col("s.parent")).alias("parent"),
        F.col("p.first").alias("start_line"), F.col("p.last").alias("end_line"),
        (F.col("s.is_async") & (part == 0)).alias("is_async"), (F.col("s.exported") & (part == 0)).alias("exported"),
        *[F.when(part > 0, none).otherwise(F.coalesce(f"s.{c}", none)).alias(c) for c in ("decorators", "bases")],
        part.alias("part"), F.col("p.parts").alias("parts"), body.alias("body"),
        F.when(part > 0, F.concat(F.lit("# section "), number, F.lit(" of "), F.col("s.symbol"))).when(F.col("p.parts") == 0, F.col("s.prefix")).alias("prefix"),
    )
    content = F.when(F.coalesce("prefix", F.lit("")) != "", F.concat(F.rtrim("prefix"), F.lit("\n\n"), F.col("body"))).otherwise(F.col("body"))
    seen = F.get(F.filter(T.lines(F.col("body")), lambda x: F.trim(x) != ""), F.lit(0))
    made = made.withColumns({"content": content, "signature": F.coalesce(F.trim(seen), F.col("symbol"))})
    return made.select(
        T.chunk_id(F.col("repository"), F.col("path"), F.col("symbol"), F.col("kind"), F.col("start_line")).alias("chunk_id"),
        *FILE, "language", "kind", "symbol", "parent", "start_line", "end_line", "signature", "is_async", "exported", "decorators", "bases",
        imports.visibility(F.col("language"), F.col("symbol"), F.col("exported"), F.col("signature")).alias("visibility"),
        "part", "parts", T.content_hash(F.col("content")).alias("hash"), "content", T.line_count(F.col("body")).alias("n_lines"), F.length("body").cast("long").alias("n_chars"), T.token_estimate(F.col("body")).alias("n_tokens"),
    )


def _edge(df: DataFrame, relation: str, chunk: Column, symbol: Column, target: Column) -> DataFrame:
    return df.select(chunk.alias("chunk_id"), F.lit(relation).alias("relation"), symbol.alias("target_symbol"), target.cast("string").alias("target_id"))


def relations(chunks: DataFrame) -> DataFrame:
    """chunk_id, relation, target_symbol, target_id of what chunks (of symbol_chunks) are to each other.

    method_of from each method to the first class of that name above it in its file, and has_method
    back (Python); part_of from each block to the head of its symbol and has_part back; extends from a Python
    class to its bases, whose chunks aren't looked for; uses_hook and uses_type from components and
    providers to what their text names: types of the same file, and hooks anywhere, whose target_id
    is null where the file has none. Joins are by file and name; no pair of chunks is compared.
    """
    key = list(FILE)
    heads = chunks.where(F.col("part") == 0)
    kinds = ("class", "dataclass", "enum", "interface", "record", "struct", "trait")
    owners = heads.where(F.col("kind").isin(*kinds)).select(*key, F.col("symbol").alias("parent"), F.col("chunk_id").alias("owner_id"), F.col("start_line").alias("owner_line"))
    methods = heads.where("kind = 'method'").select(*key, "chunk_id", "symbol", "parent", "language", "start_line").join(owners, [*key, "parent"]).where("owner_line <= start_line")
    nearest = Window.partitionBy("chunk_id").orderBy(F.when(F.col("language") == "python", -F.col("owner_line")).otherwise(F.col("owner_line")))
    methods = methods.withColumn("at", F.row_number().over(nearest)).where("at = 1")
    out = _edge(methods, "method_of", F.col("chunk_id"), F.col("parent"), F.col("owner_id"))
    out = out.unionByName(_edge(methods.where("language = 'python'"), "has_method", F.col("owner_id"), F.col("symbol"), F.col("chunk_id")))

    split = heads.where("parts > 0").select(*key, F.col("symbol").alias("parent"), F.col("chunk_id").alias("head_id"), F.col("start_line").alias("head_line"))
    blocks = chunks.where("part > 0").select(*key, "chunk_id", "symbol", "parent", "start_line").join(split, [*key, "parent"]).where("head_line <= start_line")
    blocks = blocks.withColumn("at", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("head_line")))).where("at = 1")
    out = out.unionByName(_edge(blocks, "part_of", F.col("chunk_id"), F.col("parent"), F.col("head_id"))).unionByName(_edge(blocks, "has_part", F.col("head_id"), F.col("symbol"), F.col("chunk_id")))

    bases = heads.where("language = 'python'").select("chunk_id", F.explode("bases").alias("base"))
    out = out.unionByName(_edge(bases, "extends", F.col("chunk_id"), F.col("base"), F.lit(None)))

    users = chunks.where(F.col("kind").isin("component", "context_provider")).select(*key, "chunk_id", F.col("symbol").alias("user"), "content")
    hooks = users.select(*key, "chunk_id", "user", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b(use[A-Z][A-Za-z0-9_$]*)\s*\("), F.lit(1)))).alias("name")).where("name <> user")
    last = lambda kinds_: heads.where(F.col("kind").isin(*kinds_)).groupBy(*key, F.col("symbol").alias("name")).agg(F.max_by("chunk_id", "start_line").alias("target"))
    hooks = hooks.join(last(["hook"]), [*key, "name"], "left")
    words = users.select(*key, "chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_IDENTIFIER), F.lit(0)))).alias("name"))
    types = words.join(last(["interface", "type_alias", "enum"]), [*key, "name"])
    out = out.unionByName(_edge(hooks, "uses_hook", F.col("chunk_id"), F.col("name"), F.col("target")))
    return out.unionByName(_edge(types, "uses_type", F.col("chunk_id"), F.col("name"), F.col("target")))


def file_rows(files: DataFrame) -> DataFrame:
    """One row a file (repository, path, language, text): counts of imports, functions, classes, lines; and whether its language is known.

    A file of a language that no rule describes has zeros; unknown languages are flagged, for the share of them
    in a repository.
    """
    own = symbols(files).groupBy(*FILE).agg(
        F.count_if(F.col("kind").isin("function", "async_function", "method", "component", "context_provider", "hook", "utility_function")).alias("functions"),
        F.count_if(F.col("kind").isin("class", "dataclass", "interface", "enum", "record", "struct", "trait", "type_alias")).alias("types"),
        F.count_if("is_async").alias("asynchronous"),
    )
    lines = numbered_imports(files).groupBy(*FILE).agg(F.count("*").alias("imports"))
    out = files.select(*FILE, "language", T.line_count(F.col("text")).alias("n_lines")).join(own, list(FILE), "left").join(lines, list(FILE), "left")
    return out.select(*FILE, "language", "n_lines", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("imports", "functions", "types", "asynchronous")], (F.coalesce("language", F.lit("unknown")) == "unknown").alias("unknown"))


def numbered_imports(files: DataFrame) -> DataFrame:
    """repository, path, line and module of imports of all languages with rules."""
    from spindle.operators.symbols import declared, python_lines

    python = python_lines(files).where("begins").select(*FILE, "line", F.regexp_extract("code", r"^\s*(?:from\s+([.\w]+)\s+import|import\s+([\w.]+))", 1).alias("a"), F.regexp_extract("code", r"^\s*import\s+([\w.]+)", 1).alias("b"))
    python = python.select(*FILE, "line", F.when(F.col("a") != "", F.col("a")).otherwise(F.col("b")).alias("module")).where("module <> ''")
    return python.unionByName(declared(files).where("what = 'import'").select(*FILE, "line", F.col("name").alias("module")))


def coverage(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """repository with its files, files with chunks, chunks, and the largest and smallest chunk by characters, of equal ones the first by chunk_id."""
    seen = files.groupBy("repository").agg(F.count_distinct("path").alias("files"))
    size = F.col("n_chars")
    held = chunks.groupBy("repository").agg(
        F.count_distinct("path").alias("files_with_chunks"), F.count("*").alias("chunks"),
        F.min(F.struct((-size).alias("n"), "chunk_id")).getField("chunk_id").alias("largest"), F.min(F.struct(size.alias("n"), "chunk_id")).getField("chunk_id").alias("smallest"),
    )
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files_with_chunks", "chunks")]
    return seen.join(held, "repository", "left").select("repository", "files", *counts, "largest", "smallest")


def dependency_modules(files: DataFrame) -> DataFrame:
    """repository and path with the sorted distinct modules that a file imports: internal, external (their first segment) and relative, joined by commas.

    Internal: relative ones, and those whose first segment is a folder or a file at the top of the
    repository. Files without imports have no row.
    """
    nested = F.col("path").contains("/")
    names = files.select("repository", F.when(nested, F.split("path", "/")[0]).otherwise(F.regexp_replace("path", r"(.)\.[^.]*$", "$1")).alias("segment")).distinct().withColumn("here", F.lit(True))
    own = numbered_imports(files).withColumns({"segment": imports.top_segment(F.col("module")), "relative": F.col("module").rlike("^[./]")})
    own = own.join(names, ["repository", "segment"], "left").withColumn("inside", F.col("relative") | F.coalesce("here", F.lit(False)))
    listed = lambda of, name: F.array_join(F.array_sort(F.collect_set(F.when(of, F.col(name)))), ",")
    return own.groupBy(*FILE).agg(listed(F.col("inside"), "module").alias("internal"), listed(~F.col("inside"), "segment").alias("external"), listed(F.col("relative"), "module").alias("relative_modules"))
