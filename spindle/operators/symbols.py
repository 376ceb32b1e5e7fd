"""Declarations in source files, and the lines they span, for many languages in one pass over the lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.functions import text as T
from spindle.operators.code import ENUM_BASES, LINE_PATTERNS, ends_of_blocks

FILE = ("repository", "path")
#: Which patterns and which rule for spans a language takes; others have no symbols.
FAMILIES = {"python": "python", "javascript": "js", "jsx": "js", "typescript": "js", "tsx": "js", "java": "java", "go": "go", "rust": "rust", "csharp": "csharp"}
SYMBOL = "repository string, path string, kind string, symbol string, parent string, first int, last int, is_async boolean, exported boolean, decorators array<string>, bases array<string>, prefix string"
_FIELDS = [part.split(" ")[0] for part in SYMBOL.split(", ")]

#: Files whose lines a worker holds as Python strings are one; those whose results it holds are so many.
FILES_AT_ONCE = 64
_STRINGS = r"""\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|#.*$"""
_TRIPLE = "\"\"\"|'''"


def _of(family: str) -> Column:
    return F.col("language").isin([x for x, own in FAMILIES.items() if own == family])


def numbered_lines(files: DataFrame, *columns: str) -> DataFrame:
    """A row a line of files (repository, path, language, text): its number from 1, and code."""
    return files.select(*FILE, "language", *columns, F.posexplode(T.lines(F.col("text"))).alias("at", "code")).withColumn("line", F.col("at") + 1).drop("at")


def _line_marks(family: str, code: Column) -> Column:
    """What a line of the family's languages imports, exports or declares: an array of (what, name)."""
    ranks: dict[int, tuple[str, Column]] = {}
    for kind, rank, pattern in reversed(LINE_PATTERNS[family]):  # the first pattern of a rank that matches counts
        before = ranks[rank][1] if rank in ranks else F.lit(None).cast("string")
        ranks[rank] = (kind, F.when(code.rlike(pattern), F.regexp_extract(code, pattern, 1)).otherwise(before))
    own = F.array(*[F.struct(F.lit(kind).alias("what"), name.alias("name")) for _, (kind, name) in sorted(ranks.items())])
    return F.filter(own, lambda s: s["name"].isNotNull())


def marked(files: DataFrame) -> DataFrame:
    """Files (repository, path, language, text) of the languages that line patterns describe, with marks: an array of (line, code, what, name), in the row."""
    def of_file(family: str) -> Column:
        placed = lambda code, i: F.transform(_line_marks(family, code), lambda s: F.struct((i + 1).alias("line"), code.alias("code"), s["what"].alias("what"), s["name"].alias("name")))
        return F.flatten(F.transform(T.lines(F.col("text")), placed))

    marks = F.lit(None)
    for family in LINE_PATTERNS:
        marks = F.when(_of(family), of_file(family)).otherwise(marks)
    return files.where(F.col("language").isin([x for x, own in FAMILIES.items() if own != "python"])).select(*FILE, "language", "text", marks.alias("marks"))


def declared(files: DataFrame) -> DataFrame:
    """repository, path, language, line, code, what and name: a row for each mark."""
    return marked(files).select(*FILE, "language", F.explode("marks").alias("m")).select(*FILE, "language", "m.*")


def braced(files: DataFrame) -> DataFrame:
    """The declarations of marked files with last, where their block in braces ends, and types: the file's classes as (line, last, name, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, FILES_AT_ONCE):
                batch = whole.slice(low, FILES_AT_ONCE)
                lasts = []
                for text, starts in zip(batch["text"], batch["starts"], strict=True):
                    starts = starts.as_py()
                    ends = ends_of_blocks(text.as_py().split("\n"), starts)
                    lasts.append([ends[start] for start in starts])
                kept = batch.select(["repository", "path", "language", "marks"])
                yield kept.append_column("lasts", pa.array(lasts, pa.list_(pa.int32())))

    own = marked(files).withColumn("marks", F.filter("marks", lambda m: ~m["what"].isin("import", "export"))).where(F.size("marks") > 0)
    kind = own.schema["marks"].dataType.simpleString()
    own = own.withColumn("starts", F.transform("marks", lambda m: m["line"].cast("int")))
    ended = own.mapInArrow(run, f"repository string, path string, language string, marks {kind}, lasts array<int>")
    zipped = F.zip_with("marks", "lasts", lambda m, e: F.struct(m["line"].alias("line"), e.alias("last"), m["name"].alias("name"), m["code"].alias("code"), m["what"].alias("what")))
    ended = ended.select(*FILE, "language", zipped.alias("marks"))
    types = F.transform(F.filter("marks", lambda m: m["what"] == "class"), lambda m: m.dropFields("what"))
    return ended.select(*FILE, "language", types.alias("types"), F.explode("marks").alias("m")).select(*FILE, "language", "types", "m.*")


def _symbol(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = dict(part.split(" ", 1) for part in SYMBOL.split(", "))
    return df.select(*FILE, *[columns.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in _FIELDS[2:]])


def _script_kind(components: Column) -> Column:
    provider = F.col("name").rlike("(Provider|Context)$") | F.col("code").contains("createContext")
    of_function = (
        F.when(components & F.col("name").rlike(r"^\p{Lu}"), F.when(provider, "context_provider").otherwise("component"))
        .when(F.col("name").rlike("^use[A-Z]"), "hook")
        .when(F.col("exported"), "utility_function")
        .otherwise(F.when(F.col("is_async"), "async_function").otherwise("function"))
    )
    return F.when(F.col("what") == "function", of_function).when(F.col("what") == "type", "type_alias").otherwise(F.col("what"))


def _family_kind() -> Column:
    kind, lower = F.lit("class"), F.lower("code")
    for word in reversed(("interface", "enum", "record", "struct", "trait")):
        kind = F.when(lower.rlike(rf"\b{word}\b"), word).otherwise(kind)
    of_function = F.when(F.col("owner").isNotNull(), "method").otherwise(F.when(F.col("is_async"), "async_function").otherwise("function"))
    return F.when(F.col("what") == "class", kind).otherwise(of_function)


def brace_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files in JavaScript, TypeScript, Java, Go, Rust and C#.

    Of the latter four, a function within a class's lines is a method of the first such class.
    """
    script, function = _of("js"), F.col("what") == "function"
    waits = F.when(script, F.col("code").rlike(r"^\s*(export\s+)?(default\s+)?async\s|=\s*async[\s(]")).otherwise(F.col("code").contains("async"))
    owner = F.get(F.filter("types", lambda t: F.col("line").between(t["line"], t["last"])), F.lit(0))
    own = braced(files).withColumns({"is_async": function & waits, "exported": script & F.col("code").rlike(r"^\s*export\s"), "owner": F.when(~script & function, owner)})
    kind = F.when(script, _script_kind(F.col("language").isin("jsx", "tsx"))).otherwise(_family_kind())
    return _symbol(own, kind=kind, symbol=F.col("name"), parent=F.col("owner.name"), first=F.col("line"), last=F.col("last"), is_async=F.col("is_async"), exported=F.col("exported"), prefix=F.col("owner.code"))


def python_lines(files: DataFrame) -> DataFrame:
    """A row a line of Python files, with the statements it belongs to, by indentation.

    begins: a statement begins in the line: it is no comment, no line of a longer string or bracket,
    and no continued line. content: it holds a part of a statement. top and member number the
    statements of the module and, within one of a class, those of its body.
    """
    listed = F.regexp_extract("text", r"(?m)^__all__\s*(?::[^=]+)?=\s*[\[(]([^\])]*)", 1)
    names = F.transform(F.regexp_extract_all(listed, F.lit("[\"']([^\"']*)[\"']"), F.lit(1)), lambda x: x)
    code = F.col("code")
    rows = numbered_lines(files.where(_of("python")).withColumn("listed", names), "listed")
    plain = F.regexp_replace(F.regexp_replace(code, _TRIPLE, ""), _STRINGS, "")
    count = lambda chars: F.length(plain) - F.length(F.translate(plain, chars, ""))
    before = Window.partitionBy(*FILE).orderBy("line")
    past = before.rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum(F.regexp_count(code, F.lit(_TRIPLE))).over(past), F.lit(0)) % 2 == 1
    rows = rows.withColumns({"in_text": odd, "visible": F.trim(F.regexp_replace(code, r"\s", "")) != "", "indent": F.length(F.regexp_extract(code, r"^\s*", 0))})
    deep = F.coalesce(F.sum(F.when(F.col("in_text"), 0).otherwise(count("([{") - count(")]}"))).over(past), F.lit(0)) > 0
    carried = F.coalesce(F.lag(code.rlike(r"\\$")).over(before), F.lit(False))
    rows = rows.withColumn("within", F.col("in_text") | deep | carried)
    rows = rows.withColumn("begins", F.col("visible") & ~F.col("within") & ~code.rlike(r"^\s*#"))
    rows = rows.withColumns({"content": F.col("begins") | F.col("within") & F.col("visible"), "decorates": F.col("begins") & code.rlike(r"^\s*@")})
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"top": F.sum((F.col("begins") & (F.col("indent") == 0)).cast("int")).over(upto), "plain": F.sum((F.col("begins") & ~F.col("decorates")).cast("int")).over(upto)})
    rows = rows.withColumn("decorated", F.col("plain") + F.col("decorates").cast("int"))
    inner = Window.partitionBy(*FILE, "top").orderBy("line")
    depth = F.min_by("indent", F.when(F.col("begins") & (F.col("indent") > 0), F.col("line"))).over(Window.partitionBy(*FILE, "top"))
    rows = rows.withColumn("depth", depth)
    return rows.withColumn("member", F.sum((F.col("begins") & (F.col("indent") <= F.col("depth"))).cast("int")).over(inner.rowsBetween(Window.unboundedPreceding, 0)))


def _python_kind() -> Column:
    bases = F.exists("bases", lambda b: F.element_at(F.split(F.split(b, r"\[")[0], r"\."), -1).isin(*ENUM_BASES))
    return F.when(F.exists("decorators", lambda d: F.lower(d).contains("dataclass")), "dataclass").when(bases, "enum").otherwise("class")


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of Python files: functions and classes of the module, methods of these classes, groups of constants.

    Spans end with the last line of a block's last statement. A class with methods spans the lines
    before the first of them. Decorators are those of one line. All is told by windows within a file.
    """
    rows, code, line = python_lines(files), F.col("code"), F.col("line")
    over = lambda *keys: Window.partitionBy(*FILE, *keys)
    marks = F.collect_list(F.when(F.col("decorates"), F.struct("line", F.trim(F.substr(F.trim(code), F.lit(2))).alias("name")))).over(over("decorated"))
    last = lambda *keys: F.max(F.when(F.col("content"), line)).over(over(*keys))
    head = F.col("begins") & code.rlike(r"^\s*((async\s+)?def|class)\s+\w")
    rows = rows.withColumns({
        "decorators": F.transform(F.array_sort(marks), lambda m: m["name"]), "top_last": last("top"), "member_last": last("top", "member"),
        "what": F.when(head, F.when(code.rlike(r"^\s*class\b"), "class").otherwise("def")), "name": F.regexp_extract(code, r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)", 1),
        "is_async": code.rlike(r"^\s*async\s"),
    })
    rows = rows.withColumn("block", F.max(F.when(F.col("what").isNotNull() & (F.col("indent") == 0), F.struct("what", "name", "code"))).over(over("top")))
    rows = rows.withColumn("is_method", F.coalesce((F.col("what") == "def") & (F.col("indent") > 0) & (F.col("indent") == F.col("depth")) & (F.col("block.what") == "class"), F.lit(False)))
    named = F.col("block").isNull() & code.rlike(r"^[A-Z][A-Z0-9_]*\s*(:[^=]+)?=")
    rows = rows.withColumns({"method": F.min(F.when(F.col("is_method"), line)).over(over("top")), "constant": named})
    order = over("constant").orderBy("line")
    rows = rows.withColumn("apart", F.coalesce(line - F.lag("line").over(order) > 2, F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("run_last", F.max("line").over(over("constant", "run")))

    top, starts = F.col("what").isNotNull() & (F.col("indent") == 0), F.col("constant") & (F.col("apart") == 1)
    rows = rows.where(top | F.col("is_method") | starts)
    inside = F.regexp_extract(code, r"^\s*class\s+\w+\s*\((.*)\)\s*:", 1)
    bases = F.filter(F.transform(F.split(inside, r",(?![^\[(]*[\])])"), lambda b: F.trim(b)), lambda b: (b != "") & ~b.rlike(r"^\w+\s*=[^=]"))
    rows = rows.withColumn("bases", F.when(F.col("what") == "class", bases).otherwise(F.array().cast("array<string>")))
    is_class = F.col("what") == "class"
    shown = F.when(F.size("listed") > 0, F.array_contains("listed", F.col("name"))).otherwise(~F.col("name").startswith("_"))
    plain = F.when(is_class, _python_kind()).otherwise(F.when(F.col("is_async"), "async_function").otherwise("function"))
    return _symbol(
        rows,
        kind=F.when(F.col("constant"), "module_constants").when(F.col("is_method"), "method").otherwise(plain),
        symbol=F.when(F.col("constant"), F.concat(F.lit("constants@"), line.cast("string"))).otherwise(F.col("name")),
        parent=F.when(F.col("is_method"), F.col("block.name")), first=line,
        last=F.when(F.col("constant"), F.col("run_last")).when(F.col("is_method"), F.col("member_last")).when(is_class & F.col("method").isNotNull(), F.greatest(line, F.col("method") - 1)).otherwise(F.col("top_last")),
        is_async=~F.col("constant") & F.col("is_async"), exported=F.col("constant") | ~F.col("is_method") & shown,
        decorators=F.when(F.col("constant"), F.array().cast("array<string>")).otherwise(F.col("decorators")), bases=F.col("bases"), prefix=F.when(F.col("is_method"), F.col("block.code")),
    )


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of all files (repository, path, language, text), by the rules of their languages.

    Languages that aren't in FAMILIES, null texts and files without declarations give none. first and
    last are lines from 1; prefix is the declaring line of a method's class.
    """
    return python_symbols(files).unionByName(brace_symbols(files))
