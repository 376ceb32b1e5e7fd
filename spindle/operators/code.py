"""Source files as symbols: per-language line patterns, Python's own syntax tree, ends of blocks."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.functions import text as T

_NAME = r"([A-Za-z0-9_$]+)"
#: Per language, kind and a pattern whose first group is the name. The first pattern of a rank that matches a line counts.
LINE_PATTERNS = {
    "js": (
        ("import", 0, r"^\s*import\s+(?:type\s+)?.+?\s+from\s+['\"]([^'\"]+)['\"]"),
        ("import", 0, r"^\s*import\s+['\"]([^'\"]+)['\"]"),
        ("import", 0, r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"),
        ("export", 1, rf"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\s+{_NAME}"),
        ("export", 1, rf"^\s*export\s+default\s+{_NAME}\s*;?\s*$"),
        ("function", 2, rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}"),
        ("function", 2, rf"^\s*(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\([^)]*\)|[A-Za-z0-9_$]+)\s*=>"),
        ("class", 3, rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}"),
        ("interface", 4, rf"^\s*(?:export\s+)?interface\s+{_NAME}"),
        ("type", 5, rf"^\s*(?:export\s+)?type\s+{_NAME}\s*[=<]"),
        ("enum", 6, rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{_NAME}"),
    ),
    "java": (
        ("import", 0, r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;"),
        ("class", 1, r"^\s*(?:public|private|protected)?\s*(?:final\s+|abstract\s+)?(?:class|interface|enum)\s+(\w+)"),
        ("function", 2, r"^\s*(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\("),
    ),
    "go": (
        ("import", 0, r"^\s*(?:import\s+)?\"([^\"]+)\""),
        ("class", 1, r"^\s*type\s+(\w+)\s+(?:struct|interface)"),
        ("function", 2, r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)\s*\("),
    ),
    "rust": (
        ("import", 0, r"^\s*use\s+([\w:]+)"),
        ("class", 1, r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)"),
        ("function", 2, r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*"),
    ),
    "csharp": (
        ("import", 0, r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"),
        ("class", 1, r"^\s*(?:public|private|protected|internal)?\s*(?:sealed\s+|abstract\s+|static\s+)?(?:class|interface|struct|enum)\s+(\w+)"),
        ("function", 2, r"^\s*(?:public|private|protected|internal)\s+(?:static\s+|async\s+|virtual\s+|override\s+)*[\w<>\[\]]+\s+(\w+)\s*\("),
    ),
}


def line_symbols(files: DataFrame, language: str) -> DataFrame:
    """path, line, kind and name of what a line of a file (path, text) declares, imports or exports."""
    rows = files.select("path", F.posexplode(T.lines(F.col("text"))).alias("at", "code"))
    ranks: dict[int, list[tuple[str, str]]] = {}
    for kind, rank, pattern in LINE_PATTERNS[language]:
        ranks.setdefault(rank, []).append((kind, pattern))
    found = []
    for group in ranks.values():
        name = F.lit(None).cast("string")
        for _, pattern in reversed(group):
            name = F.when(F.col("code").rlike(pattern), F.regexp_extract("code", pattern, 1)).otherwise(name)
        found.append(F.struct(F.lit(group[0][0]).alias("kind"), name.alias("name")))
    spread = rows.select("path", (F.col("at") + 1).alias("line"), F.explode(F.filter(F.array(*found), lambda s: s["name"].isNotNull())).alias("s"))
    return spread.select("path", "line", "s.kind", "s.name")


#: Bases that make a class an enumeration.
ENUM_BASES = ("Enum", "IntEnum", "StrEnum", "Flag", "IntFlag")


def _listed(tree: ast.Module) -> set[str]:
    """The names in the first literal list or tuple that the module assigns to __all__."""
    assigned = (n.value for n in tree.body if isinstance(n, ast.Assign) and "__all__" in {getattr(t, "id", None) for t in n.targets})
    shown = next((v for v in assigned if isinstance(v, (ast.List, ast.Tuple))), None)
    return {c.value for c in ast.iter_child_nodes(shown) if isinstance(getattr(c, "value", None), str)} if shown else set()


def _last_name(node: ast.AST) -> str:
    """The last part of a dotted, called or subscripted name."""
    while not isinstance(node, (ast.Name, ast.Attribute)):
        inner = getattr(node, "value", None) or getattr(node, "func", None)
        if not isinstance(inner, ast.AST):
            return ""
        node = inner
    return node.attr if isinstance(node, ast.Attribute) else node.id


def _class_kind(node: ast.ClassDef) -> str:
    """A decorator that names a dataclass comes before bases of enumerations."""
    if any("dataclass" in ast.unparse(d).lower() for d in node.decorator_list):
        return "dataclass"
    return "enum" if any(_last_name(b) in ENUM_BASES for b in node.bases) else "class"


def python_rows(path: str, text: str) -> list[tuple]:
    """(path, kind, name, parent, start, end, exported, note) of a Python file's imports, functions, classes and methods."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as error:
        return [(path, "error", None, None, getattr(error, "lineno", None), None, False, getattr(error, "msg", str(error)))]
    listed = _listed(tree)
    out: list[tuple] = []
    public = lambda name: name in listed if listed else not name.startswith("_")
    shown = lambda nodes: ", ".join(ast.unparse(n) for n in nodes)

    def function(node: ast.AST, parent: str | None) -> tuple:
        kind = "method" if parent else "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function"
        return (path, kind, node.name, parent, node.lineno, node.end_lineno, parent is None and public(node.name), shown(node.decorator_list))

    for node in tree.body:
        if isinstance(node, ast.Import):
            out += [(path, "import", a.name, None, node.lineno, node.end_lineno, False, a.asname or "") for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append((path, "import", "." * node.level + (node.module or ""), None, node.lineno, node.end_lineno, False, ", ".join(a.name for a in node.names)))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(function(node, None))
        elif isinstance(node, ast.ClassDef):
            out.append((path, _class_kind(node), node.name, None, node.lineno, node.end_lineno, public(node.name), shown(node.bases)))
            out += [function(m, node.name) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return out


def python_symbols(files: DataFrame) -> DataFrame:
    """Rows as python_rows gives them, of files (path, text); a file that doesn't parse gives one error row."""
    columns = ["path", "kind", "name", "parent", "start_line", "end_line", "exported", "note"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [x for path, text in zip(rows["path"], rows["text"], strict=True) for x in python_rows(path, text or "")]
            yield pd.DataFrame(out, columns=columns).astype({"start_line": "Int64", "end_line": "Int64"})

    return files.select("path", "text").mapInPandas(run, "path string, kind string, name string, parent string, start_line long, end_line long, exported boolean, note string")


def constant_groups(files: DataFrame, symbols: DataFrame, gap: int = 2) -> DataFrame:
    """Runs of module constants outside any function or class: path, start_line, end_line."""
    from spindle.operators.chunking import adjacent

    rows = files.select("path", F.posexplode(T.lines(F.col("text"))).alias("at", "code")).withColumn("line", (F.col("at") + 1).cast("int"))
    named = rows.where(F.col("code").rlike(r"^[A-Z][A-Z0-9_]*\s*(?::[^=]+)?="))
    spans = symbols.where("parent is null and kind not in ('import', 'error')").select("path", "start_line", "end_line")
    free = named.join(spans, (named["path"] == spans["path"]) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left_anti")
    grouped = free.groupBy("path").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return grouped.select("path", F.explode(adjacent(F.col("lines"), gap)).alias("s")).select("path", F.col("s.first").alias("start_line"), F.col("s.last").alias("end_line"))


#: Comments, strings that end with their line at the latest, and what opens, closes or ends something.
_TOKENS = re.compile(r"""//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/)?|(["'`])(?:\\[^\n]|(?!\1)[^\\\n])*\1?|[(){};]""")


def _signs(line: str, within: bool) -> tuple[list[str], bool]:
    """What opens, closes or ends something in a line, and whether a comment is open after it; within: one is before it."""
    if within and "*/" not in line:
        return [], True
    found = [m[0] for m in _TOKENS.finditer(line, line.index("*/") + 2 if within else 0)]
    last = found[-1] if found else ""
    return [x for x in found if x in "(){};"], last.startswith("/*") and (len(last) < 4 or not last.endswith("*/"))


@dataclass
class _Group:
    """Declarations with as many open parentheses, before (waiting) and after their first brace (opened): starts by open braces less lead."""

    floor: int
    lead: int = 0
    waiting: dict[int, list[int]] = field(default_factory=dict)
    opened: dict[int, list[int]] = field(default_factory=dict)

    def take(self, other: _Group) -> None:
        if len(self.waiting) + len(self.opened) < len(other.waiting) + len(other.opened):
            self.lead, self.waiting, self.opened, other.lead, other.waiting, other.opened = other.lead, other.waiting, other.opened, self.lead, self.waiting, self.opened
        for own, more in ((self.waiting, other.waiting), (self.opened, other.opened)):
            for braces, starts in more.items():
                own.setdefault(braces + other.lead - self.lead, []).extend(starts)


class _Declarations:
    """Declarations whose ends aren't found yet, all taken on by one sign at a time.

    parens counts those of the lines so far; a group has parens less its floor open. Groups are in order of
    floors, so that the last one alone, if it has none open, sees braces and semicolons.
    """

    def __init__(self) -> None:
        self.parens, self.groups = 0, []

    def add(self, group: _Group) -> None:
        at = bisect_left(self.groups, group.floor, key=lambda g: g.floor)
        if at < len(self.groups) and self.groups[at].floor == group.floor:
            self.groups[at].take(group)
        else:
            self.groups.insert(at, group)

    def begin(self, start: int) -> None:
        self.add(_Group(self.parens, waiting={0: [start]}))

    def joined(self, other: _Declarations) -> _Declarations:
        few, many = sorted((self, other), key=lambda x: len(x.groups))
        for group in few.groups:
            group.floor += many.parens - few.parens
            many.add(group)
        return many

    def ended(self, sign: str) -> list[int]:
        """The starts of the declarations that sign ends."""
        if sign in "()":
            self.parens += 1 if sign == "(" else -1
            if self.groups and self.groups[-1].floor > self.parens:
                group = self.groups.pop()
                group.floor = self.parens
                self.add(group)
            return []
        if not self.groups or self.groups[-1].floor < self.parens:
            return []
        group, out = self.groups[-1], []
        if sign == "}":
            group.lead -= 1
            out = group.opened.pop(-group.lead, [])
        else:
            waiting, group.waiting = group.waiting, {}
            if sign == ";":
                out = [s for starts in waiting.values() for s in starts]
            else:
                group.take(_Group(group.floor, group.lead, opened=waiting))
                group.lead += 1
        if not group.waiting and not group.opened:
            self.groups.pop()
        return out


def ends_of_blocks(lines: list[str], starts: Iterable[int]) -> dict[int, int]:
    """By start, the line, from 1, where the block in braces that begins at or after it ends, however far; lines are read once for all starts.

    Braces in strings, comments and parentheses don't count. A statement that a semicolon ends before
    any brace ends there; without a brace the start is the end, without its partner the last line. Nothing before a
    start counts for it, so that declarations within a comment have ends of their own.
    """
    ends = {s: s for s in starts}
    tracks: dict[bool, _Declarations] = {}  # by whether a comment is open before the line
    for number, line in enumerate(lines, 1):
        if number in ends:
            tracks.setdefault(False, _Declarations()).begin(number)
        after: dict[bool, _Declarations] = {}
        for within, track in tracks.items():
            signs, within_next = _signs(line, within)
            for sign in signs:
                ends.update(dict.fromkeys(track.ended(sign), number))
            if track.groups:
                after[within_next] = after[within_next].joined(track) if within_next in after else track
        tracks = after
    open_ = [starts for track in tracks.values() for group in track.groups for starts in group.opened.values()]
    return ends | {s: len(lines) for s in chain.from_iterable(open_)}


def block_end(lines: list[str], start: int) -> int:
    """The line where the block of one start ends."""
    return ends_of_blocks(lines, [start])[start]


def block_ends(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols (path, line, ...) with end_line; a file's symbols are looked up in its text once."""
    wanted = symbols.groupBy("path").agg(F.array_sort(F.collect_set("line")).alias("starts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, text, starts in zip(rows["path"], rows["text"], rows["starts"], strict=True):
                lines = (text or "").split("\n")
                out += [(path, start, end) for start, end in ends_of_blocks(lines, map(int, starts)).items()]
            yield pd.DataFrame(out, columns=["path", "line", "end_line"])

    ends = files.select("path", "text").join(wanted, "path").mapInPandas(run, "path string, line int, end_line int")
    return symbols.join(ends, ["path", "line"])


def dependencies(chunks: DataFrame, imports: DataFrame) -> DataFrame:
    """chunk_id, name, module of the imported names that a chunk's text uses.

    chunks: (chunk_id, path, content); imports: (path, module, names). An import without names binds
    the last part of its module. The imports of a file are gathered and compared with a chunk's words in its row, so
    that no word is shuffled.
    """
    tail = F.element_at(F.split("module", r"[./]"), -1)
    bound = imports.select("path", "module", F.explode(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(tail))).alias("name")).where("name is not null")
    of_file = bound.groupBy("path").agg(F.collect_set(F.struct("name", "module")).alias("bound"))
    told = chunks.select("chunk_id", "path", "content").join(of_file, "path")
    used = lambda words: F.filter("bound", lambda b: F.array_contains(words, b["name"]))
    words = F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))
    return told.select("chunk_id", F.explode(T.let(words, used)).alias("b")).select("chunk_id", "b.name", "b.module")


def owners(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """methods (path, line, name) with the first class (path, name, line, end_line), by its line, whose span holds them."""
    spans = classes.select(F.col("path").alias("p"), F.struct(F.col("line").alias("at"), F.col("name").alias("name")).alias("own"), F.col("line").alias("a"), F.col("end_line").alias("b"))
    held = methods.join(spans, (F.col("path") == F.col("p")) & F.col("line").between(F.col("a"), F.col("b")), "left")
    return held.groupBy("path", "line", "name").agg(F.min("own").alias("own")).select("path", "line", "name", F.col("own.name").alias("owner"))
