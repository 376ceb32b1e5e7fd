"""Symbols, chunks and relations against the syntax tree, plain versions and small cases."""

from __future__ import annotations

import ast
import random
import re

import pytest
from harness import both, database
from pyspark.sql import functions as F

from spindle.operators import code, symbol_chunks, symbols
from spindle.plans import catalog
from spindle.session import stored

SCHEMA = "repository string, path string, language string, text string"


def python_source(rng: random.Random) -> str:
    """A Python file of random statements, with strings, brackets and comments that look like code."""
    tail = lambda pad: rng.choice(["", f"{pad}# def not_me():\n", "\n", "\n\n# at the margin\n\n"])
    noise = lambda pad: rng.choice([f"{pad}x = [\n1,\n2]\n", f'{pad}y = """text\nclass No:\n  def no(self): pass\n"""\n', f"{pad}z = '(' + \"# no\"  # (\n", f"{pad}w = 1 + \\\n2\n", f"{pad}if x:\n{pad}    def inner(): pass\n{pad}    y = 1\n", f"{pad}pass\n"])
    body = lambda pad: "".join(noise(pad) for _ in range(rng.randint(1, 3)))
    out = rng.choice(["", "__all__ = ['f0', \"C1\"]\n", "import os, sys\nfrom .a import b\n"])
    for i in range(rng.randint(0, 6)):
        kind = rng.randrange(6)
        deco = rng.choice(["", "@cache\n", "@dataclass(frozen=True)\n@other.one\n"])
        if kind < 2:
            out += f"{deco}{rng.choice(['', 'async '])}def {rng.choice(['', '_'])}f{i}(a,\n  b=(1)):\n{body('    ')}"
        elif kind < 4:
            out += f"{deco}class {rng.choice(['', '_'])}C{i}{rng.choice(['', '(Base)', '(enum.Enum, Generic[A, B], metaclass=M)', '()'])}:\n{rng.choice(['', body('  ')])}"
            for k in range(rng.randint(0, 3)):
                out += rng.choice(["", "\n", "  @property\n"]) + f"  {rng.choice(['', 'async '])}def m{k}(self):\n{body('      ')}"
            out += "  q = 1\n"
        elif kind == 4:
            out += "LIMIT = 1\nOTHER: int = 2\n\nTHIRD = 3\n\n\n\nFAR = 4\n"
        else:
            out += noise("")
        out += tail("")
    return out


def plain_python(text: str) -> set:
    """What the syntax tree says of the symbols of a file."""
    tree, out = ast.parse(text), set()
    listed = code._listed(tree)
    shown = lambda name: name in listed if listed else not name.startswith("_")
    taken: set[int] = set()
    function = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in tree.body:
        if isinstance(node, function):
            waits = isinstance(node, ast.AsyncFunctionDef)
            out.add(("async_function" if waits else "function", node.name, None, node.lineno, node.end_lineno, waits, shown(node.name), len(node.decorator_list)))
            taken |= set(range(node.lineno, node.end_lineno + 1))
        elif isinstance(node, ast.ClassDef):
            methods = [m for m in node.body if isinstance(m, function)]
            end = max(node.lineno, min(m.lineno for m in methods) - 1) if methods else node.end_lineno
            out.add((code._class_kind(node), node.name, None, node.lineno, end, False, shown(node.name), len(node.decorator_list)))
            out |= {("method", m.name, node.name, m.lineno, m.end_lineno, isinstance(m, ast.AsyncFunctionDef), False, len(m.decorator_list)) for m in methods}
            taken |= set(range(node.lineno, node.end_lineno + 1))
    named = [i for i, x in enumerate(text.split("\n"), 1) if i not in taken and re.match(r"[A-Z][A-Z0-9_]*\s*(:[^=]+)?=", x)]
    groups: list[list[int]] = []
    for i in named:
        if groups and i - groups[-1][-1] <= 2:
            groups[-1].append(i)
        else:
            groups.append([i])
    return out | {("module_constants", f"constants@{g[0]}", None, g[0], g[-1], False, True, 0) for g in groups}


def test_python_symbols_equal_the_syntax_tree(spark):
    rng = random.Random(11)
    texts = [python_source(rng) for _ in range(150)]
    df = spark.createDataFrame([("r", f"{i}.py", "python", t) for i, t in enumerate(texts)], SCHEMA)
    got: dict[str, set] = {}
    for r in symbols.symbols(df).collect():
        got.setdefault(r.path, set()).add((r.kind, r.symbol, r.parent, r.first, r.last, r.is_async, r.exported, len(r.decorators)))
    for i, text in enumerate(texts):
        assert got.get(f"{i}.py", set()) == plain_python(text), text


def test_python_bases_kinds_and_prefixes(spark):
    text = "@dataclass\nclass A(B, metaclass=M):\n    def f(self): pass\nclass E(enum.IntEnum):\n    X = 1\nclass G(Generic[K, V], x.Y):\n    pass\n"
    rows = {r.symbol: r for r in symbols.symbols(spark.createDataFrame([("r", "a.py", "python", text)], SCHEMA)).collect()}
    assert (rows["A"].kind, rows["A"].bases, rows["A"].decorators) == ("dataclass", ["B"], ["dataclass"])
    assert rows["E"].kind == "enum" and rows["G"].bases == ["Generic[K, V]", "x.Y"]
    assert rows["f"].prefix == "class A(B, metaclass=M):" and rows["f"].parent == "A"


FILES = [
    ("r", "a.tsx", "tsx", "export const ThemeProvider = ({x}) => {\n  useTheme()\n  return 1\n}\nfunction Panel() { return useTheme(1) + useTheme(2) }\nfunction useTheme() {\n}\nenum Tone { A }\nexport class Box {\n  a = 1\n}"),
    ("r", "b.ts", "typescript", "function Panel() { }\nasync function go() {\n}\nconst later = async x => x\n"),
    ("r", "K.cs", "csharp", "namespace X {\n  public record struct P(int A);\n  internal class Q {\n    public async Task Run(int a) {\n      if (a > 0) { }\n    }\n  }\n}"),
    ("r", "l.rs", "rust", "pub trait T {\n  fn a(&self);\n}\nstruct S { x: i32 }\npub async fn run() {\n  let a = '{';\n}\n"),
    ("r", "package.json", "json", "{}"), ("r", "pyproject.toml", "toml", "x = 1"), ("r", "x.css", "css", "a { }"), ("r", "empty.py", "python", ""), ("r", "nul.py", "python", None),
    ("r", "only.py", "python", "print(1)\n"), ("r", "none.go", "go", "package x"), (None, None, None, "who knows"), ("r", "a.tsx", "tsx", ""),
]


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame(FILES, SCHEMA)
    for name in ("s", "p", "own", "line", "code", "at", "f", "kind", "part", "all_lines"):
        df = df.withColumn(name, F.lit("clash"))
    return stored(symbol_chunks.symbol_chunks(df))


def test_kinds_of_all_languages(made):
    got = {(r.path, r.symbol): (r.kind, r.start_line, r.end_line, r.is_async, r.exported, r.visibility) for r in made.collect()}
    assert got["a.tsx", "ThemeProvider"] == ("context_provider", 1, 4, False, True, "public")
    assert got["a.tsx", "Panel"] == ("component", 5, 5, False, False, "internal") and got["a.tsx", "useTheme"][0] == "hook"
    assert got["a.tsx", "Tone"][0] == "enum" and got["a.tsx", "Box"] == ("class", 9, 11, False, True, "public")
    assert got["b.ts", "Panel"][0] == "function" and got["b.ts", "go"] == ("async_function", 2, 3, True, False, "internal") and got["b.ts", "later"][0] == "async_function"
    assert got["K.cs", "Q"] == ("class", 3, 7, False, False, "internal") and got["K.cs", "Run"] == ("method", 4, 6, True, False, "public")
    assert got["l.rs", "T"][0] == "trait" and got["l.rs", "run"] == ("async_function", 5, 7, True, False, "public") and got["l.rs", "S"][5] == "private"
    assert got["package.json", "package.json"][0] == "config_file" and got["x.css", "x.css"][0] == "style" and got["only.py", "only.py"][0] == "module" and got["none.go", "none.go"][0] == "module"
    assert got["", ""][0] == "module" and not {"empty.py", "nul.py"} & {p for p, _ in got}


def test_relations_of_components(made):
    ids = {(r.path, r.symbol): r.chunk_id for r in made.collect()}
    got = {(r.chunk_id, r.relation, r.target_symbol, r.target_id) for r in symbol_chunks.relations(made).collect()}
    assert (ids["a.tsx", "Panel"], "uses_hook", "useTheme", ids["a.tsx", "useTheme"]) in got
    assert (ids["K.cs", "Run"], "method_of", "Q", ids["K.cs", "Q"]) in got
    assert not [x for x in got if x[1] == "uses_type"] and not [x for x in got if x[1] == "has_method"]


def test_long_symbols_become_blocks(spark):
    body = "\n\n".join("\n".join(f"  a{i}_{j} = 1;" for j in range(5)) for i in range(4))
    df = spark.createDataFrame([("r", "a.js", "javascript", f"export function f() {{\n{body}\n}}\n")], SCHEMA)
    out = stored(symbol_chunks.symbol_chunks(df, most_lines=10, least_lines=7))
    rows = {r.symbol: r for r in out.collect()}
    assert [(s, r.kind, r.start_line, r.end_line, r.part, r.parts) for s, r in sorted(rows.items())] == [("f", "utility_function", 1, 12, 0, 1), ("f#block1", "block", 14, 25, 1, 1)]
    assert rows["f#block1"].content.startswith("# section 1 of f\n\n  a2_0") and rows["f#block1"].parent == "f" and not rows["f#block1"].exported
    edges = {(r.relation, r.target_symbol, r.target_id) for r in symbol_chunks.relations(out).collect()}
    assert edges == {("part_of", "f", rows["f"].chunk_id), ("has_part", "f#block1", rows["f#block1"].chunk_id)}
    assert symbol_chunks.symbol_chunks(df).count() == 1


def test_nothing_gives_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert symbol_chunks.symbol_chunks(none).count() == 0 and symbol_chunks.file_rows(none).count() == 0
    assert symbol_chunks.relations(symbol_chunks.symbol_chunks(none)).count() == 0


def test_only_a_closing_brace_ends_a_block():
    assert code.block_end(["} x {", "a", "}"], 1) == 3


def test_ends_of_blocks_of_many_files_without_pandas(spark):
    files = spark.range(150).select(F.lit("r").alias("repository"), F.concat(F.lit("f"), F.col("id"), F.lit(".go")).alias("path"), F.lit("go").alias("language"), F.concat(F.lit("func Get() {\n"), F.repeat(F.lit("x\n"), F.col("id").cast("int")), F.lit("}")).alias("text"))
    out = symbols.braced(files)
    assert {r.path: (r.line, r["last"]) for r in out.collect()} == {f"f{i}.go": (1, i + 2) for i in range(150)}
    assert "MapInArrow" in (plan := out._jdf.queryExecution().toString()) and "MapInPandas" not in plan


def test_dependencies_shuffle_no_words(spark):
    chunks = spark.createDataFrame([("c1", "p", "use(os); os.x(); List"), ("c2", "p", "nothing"), ("c3", "q", "os"), ("c4", None, "os"), ("c5", "p", None)], "chunk_id string, path string, content string")
    imports = spark.createDataFrame([("p", "os", []), ("p", "os", []), ("p", "java.util.List", None), ("p", "lib.x", ["use", "gone", None]), ("p", None, ["x"]), (None, "os", [])], "path string, module string, names array<string>")
    out = code.dependencies(chunks, imports)
    assert sorted(map(tuple, out.collect()), key=str) == [("c1", "List", "java.util.List"), ("c1", "os", "os"), ("c1", "use", "lib.x"), ("c1", "x", None)]
    plan = out._jdf.queryExecution().toString()
    assert "hashpartitioning(path" in plan and not [x for x in plan.split("hashpartitioning(")[1:] if "name#" in x.split(")")[0]]


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    """Documents of 4100 lines, one for each template, and short ones."""
    folder = tmp_path_factory.mktemp("tall")
    text = F.when(F.col("id") < 6, F.concat(F.repeat(F.lit("of a text\n"), 4099), F.lit("its end"))).otherwise(F.lit("one\ntwo"))
    rows = spark.range(12).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src").alias("source"), F.length(text).cast("long").alias("n_chars"))
    rows.toPandas().to_parquet(folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["q40_block_ends", "q61_symbol_chunks", "q62_relations", "q66_stored_rows"])
def test_blocks_of_thousands_of_lines_end_as_the_sql_says(spark, tall, name):
    ours, theirs = both(catalog.QUERIES[name](spark, tall), database(tall), catalog.SQL[name])
    assert ours and ours == theirs


def plain_block_end(lines: list[str], start: int) -> int:
    """The end of one block, told from the whole rest of the file."""
    body, depth, parens, opened = "\n".join(lines[start - 1 :]), 0, 0, False
    for m in code._TOKENS.finditer(body):
        line = start + body.count("\n", 0, m.start())
        if m[0] in ("(", ")"):
            parens = max(0, parens + (1 if m[0] == "(" else -1))
        elif not parens and m[0] == ";" and not opened:
            return line
        elif not parens and m[0] in ("{", "}"):
            opened, depth = opened or m[0] == "{", depth + (1 if m[0] == "{" else -1)
            if opened and m[0] == "}" and depth == 0:
                return line
    return len(lines) if opened else start


def test_ends_of_blocks_equal_those_of_each_start_alone():
    rng, bits = random.Random(4), ["(", ")", "{", "}", ";", "/*", "*/", "//", '"', "`", "\\", "a", "*", "/**/", "{}", "/*/", "function f() {"]
    for _ in range(3000):
        weights = [rng.choice([0, 1, 5]) for _ in bits[1:]] + [1]
        lines = ["".join(rng.choices(bits, weights, k=rng.choice([0, 1, 2, 4, 8]))) for _ in range(rng.randint(1, 30))]
        starts = rng.choices(range(1, len(lines) + 1), k=rng.randint(1, 12))
        assert code.ends_of_blocks(lines, starts) == {s: plain_block_end(lines, s) for s in starts}, lines


def test_lines_are_read_once_for_all_blocks(monkeypatch):
    read, signs = [], code._signs
    monkeypatch.setattr(code, "_signs", lambda line, within: read.append(line) or signs(line, within))
    lines = ["function f(a) { ("] * 5000 + ["} // the end"]
    assert set(code.ends_of_blocks(lines, range(1, 5001)).values()) == {5001} and len(read) == 5001


def test_long_decorators_stay_whole(spark):
    sign = "other(" + "1, " * 400_000 + "dataclass)"
    rows = symbols.symbols(spark.createDataFrame([("r", "a.py", "python", f"@{sign}\nclass A:\n    x = 1\n")], SCHEMA)).collect()
    assert [(r.kind, r.decorators) for r in rows] == [("dataclass", [sign])]
