"""Source files that are made from documents, and queries over their symbols, chunks and relations.

Each document becomes a file of one of six languages, with its lines as comments inside, so that files are as
long and as many as documents. The SQL knows from the templates where each symbol begins and ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.operators import code, collections, symbol_chunks
from spindle.plans.registry import query, table
from spindle.plans.texts import snapshots
from spindle.session import shared_folder, stored

_PYTHON = '''import os
from lib.tools import helper_@M

LIMIT_A = 1
LIMIT_B = (
    2)


@cache
def load_@ID(a, b=")"):
    """Reads
what it is given."""
    # @BODY
    return helper_@M(a)

# a remark

class Box_@ID(Base_@M, metaclass=Meta):
    size = 1

    def first(self):
        return load_@ID(1)

    @property
    async def _second(self):
        return [
            2,
        ]

LAST = 3'''
_TSX = """import React from 'react'
export interface Props_@ID {
  a: string
}
export function useData_@ID(x) {
  return x
}
export default function View_@ID(p: Props_@ID) {
  const s = "}"
  // @BODY
  return useData_@ID(p) || useOther(1)
}
export const add_@M = async (a) => {
  return a
}
type Alias_@ID = string"""
_JAVA = """import java.util.List;
public interface I@ID {
  int size();
}
public class K@ID {
  // @BODY
  public static int f@M(int a) {
    if (a > 0) { return 1; }
    return 2;
  }
  private void g() { }
}"""
_GO = """package main
import "fmt"
type Store@ID struct {
  n int
}
func Get@M(a int) int {
  // @BODY
  return a
}"""
#: Language, path, template and what stands before each line of the document.
TEMPLATES = (
    ("python", "src/m@ID.py", _PYTHON, "    # "), ("tsx", "web/v@ID.tsx", _TSX, "  // "), ("java", "java/K@ID.java", _JAVA, "  // "),
    ("go", "go/g@ID.go", _GO, "  // "), ("markdown", "docs/d@ID.md", "@BODY\n\n@BODY\n\n@BODY", ""), ("unknown", "raw/r@ID.txt", "@BODY", ""),
)
MOST, LEAST = 12, 4


def _made(template: str, lead: str) -> str:
    """An expression for a file's text, for Spark and DuckDB alike."""
    quoted = "concat(" + ", chr(10), ".join("'" + x.replace("'", "''") + "'" for x in [*template.split("\n"), ""]) + ")"
    body = f"replace(coalesce(text, ''), chr(10), concat(chr(10), '{lead}'))"
    return f"replace(replace(replace(left({quoted}, {len(template)}), '@ID', CAST(doc_id AS STRING)), '@M', CAST(doc_id % 7 AS STRING)), '@BODY', {body})"


_CASES = lambda at: "CASE " + " ".join(f"WHEN doc_id % 6 = {i} THEN {at(i)}" for i in range(6)) + " END"
_PATH = _CASES(lambda i: f"replace('{TEMPLATES[i][1]}', '@ID', CAST(doc_id AS STRING))")
_LANGUAGE, _TEXT = _CASES(lambda i: f"'{TEMPLATES[i][0]}'"), _CASES(lambda i: _made(TEMPLATES[i][2], TEMPLATES[i][3]))
COLUMNS = ("coalesce(source, '') AS repository", f"{_PATH} AS path", f"{_LANGUAGE} AS language", f"{_TEXT} AS text")
FILES = f"SELECT {', '.join(COLUMNS)}, doc_id FROM documents"

#: Per template: kind, symbol, parent, first and last line (n: lines of the document), async, exported, visibility, decorators, bases, and the line of the prefix.
_SPANS = {
    0: (
        ("module_constants", "constants@4", "", "4", "5", 0, 1, "public", "", "", "0"),
        ("function", "load_@ID", "", "10", "13 + n", 0, 1, "public", "cache", "", "0"),
        ("class", "Box_@ID", "", "17 + n", "19 + n", 0, 1, "public", "", "Base_@M", "0"),
        ("method", "first", "Box_@ID", "20 + n", "21 + n", 0, 0, "public", "", "", "17 + n"),
        ("method", "_second", "Box_@ID", "24 + n", "27 + n", 1, 0, "protected", "property", "", "17 + n"),
        ("module_constants", "constants@@N", "", "29 + n", "29 + n", 0, 1, "public", "", "", "0"),
    ),
    1: (
        ("interface", "Props_@ID", "", "2", "4", 0, 1, "public", "", "", "0"),
        ("hook", "useData_@ID", "", "5", "7", 0, 1, "public", "", "", "0"),
        ("component", "View_@ID", "", "8", "11 + n", 0, 1, "public", "", "", "0"),
        ("utility_function", "add_@M", "", "12 + n", "14 + n", 1, 1, "public", "", "", "0"),
        ("type_alias", "Alias_@ID", "", "15 + n", "15 + n", 0, 0, "internal", "", "", "0"),
    ),
    2: (
        ("interface", "I@ID", "", "2", "4", 0, 0, "public", "", "", "0"),
        ("class", "K@ID", "", "5", "11 + n", 0, 0, "public", "", "", "0"),
        ("method", "f@M", "K@ID", "6 + n", "9 + n", 0, 0, "public", "", "", "5"),
        ("method", "g", "K@ID", "10 + n", "10 + n", 0, 0, "private", "", "", "5"),
    ),
    3: (
        ("struct", "Store@ID", "", "3", "5", 0, 0, "public", "", "", "0"),
        ("function", "Get@M", "", "6", "8 + n", 0, 0, "public", "", "", "0"),
    ),
}


def _rows(i: int) -> str:
    fill = lambda x: f"replace(replace(replace('{x}', '@ID', doc_id::VARCHAR), '@M', (doc_id % 7)::VARCHAR), '@N', (29 + n)::VARCHAR)"
    one = lambda k, s, p, a, b, y, e, v, d, c, x: f"SELECT *, '{k}' AS kind, {fill(s)} AS symbol, {fill(p)} AS parent, {a} AS first, {b} AS last, {bool(y)} AS is_async, {bool(e)} AS exported, '{v}' AS visibility, '{d}' AS decorators, {fill(c)} AS bases, {x} AS head, 0 AS part, 0 AS parts FROM f WHERE doc_id % 6 = {i}"
    return " UNION ALL ".join(one(*r) for r in _SPANS[i])


_WHOLE = f"""SELECT *, CASE WHEN doc_id % 6 = 4 THEN 'document' ELSE 'module' END AS kind, regexp_extract(path, '[^/]+$') AS symbol, '' AS parent, 1 AS first, CASE WHEN doc_id % 6 = 4 AND n >= {LEAST} THEN n WHEN doc_id % 6 = 4 THEN 3 * n + 2 ELSE n END AS last,
 false AS is_async, false AS exported, 'internal' AS visibility, '' AS decorators, '' AS bases, 0 AS head, 0 AS part, CASE WHEN doc_id % 6 = 4 AND n >= {LEAST} THEN 2 ELSE 0 END AS parts FROM f WHERE doc_id % 6 >= 4 AND trim(text) <> ''"""
_BLOCKS = f"""SELECT f.*, 'block' AS kind, regexp_extract(path, '[^/]+$') || '#block' || i AS symbol, regexp_extract(path, '[^/]+$') AS parent, i * (n + 1) + 1 AS first, i * (n + 1) + n AS last,
 false AS is_async, false AS exported, 'internal' AS visibility, '' AS decorators, '' AS bases, -i AS head, i AS part, 2 AS parts FROM f, (SELECT unnest([1, 2]) AS i) WHERE doc_id % 6 = 4 AND n >= {LEAST}"""
_CHUNKS = (
    f"WITH f AS (SELECT s.*, len(string_split(coalesce(d.text, ''), chr(10))) AS n, string_split(s.text, chr(10)) AS ls FROM ({FILES}) s JOIN documents d USING (doc_id)), s AS ("
    + " UNION ALL ".join([*(_rows(i) for i in range(4)), _WHOLE, _BLOCKS])
    + """), b AS (SELECT *, array_to_string(ls[first:last], chr(10)) AS body FROM s),
c AS (SELECT *, CASE WHEN head > 0 THEN rtrim(ls[head]) || chr(10) || chr(10) || body WHEN head < 0 THEN '# section ' || part || ' of ' || parent || chr(10) || chr(10) || body ELSE body END AS content FROM b),
k AS (SELECT *, sha1(concat_ws(chr(31), repository, path, symbol, kind, first::VARCHAR)) AS chunk_id, sha256(content) AS hash, coalesce(trim(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '')[1]), symbol) AS signature FROM c)"""
)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repository, path, language and text of the files that are made from documents."""
    return table(spark, sf_dir, "documents").selectExpr(*COLUMNS)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_chunks.symbol_chunks(source_files(spark, sf_dir), most_lines=MOST, least_lines=LEAST)


@query(
    _CHUNKS
    + " SELECT chunk_id, repository, path, kind, symbol, parent, first::INT AS start_line, last::INT AS end_line, signature, is_async, exported, decorators, bases, visibility, part::INT AS part, parts::INT AS parts, hash, length(body)::BIGINT AS n_chars,"
    " CASE WHEN body = '' THEN 0 ELSE greatest(1, length(body) // 4) END::BIGINT AS n_tokens FROM k"
)
def q61_symbol_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [F.concat_ws(",", c).alias(c) for c in ("decorators", "bases")]
    return chunks(spark, sf_dir).select(
        "chunk_id", "repository", "path", "kind", "symbol", F.coalesce("parent", F.lit("")).alias("parent"), "start_line", "end_line", "signature", "is_async", "exported", *shown, "visibility", "part", "parts", "hash", "n_chars", "n_tokens"
    )


@query(
    _CHUNKS
    + """, m AS (SELECT k.chunk_id AS a, k.symbol AS sa, o.chunk_id AS b, o.symbol AS sb, k.language FROM k JOIN k o ON k.kind = 'method' AND o.doc_id = k.doc_id AND o.symbol = k.parent),
p AS (SELECT k.chunk_id AS a, k.symbol AS sa, o.chunk_id AS b, o.symbol AS sb FROM k JOIN k o ON k.kind = 'block' AND o.doc_id = k.doc_id AND o.symbol = k.parent)
SELECT a AS chunk_id, 'method_of' AS relation, sb AS target_symbol, b AS target_id FROM m UNION ALL SELECT b, 'has_method', sa, a FROM m WHERE language = 'python'
UNION ALL SELECT a, 'part_of', sb, b FROM p UNION ALL SELECT b, 'has_part', sa, a FROM p UNION ALL SELECT chunk_id, 'extends', bases, NULL FROM k WHERE bases <> ''
UNION ALL SELECT k.chunk_id, 'uses_hook', 'useData_' || k.doc_id, o.chunk_id FROM k JOIN k o ON k.kind = 'component' AND o.kind = 'hook' AND o.doc_id = k.doc_id
UNION ALL SELECT chunk_id, 'uses_hook', 'useOther', NULL FROM k WHERE kind = 'component'
UNION ALL SELECT k.chunk_id, 'uses_type', o.symbol, o.chunk_id FROM k JOIN k o ON k.kind = 'component' AND o.kind = 'interface' AND o.doc_id = k.doc_id"""
)
def q62_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_chunks.relations(stored(chunks(spark, sf_dir)))


@query(
    f"""WITH f AS (SELECT *, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 0 ELSE 1 END)::BIGINT AS n_lines FROM ({FILES})) SELECT repository, path, language, n_lines,
 list_element([2, 1, 1, 1, 0, 0], (doc_id % 6)::INT + 1)::BIGINT AS imports, list_element([3, 3, 2, 1, 0, 0], (doc_id % 6)::INT + 1)::BIGINT AS functions, list_element([1, 2, 2, 1, 0, 0], (doc_id % 6)::INT + 1)::BIGINT AS types,
 list_element([1, 1, 0, 0, 0, 0], (doc_id % 6)::INT + 1)::BIGINT AS asynchronous, doc_id % 6 = 5 AS unknown FROM f"""
)
def q63_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_chunks.file_rows(source_files(spark, sf_dir))


@query(
    _CHUNKS
    + """, c2 AS (SELECT repository, count(DISTINCT path) AS files_with_chunks, count(*) AS chunks, arg_min(chunk_id, (-length(body), chunk_id)) AS largest, arg_min(chunk_id, (length(body), chunk_id)) AS smallest FROM k GROUP BY repository)
SELECT f.repository, files, coalesce(files_with_chunks, 0) AS files_with_chunks, coalesce(chunks, 0) AS chunks, largest, smallest FROM (SELECT repository, count(DISTINCT path) AS files FROM f GROUP BY repository) f LEFT JOIN c2 USING (repository)"""
)
def q64_chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_chunks.coverage(source_files(spark, sf_dir), stored(chunks(spark, sf_dir)))


@query(
    f"SELECT repository, path, CASE doc_id % 6 WHEN 2 THEN 'java.util.List' ELSE '' END AS internal, list_element(['lib,os', 'react', '', 'fmt'], (doc_id % 6)::INT + 1) AS external, '' AS relative_modules FROM ({FILES}) WHERE doc_id % 6 < 4"
)
def q65_dependency_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_chunks.dependency_modules(source_files(spark, sf_dir))


@query(
    _CHUNKS
    + """, i AS (SELECT * FROM (VALUES (0, 'os', 'os'), (0, 'tools', 'lib.tools'), (1, 'react', 'react'), (2, 'List', 'java.util.List'), (3, 'fmt', 'fmt')) v(family, name, module)),
d AS (SELECT chunk_id, '[' || string_agg('{"name":"' || name || '","module":"' || module || '","is_external":' || (family <> 2) || '}', ',' ORDER BY name) || ']' AS dependencies, string_agg(DISTINCT module, ',' ORDER BY module) AS dependency_modules
  FROM k JOIN i ON doc_id % 6 = family AND list_contains(regexp_extract_all(content, '[A-Za-z_$][A-Za-z0-9_$]*'), name) GROUP BY chunk_id)
SELECT k.chunk_id, kind AS chunk_type, parent AS parent_symbol, coalesce(dependencies, '[]') AS dependencies, coalesce(dependency_modules, '') AS dependency_modules, sha256(path || ' :: ' || symbol || ' (' || kind || ')' || CASE WHEN content = '' THEN '' ELSE chr(10) || content END) AS text_hash
FROM k LEFT JOIN d USING (chunk_id)"""
)
def q66_stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(chunks(spark, sf_dir))
    bound = symbol_chunks.numbered_imports(source_files(spark, sf_dir)).select("path", "module", F.array().cast("array<string>").alias("names"))
    used = code.dependencies(own, bound).withColumn("is_external", F.col("module") != "java.util.List")
    rows = collections.stored_rows(own, used, "v1")
    return rows.select("chunk_id", "chunk_type", "parent_symbol", "dependencies", "dependency_modules", F.sha2("embedding_text", 256).alias("text_hash"))


def _new_collection(spark: SparkSession, name: str) -> str:
    return collections.collection_path(f"{shared_folder(spark)}/{uuid.uuid4().hex}", name)


@query(
    "WITH old AS (SELECT doc_id AS chunk_id, sha256(text) AS hash FROM documents), new AS (SELECT doc_id AS chunk_id, sha256(CASE WHEN doc_id % 10 = 0 THEN text || ' edited' ELSE text END) AS hash FROM documents WHERE doc_id % 17 <> 0"
    " UNION ALL SELECT doc_id + 10000000, sha256(text) FROM documents WHERE doc_id % 200 = 0)"
    " SELECT n.chunk_id, n.hash, CASE WHEN o.hash IS NULL THEN 'inserted' WHEN o.hash = n.hash THEN 'skipped' ELSE 'updated' END AS action, (SELECT count(*) FROM new) AS held FROM new n LEFT JOIN old o USING (chunk_id)"
)
def q67_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A difference against a stored index, committed twice with one token: the rows that are there then, and what became of them."""
    path, (prior, new) = _new_collection(spark, "documents"), snapshots(spark, sf_dir)
    collections.index_chunks(spark, path, prior, "first")
    actions = stored(collections.differences(spark, path, new))
    for _ in range(2):
        collections.index_chunks(spark, path, new, "second")
    held = F.lit(collections.count(spark, path)).cast("long").alias("held")
    return collections.current(spark, path).join(actions, "chunk_id").select("chunk_id", "hash", "action", held)


@query("SELECT vec_id AS chunk_id, label, 0.0::DOUBLE AS score FROM embeddings WHERE label IN (1, 2) AND label IS DISTINCT FROM 5 ORDER BY vec_id LIMIT 100")
def q68_stored_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_collection(spark, "vectors")
    collections.upsert(spark, path, table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id"), ["chunk_id"], "all")
    return collections.fetch(spark, path, {"label": {"$in": [1, 2], "$ne": 5}}, 100).select("chunk_id", "label", "score")
