"""Vector search, expansion, reranking and packing of what was found."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.functions import text as T
from spindle.functions import vocabulary as V
from spindle.operators import context, nearest, retrieval, vectors
from spindle.plans.registry import query, table
from spindle.session import shared_folder, stored

KINDS = tuple(V.TYPE_WEIGHTS)
#: Every vector whose id is divisible by 50 is a query against all vectors.
_COSINE = "greatest(0.0, least(1.0, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])))"
_SCORED = f"""scored AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, {_COSINE} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 {{where}})"""


def _queries(vecs: DataFrame) -> DataFrame:
    return vecs.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(
    f"WITH {_SCORED.format(where='')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)"
    " SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10"
)
def q01_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings")
    return _shown(vectors.top_k(_queries(vecs), vecs, 10))


@query(
    f"WITH {_SCORED.format(where='AND v.label IN (1, 2, 3, 5)')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored),"
    " f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM r WHERE rank <= 24 AND score >= 0.05 AND label <> 3)"
    " SELECT query_id, vec_id, round(score, 6) AS score, place::INT AS rank FROM f WHERE place <= 8"
)
def q02_vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings")
    where = vectors.predicate(vectors.clause_of({"label": [1, 2, 3, 5]}), {"label": "int"})
    return _shown(vectors.search(_queries(vecs), vecs, k=8, threshold=0.05, where=where, residual=F.col("label") != 3))


CLAUSE = {"$or": [{"p_brand": {"$in": ["Brand#11", "Brand#23"]}}, {"$and": [{"p_size": {"$ne": 7}}, {"p_type": {"$eq": "PROMO"}}]}, {"absent": None, "p_size": 3}], "missing": {"$ne": "x"}, "p_partkey": {"$odd": 1}}


@query("SELECT p_brand, count(*) AS parts, sum(p_size)::BIGINT AS sizes FROM part WHERE (coalesce(p_brand IN ('Brand#11', 'Brand#23'), false) OR (p_size IS DISTINCT FROM 7 AND p_type IS NOT DISTINCT FROM 'PROMO') OR p_size IS NOT DISTINCT FROM 3) GROUP BY p_brand")
def q03_where_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kept = part.where(vectors.predicate(CLAUSE, dict(part.dtypes)))
    return kept.groupBy("p_brand").agg(F.count("*").alias("parts"), F.sum("p_size").alias("sizes"))


def _edges(vecs: DataFrame) -> DataFrame:
    n = F.broadcast(vecs.agg(F.count("*").alias("n")))  # one row
    targets = F.array(F.struct(F.lit(0).alias("pos"), ((F.col("vec_id") * 7 + 1) % F.col("n")).alias("dst")), F.struct(F.lit(1).alias("pos"), ((F.col("vec_id") * 13 + 5) % F.col("n")).alias("dst")))
    return vecs.crossJoin(n).select(F.col("vec_id").alias("src"), F.explode(targets).alias("t")).select("src", "t.dst", "t.pos", (F.col("t.dst") % 5 == 0).alias("external"))


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings")
    hits = vectors.top_k(_queries(vecs), vecs, 5).select("query_id", F.col("vec_id").alias("node"), F.round("score", 6).alias("score"), "rank")
    return retrieval.expand(hits, _edges(vecs), depth=2, frontier=6, fetched=6, most=14)


_LEVEL = """
f{d} AS (SELECT query_id, dst AS node, max(score * 0.82::DOUBLE) AS s, min(ordinal * 10 + pos) AS seen FROM l{p} JOIN edges ON src = node WHERE NOT external
         AND NOT EXISTS (SELECT 1 FROM s{p} s WHERE s.query_id = l{p}.query_id AND s.node = dst) GROUP BY ALL),
g{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seen, node) AS place FROM f{d}) WHERE place <= 6),
s{d} AS (SELECT query_id, node FROM s{p} UNION ALL SELECT query_id, node FROM g{d}),
h{d} AS (SELECT query_id, count(*) AS held, max(ordinal) AS last FROM k{p} GROUP BY query_id),
l{d} AS (SELECT query_id, node, round(s + 1e-10::DOUBLE, 6) AS score, {d} AS depth, last + row AS ordinal FROM
         (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY node) AS row FROM g{d}) JOIN h{d} USING (query_id) WHERE row <= 6 AND held + row <= 14),
k{d} AS (SELECT * FROM k{p} UNION ALL SELECT * FROM l{d})"""
_EXPANDED = (
    f"WITH {_SCORED.format(where='')},"
    """ n AS (SELECT count(*) AS n FROM embeddings),
edges AS (SELECT vec_id AS src, (vec_id * 7 + 1) % n AS dst, 0 AS pos, ((vec_id * 7 + 1) % n) % 5 = 0 AS external FROM embeddings, n
          UNION ALL SELECT vec_id, (vec_id * 13 + 5) % n, 1, ((vec_id * 13 + 5) % n) % 5 = 0 FROM embeddings, n),
l0 AS (SELECT query_id, vec_id AS node, round(score, 6) AS score, 0 AS depth, rank AS ordinal FROM
       (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5),
s0 AS (SELECT query_id, node FROM l0), k0 AS (SELECT * FROM l0),"""
    + _LEVEL.format(d=1, p=0)
    + ","
    + _LEVEL.format(d=2, p=1)
)


@query(_EXPANDED + " SELECT query_id, node, score, depth::INT AS depth, ordinal::BIGINT AS ordinal FROM k2")
def q28_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir)


_KIND = "list_element([" + ", ".join(f"'{k}'" for k in KINDS) + "], (node % 23)::INT + 1)"
_WEIGHT = "list_element([" + ", ".join(f"{w}::DOUBLE" for w in V.TYPE_WEIGHTS.values()) + "], (node % 23)::INT + 1)"
_RANKED = (
    _EXPANDED
    + f""", w AS (SELECT *, {_KIND} AS kind, round(CASE WHEN depth > 0 THEN greatest(score, 0.35) ELSE score END * {_WEIGHT} * pow(0.82::DOUBLE, depth) + 1e-10::DOUBLE, 6) AS rank_score FROM k2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN depth = 0 THEN 0 ELSE 1 END, rank_score DESC, score DESC, ordinal) AS place FROM w)"""
)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("node") % 23 + 1).cast("int"))
    return retrieval.reranked(_expanded(spark, sf_dir).withColumn("kind", kind))


@query(_RANKED + " SELECT query_id, node, kind, rank_score, place::INT AS place FROM ranked WHERE place <= 50")
def q29_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("query_id", "node", "kind", "rank_score", "place")


@query(
    "WITH r AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_linenumber, l_suppkey, l_partkey) AS r,"
    " min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag) AS first_ordinal, l_returnflag FROM lineitem) SELECT l_orderkey, l_returnflag, round(max(l_extendedprice), 2) AS best, min(first_ordinal)::INT AS first_ordinal FROM r WHERE r = 1 GROUP BY ALL"
)
def q30_best_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_linenumber")
    best = context.best_of_key(items, ["l_orderkey", "l_returnflag"], "l_extendedprice", "l_linenumber")
    return best.select("l_orderkey", "l_returnflag", F.round("l_extendedprice", 2).alias("best"), "first_ordinal")


def _context_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked hits with the text of the document of their id, in the order of the budget."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), "text", "source")
    hits = context.with_rows(stored(_ranked(spark, sf_dir)), docs, "node")
    source = F.when(F.col("depth") > 0, "dependency_expansion").otherwise("semantic")
    own = hits.withColumn("section", context.section(F.col("kind"), source, F.col("depth"))).withColumn("final", F.when(F.col("rank_score") == 0, F.col("score")).otherwise(F.col("rank_score")))
    order = Window.partitionBy("query_id").orderBy(context.section_rank(F.col("section")), F.desc("final"), "ordinal")
    path = F.concat("source", F.lit("/"), F.col("node").cast("string"), F.lit(".txt"))
    return own.select("query_id", F.row_number().over(order).alias("place"), path.alias("path"), F.concat(F.lit("doc"), F.col("node").cast("string")).alias("symbol"), "kind", "section", "final", F.col("text").alias("content"))


_SECTIONED = (
    _RANKED
    + """, c AS (SELECT r.*, d.text AS content, d.source || '/' || node || '.txt' AS path, 'doc' || node AS symbol,
 CASE WHEN kind = 'config_file' THEN 'configuration' WHEN depth > 0 THEN 'supporting' WHEN kind IN ('utility_function', 'module_constants', 'module') THEN 'utilities' ELSE 'primary' END AS section,
 CASE WHEN rank_score = 0 THEN score ELSE rank_score END AS final FROM ranked r JOIN documents d ON d.doc_id = r.node WHERE r.place <= 50),
o AS (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY query_id ORDER BY CASE section WHEN 'primary' THEN 0 WHEN 'supporting' THEN 1 WHEN 'configuration' THEN 2 WHEN 'utilities' THEN 3 ELSE 4 END, final DESC, ordinal) AS place FROM c)"""
)


@query(_SECTIONED + " SELECT query_id, place::INT AS place, section, symbol FROM o")
def q31_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context_chunks(spark, sf_dir).select("query_id", "place", "section", "symbol")


_TOKENS = "CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, length({x}) // 4) END"
_HEAD = "'// ' || path || ' :: ' || symbol || chr(10) || "
_LINES = "string_split(content, chr(10))"
_SHORT = f"array_to_string({_LINES}[1:24], chr(10)) || chr(10) || '    // ... ' || (len({_LINES}) - 32) || ' lines omitted for brevity ...' || chr(10) || array_to_string({_LINES}[len({_LINES}) - 7:], chr(10))"
_PACKED = (
    "WITH RECURSIVE "
    + _SECTIONED.removeprefix("WITH ")
    + f""", z AS (SELECT *, {_TOKENS.format(x="(" + _HEAD + "content)")} AS full_tokens, CASE WHEN len({_LINES}) > 32 THEN {_TOKENS.format(x="(" + _HEAD + _SHORT + ")")} END AS short_tokens FROM o),
p AS (SELECT query_id, 0::BIGINT AS place, 0::BIGINT AS used, 0::BIGINT AS tokens, '' AS state FROM (SELECT DISTINCT query_id FROM z)
  UNION ALL SELECT z.query_id, z.place, p.used + CASE WHEN p.used + full_tokens <= 1348 THEN full_tokens WHEN full_tokens > 700 AND p.used + short_tokens <= 1348 THEN short_tokens ELSE 0 END,
  CASE WHEN p.used + full_tokens <= 1348 THEN full_tokens WHEN full_tokens > 700 AND p.used + short_tokens <= 1348 THEN short_tokens ELSE 0 END,
  CASE WHEN p.used + full_tokens <= 1348 THEN 'taken' WHEN full_tokens > 700 AND p.used + short_tokens <= 1348 THEN 'compressed' ELSE 'trimmed' END
  FROM p JOIN z ON z.query_id = p.query_id AND z.place = p.place + 1)"""
)
_LIMIT = 1348


@query(_PACKED + " SELECT query_id, place::INT AS place, tokens, state FROM p WHERE place > 0")
def q32_budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    assert context.budget(2731) == _LIMIT
    return context.packed(_context_chunks(spark, sf_dir), _LIMIT).select("query_id", "place", "tokens", "state")


@query(f"SELECT doc_id, len({_LINES.replace('content', 'text')})::INT AS n_lines, sha256({_SHORT.replace('content', 'text')}) AS short_hash FROM documents WHERE len({_LINES.replace('content', 'text')}) > 32")
def q33_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    short = docs.select("doc_id", F.size(T.lines(F.col("text"))).alias("n_lines"), context.compressed(F.col("text")).alias("short"))
    return short.where("short is not null").select("doc_id", "n_lines", T.content_hash(F.col("short")).alias("short_hash"))


_PROMPT = (
    _PACKED
    + f""", kept AS (SELECT z.query_id, z.place, z.section, '## ' || symbol || ' (' || kind || ') — ' || path || CASE WHEN state = 'compressed' THEN ' (compressed)' ELSE '' END || chr(10) || '```' || chr(10)
  || CASE WHEN state = 'compressed' THEN {_SHORT} ELSE content END || chr(10) || '```' AS chunk FROM z JOIN p USING (query_id, place) WHERE state <> 'trimmed'),
b1 AS (SELECT query_id, section, string_agg(chunk, chr(10) || chr(10) ORDER BY place) AS body FROM kept GROUP BY ALL),
b2 AS (SELECT query_id, string_agg('# ' || CASE section WHEN 'primary' THEN 'Main matches' WHEN 'supporting' THEN 'What they depend on' WHEN 'configuration' THEN 'Settings' WHEN 'utilities' THEN 'Helpers' ELSE 'Further references' END || chr(10) || body, chr(10) || chr(10)
  ORDER BY CASE section WHEN 'primary' THEN 0 WHEN 'supporting' THEN 1 WHEN 'configuration' THEN 2 WHEN 'utilities' THEN 3 ELSE 4 END) || chr(10) || chr(10) AS body FROM b1 GROUP BY ALL),
t AS (SELECT v.vec_id AS query_id, coalesce(body, '') || '# Question' || chr(10) || 'What is near ' || v.vec_id || '?' AS prompt FROM embeddings v LEFT JOIN b2 ON b2.query_id = v.vec_id WHERE v.vec_id % 50 = 0)"""
)


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _queries(table(spark, sf_dir, "embeddings")).select("query_id", F.concat(F.lit("What is near "), F.col("query_id").cast("string"), F.lit("?")).alias("question"))
    return context.prompts(context.packed(_context_chunks(spark, sf_dir), _LIMIT), asked)


@query(_PROMPT + " SELECT query_id, sha256(prompt) AS prompt_hash, greatest(1, length(prompt) // 4) AS tokens FROM t")
def q34_prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("query_id", T.content_hash(F.col("prompt")).alias("prompt_hash"), "tokens")


@query(_PACKED + " SELECT query_id, z.place::INT AS place, symbol, section, tokens, state FROM z JOIN p USING (query_id, place)")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieve, expand, rerank and pack for every query vector."""
    return context.packed(_context_chunks(spark, sf_dir), _LIMIT).select("query_id", "place", "symbol", "section", "tokens", "state")


@query()
def q69_approximate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query against the 24 of 32 lists whose centroids are nearest; vectors without clusters need that many for a recall of 0.9."""
    vecs, path = table(spark, sf_dir, "embeddings"), f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    nearest.build_index(vecs, path, lists=32)
    return _shown(nearest.probe(spark, path, _queries(vecs), 10, probes=24))


_PARENT = "CASE WHEN vec_id % 4 = 0 THEN 's' || (vec_id * 3 + 2) % 97 ELSE '' END"
_NAMED_LEVEL = """
f{d} AS (SELECT query_id, name, max(score * 0.82::DOUBLE) AS s, min((ordinal, pos)) AS seen FROM l{p} JOIN targets t ON t.node = l{p}.node
         WHERE NOT EXISTS (SELECT 1 FROM s{p} s WHERE s.query_id = l{p}.query_id AND s.name = t.name) GROUP BY ALL),
g{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seen, name) AS place FROM f{d}) WHERE place <= 3),
s{d} AS (SELECT * FROM s{p} UNION ALL SELECT query_id, name FROM g{d}),
m{d} AS (SELECT * FROM (SELECT query_id, n.node, name, s, row_number() OVER (PARTITION BY query_id ORDER BY n.node) AS row FROM g{d} JOIN nodes n ON n.symbol = name) WHERE row <= 12),
h{d} AS (SELECT query_id, count(*) AS held, max(ordinal) AS last FROM k{p} GROUP BY query_id),
l{d} AS (SELECT query_id, node, name AS symbol, round(s + 1e-10::DOUBLE, 6) AS score, {d} AS depth, last + row AS ordinal FROM
         (SELECT * EXCLUDE (row), row_number() OVER (PARTITION BY query_id ORDER BY node) AS row FROM m{d} WHERE NOT EXISTS (SELECT 1 FROM k{p} k WHERE k.query_id = m{d}.query_id AND k.node = m{d}.node)) JOIN h{d} USING (query_id) WHERE held + row <= 30 OR {d} = 1 AND row = 1),
k{d} AS (SELECT * FROM k{p} UNION ALL SELECT * FROM l{d})"""


@query(
    f"WITH {_SCORED.format(where='')},"
    f""" n AS (SELECT count(*) AS n FROM embeddings), nodes AS (SELECT vec_id AS node, 's' || vec_id % 97 AS symbol, {_PARENT} AS parent FROM embeddings),
targets AS (SELECT vec_id AS node, 0 AS pos, 's' || ((vec_id * 7 + 1) % n) % 97 AS name FROM embeddings, n WHERE ((vec_id * 7 + 1) % n) % 5 <> 0
          UNION ALL SELECT vec_id, 1, 's' || ((vec_id * 13 + 5) % n) % 97 FROM embeddings, n WHERE ((vec_id * 13 + 5) % n) % 5 <> 0 UNION ALL SELECT node, 9, parent FROM nodes WHERE parent <> ''),
l0 AS (SELECT query_id, vec_id AS node, 's' || vec_id % 97 AS symbol, round(score, 6) AS score, 0 AS depth, rank AS ordinal FROM
       (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5),
s0 AS (SELECT query_id, symbol AS name FROM l0), k0 AS (SELECT * FROM l0),"""
    + ",".join(_NAMED_LEVEL.format(d=d, p=d - 1) for d in range(1, 5))
    + " SELECT query_id, node AS chunk_id, symbol, score, depth::INT AS depth, ordinal::BIGINT AS ordinal FROM k4"
)
def q70_expand_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings")
    hits = vectors.top_k(_queries(vecs), vecs, 5).select("query_id", F.col("vec_id").alias("chunk_id"), F.round("score", 6).alias("score"), "rank")
    symbol = lambda c: F.concat(F.lit("s"), (c % 97).cast("string"))
    parent = F.when(F.col("vec_id") % 4 == 0, symbol(F.col("vec_id") * 3 + 2)).otherwise("")
    nodes = vecs.select(F.col("vec_id").alias("chunk_id"), symbol(F.col("vec_id")).alias("symbol"), parent.alias("parent"))
    edges = _edges(vecs).select(F.col("src").alias("chunk_id"), "pos", symbol(F.col("dst")).alias("name"), "external")
    return retrieval.expand_symbols(hits, nodes, edges, depth=4, frontier=3, fetched=12, most=30)


@query(
    _EXPANDED
    + " SELECT query_id, count(*) FILTER (WHERE depth = 0) AS direct, count(*) FILTER (WHERE depth > 0) AS expanded, least(count(*), 50) AS final, (max(depth) + 1)::BIGINT AS lookups, round(max(score) + 1e-10::DOUBLE, 6) AS top_score FROM k2 GROUP BY query_id"
)
def q71_retrieval_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.statistics(_expanded(spark, sf_dir))


_INCLUDED = _PACKED + ", own AS (SELECT z.*, p.tokens AS taken, p.state FROM z JOIN p USING (query_id, place))"


@query(
    _INCLUDED
    + """ SELECT query_id, sum(taken)::BIGINT AS used_tokens, count(*) FILTER (WHERE state <> 'trimmed') AS included, count(*) FILTER (WHERE state = 'compressed') AS compressed, count(*) FILTER (WHERE state = 'trimmed') AS trimmed,
coalesce(string_agg(symbol, ',' ORDER BY place) FILTER (WHERE state = 'trimmed'), '') AS trimmed_symbols FROM own GROUP BY query_id"""
)
def q72_context_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.statistics(context.packed(_context_chunks(spark, sf_dir), _LIMIT))


@query(
    _INCLUDED
    + """, kept AS (SELECT own.*, d.lang, d.source FROM own JOIN documents d ON d.doc_id = own.node WHERE state <> 'trimmed') SELECT query_id, 'Repository ''corpus''' || CASE WHEN count(source) > 0 THEN '; framework: ' || string_agg(DISTINCT source, ', ' ORDER BY source) ELSE '' END
 || CASE WHEN count(lang) > 0 THEN '; languages: ' || string_agg(DISTINCT lang, ', ' ORDER BY lang) ELSE '' END || '; ' || count(DISTINCT path) || ' relevant file(s) in context.' AS summary FROM kept GROUP BY query_id"""
)
def q73_context_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("symbol"), F.col("lang").alias("language"), F.col("source").alias("framework"))
    return context.summary(context.packed(_context_chunks(spark, sf_dir), _LIMIT).join(docs, "symbol"), F.lit("corpus"))


@query(
    _INCLUDED
    + """, kept AS (SELECT * FROM own WHERE state <> 'trimmed'), once AS (SELECT query_id, path, symbol, min(place) AS place FROM kept GROUP BY ALL),
fs AS (SELECT query_id, string_agg(path, ',' ORDER BY place) AS files FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS r FROM once) WHERE r <= 8 GROUP BY query_id),
ss AS (SELECT query_id, string_agg(symbol, ',' ORDER BY place) AS symbols FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS r FROM once) WHERE r <= 10 GROUP BY query_id)
SELECT query_id, files, greatest(count(*) - 8, 0) AS more_files, symbols, greatest(count(*) - 10, 0) AS more_symbols, round(max(final), 6) AS top_score FROM kept JOIN fs USING (query_id) JOIN ss USING (query_id) GROUP BY ALL"""
)
def q74_shown_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.shown_sources(context.packed(_context_chunks(spark, sf_dir), _LIMIT))
