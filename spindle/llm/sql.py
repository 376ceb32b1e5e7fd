"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, separators: str) -> str:
    return f"list_filter(string_split_regex({text}, '{separators}'), lambda x: x <> '')"


_SPACES, _OTHERS = r"[\x20\x09-\x0D]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

_METRICS = {"word_length": "200000.0::DOUBLE / greatest(n_words, 1)", "symbol_rate": "100000.0::DOUBLE / greatest(n_words, 1)", "dup_line_rate": "100000.0::DOUBLE / greatest(n_lines, 1)", "repeat_rate": "1600000.0::DOUBLE / greatest(n_words, 1)", "stutter_rate": "100000.0::DOUBLE / greatest(n_words, 1)"}
_QUARTILES = "docs, min(CASE WHEN upto >= docs * 0.25 THEN bin END) AS lo, min(CASE WHEN upto >= docs * 0.75 THEN bin END) AS low_edge"

_QUALITY = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_words("coalesce(text, '')", _SPACES)} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM d, LATERAL (SELECT unnest(generate_series(1, len(ws) - 7)) AS i)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x, i: i > 1 AND x = ws[greatest(i - 1, 1)])) AS n_stutters FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
x AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE WHEN n_words > 0 THEN 10000 * word_chars // n_words ELSE 0 END AS word_length,
  CASE WHEN n_words > 0 THEN 100000 * n_symbols // n_words ELSE 0 END AS symbol_rate, CASE WHEN n_lines > 0 THEN 100000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_rate,
  CASE WHEN n_words > 0 THEN 100000 * n_repeat_words // n_words ELSE 0 END AS repeat_rate, CASE WHEN n_words > 0 THEN 100000 * n_stutters // n_words ELSE 0 END AS stutter_rate FROM m),
e AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM x WHERE NOT base_failed" for m in _METRICS)}),
b AS (SELECT lang, source, metric, v // pow(2, greatest(length(bin(v)) - 6, 0))::BIGINT * pow(2, greatest(length(bin(v)) - 6, 0))::BIGINT AS bin, count(*) AS n FROM e GROUP BY ALL),
q AS (SELECT lang, source, metric, {_QUARTILES} FROM
  (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS docs FROM b) GROUP BY ALL),
b2 AS (SELECT lang, metric, bin, sum(n) AS n FROM b GROUP BY ALL),
q2 AS (SELECT lang, metric, {_QUARTILES} FROM
  (SELECT *, sum(n) OVER (PARTITION BY lang, metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, metric) AS docs FROM b2) GROUP BY ALL),
b3 AS (SELECT metric, bin, sum(n) AS n FROM b GROUP BY ALL),
q3 AS (SELECT metric, {_QUARTILES} FROM
  (SELECT *, sum(n) OVER (PARTITION BY metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY metric) AS docs FROM b3) GROUP BY ALL),
u AS (SELECT q.lang, source, q.metric, {", ".join(f"CASE WHEN q.docs >= 100 THEN q.{c} WHEN q2.docs >= 100 THEN q2.{c} ELSE q3.{c} END AS {c}" for c in ("lo", "low_edge"))}
  FROM q JOIN q2 ON q.metric = q2.metric AND q.lang IS NOT DISTINCT FROM q2.lang JOIN q3 ON q.metric = q3.metric),
t AS (SELECT lang, source, metric, lo, low_edge + pow(2, greatest(length(bin(low_edge)) - 6, 0))::BIGINT - 1 AS hi FROM u),
g AS (SELECT lang, source, {", ".join(f"max(CASE WHEN metric = '{m}' THEN lo END) AS lo_{m}, max(CASE WHEN metric = '{m}' THEN hi END) AS hi_{m}" for m in _METRICS)} FROM t GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(word_length >= lo_word_length - 4 * greatest((hi_word_length - lo_word_length)::DOUBLE, {_METRICS["word_length"]})
 AND {" AND ".join(f"{m} <= hi_{m} + 4 * greatest((hi_{m} - lo_{m})::DOUBLE, {least})" for m, least in _METRICS.items())}, true) AS kept
FROM x LEFT JOIN g ON x.lang IS NOT DISTINCT FROM g.lang AND x.source IS NOT DISTINCT FROM g.source"""

_NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_FOLDED, _SPACES)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS k FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(len(ws) - 1, 1))) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
sym AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT x, v FROM reach JOIN sym ON u = y),
c AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id, m = doc_id AS kept FROM c LEFT JOIN n ON n.doc_id = x JOIN (SELECT DISTINCT doc_id FROM d) dd ON dd.doc_id = x""".replace("SELECT doc_id, coalesce(n, 0)", "SELECT dd.doc_id, coalesce(n, 0)").replace("m = doc_id AS kept", "m = dd.doc_id AS kept")

_DECONTAMINATION = rf"""
WITH b AS (SELECT item_id, {_words(_FOLDED, _OTHERS)} AS ws FROM benchmark), d AS (SELECT doc_id, {_words(_FOLDED, _OTHERS)} AS ws FROM documents),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT * FROM d, lens), LATERAL (SELECT unnest(generate_series(1, len(ws) - n + 1)) AS i)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (n, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


def _number(text: str) -> str:
    """The first eight hex digits of an md5 as a number."""
    digits = " + ".join(f"(strpos('0123456789abcdef', substr(h, {i + 1}, 1)) - 1) * {16 ** (7 - i)}::BIGINT" for i in range(8))
    return f"(SELECT {digits} FROM (SELECT md5({text}) AS h))"


_MIX = rf"""
WITH s AS (SELECT doc_id, source, len({_words("coalesce(text, '')", _SPACES)})::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s GROUP BY source),
w AS (SELECT *, list_element([5, 2, 1], (place % 3)::INT + 1) AS weight FROM t),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT arg_min(level, (3.0::DOUBLE * source_size / weight, place)) FROM v WHERE level * weight <= 3 * source_size) AS line FROM v),
g AS (SELECT *, least(coalesce(line * weight, 3 * source_size), 3 * source_size)::DOUBLE AS target, round(sum(source_size) OVER () / 16.0::DOUBLE)::BIGINT AS house, least(greatest(ceil(source_size / 16384.0), 1), 4096)::BIGINT AS shards FROM f),
seat AS (SELECT place, count(*) AS seats FROM (SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS r, house FROM g, LATERAL (SELECT unnest(generate_series(0, ceil(target / 16)::BIGINT + 20)) AS k)) WHERE r <= house GROUP BY place),
d AS (SELECT s.*, g.place, source_size, target, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS turn, {_number("'mix-1:shard:' || coalesce(doc_id::VARCHAR, 'null')")} % shards AS shard FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
h AS (SELECT place, shard, sum(size)::BIGINT AS votes, ceil(sum(size) / 16.0)::BIGINT AS blocks FROM d GROUP BY ALL),
q AS (SELECT place, shard, count(*) AS quota FROM (SELECT h.place, shard, seats, row_number() OVER (PARTITION BY h.place ORDER BY votes::DOUBLE / (2 * k + 1) DESC, shard, k) AS r
  FROM h JOIN seat USING (place), LATERAL (SELECT unnest(generate_series(0, blocks * 4 + 8)) AS k)) WHERE r <= seats GROUP BY ALL),
p AS (SELECT h.place, h.shard, blocks, least(coalesce(quota, 0), 3 * blocks) // blocks AS passes, least(coalesce(quota, 0), 3 * blocks) % blocks AS extra, {_number("'mix-1:block:' || h.place || ':' || h.shard")} AS turned FROM h LEFT JOIN q USING (place, shard) WHERE blocks > 0),
l AS (SELECT *, sum(size) OVER (PARTITION BY place, shard ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM d),
m AS (SELECT doc_id, size, stop - size AS start, stop, blocks, extra, turned, unnest(generate_series((stop - size) // 16, (stop - 1) // 16)) AS b FROM l JOIN p USING (place, shard) WHERE size > 0),
x AS (SELECT doc_id, sum(least((b + 1) * 16, stop) - greatest(b * 16, start)) AS more FROM m WHERE (b * 2654435761 + turned) % blocks < extra GROUP BY doc_id)
SELECT doc_id, size, source_size, target, (coalesce(passes, 0) * size + coalesce(more, 0))::BIGINT AS taken FROM l LEFT JOIN p USING (place, shard) LEFT JOIN x USING (doc_id)"""

def _digest_number(text: str, group: int) -> str:
    """Eight hex digits of a sha256, from group * 8 on, as a number."""
    return f"('0x' || substr(sha256({text}), {8 * group + 1}, 8))::BIGINT"


def _grams(table: str) -> str:
    words = f"(SELECT row_number() OVER () AS r, * FROM (SELECT *, {_words(_FOLDED, _OTHERS)} AS ws FROM {table}))"
    return f"(SELECT r, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS f FROM {words})"


_IMPORTANCE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words(_FOLDED, _OTHERS)} AS ws FROM documents),
df AS (SELECT r, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS f FROM d),
bf AS (SELECT f FROM {_grams("benchmark")}),
bits AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS i)),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits),
bytes AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
crc AS (SELECT f, xor(list_reduce([4294967295::BIGINT] || list_transform(range(len(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM bytes, tab),
raw AS (SELECT b, count(*) AS s FROM df JOIN crc USING (f) GROUP BY b), goal AS (SELECT b, count(*) AS t FROM bf JOIN crc USING (f) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000)::DOUBLE)))::BIGINT AS g FROM raw FULL JOIN goal USING (b)),
w AS (SELECT r, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN crc USING (f) JOIN gain USING (b) GROUP BY r),
c AS (SELECT d.r, doc_id, len(ws) >= 20 AS able, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln(({_digest_number("'7:' || doc_id", 0)} + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN w USING (r)),
k AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * (SELECT count(*) FROM c WHERE able) // 100 THEN place END AS rank FROM k"""

_MIDDLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us FROM documents),
h AS (SELECT *, len(us)::BIGINT AS n, {", ".join(f"{_digest_number(chr(39) + '42:' + chr(39) + ' || doc_id', g)} AS h{g + 1}" for g in range(4))} FROM d),
c AS (SELECT *, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM h),
p AS (SELECT *, {", ".join(f"coalesce(array_to_string(list_filter(us, lambda u, i: i > {a} AND i <= {b}), ''), '') AS {x}" for x, a, b in (("p", 0, "lo"), ("m", "lo", "hi"), ("s", "hi", "n")))} FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM p),
r AS (SELECT *, string_split_regex(output, '<[PSM]>') AS ps FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN ps[2] || ps[4] || ps[3] ELSE ps[3] || ps[4] || ps[2] END) AS restored_sha256 FROM r"""

SQL: dict[str, str] = {
    "op1_quality": _QUALITY, "op3_near_dedup": _NEAR, "op5_mixing": _MIX, "op8_decontamination": _DECONTAMINATION,
    "op11_importance_resampling": _IMPORTANCE, "op12_fill_in_middle": _MIDDLE,
}
