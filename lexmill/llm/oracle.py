"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_ASCII_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN [concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) FOR i IN range(1, len(ws) - 1)]
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS t FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * m >= 90 * (x.n + y.n - m)),
b AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT u AS doc_id, u AS seen FROM b UNION SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.seen),
c AS (SELECT doc_id, min(seen) AS c FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(c.c, n.doc_id)) AS component_id
FROM n LEFT JOIN c ON c.doc_id = n.doc_id
"""

OP4 = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS z, count(*) AS n, 3 * sum(size)::BIGINT AS cap,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w FROM d GROUP BY source),
t AS (
  SELECT *, cap / w AS b, sum(z) OVER () AS total, sum(w) OVER () AS all_w,
    sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS capped,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS used_w FROM s),
f AS (SELECT *, b * (all_w - used_w + w) <= total - capped + cap AS isfull FROM t),
g AS (
  SELECT *, coalesce((SELECT (total - capped) / (all_w - used_w) FROM f WHERE isfull AND all_w > used_w ORDER BY used_w DESC LIMIT 1), total / all_w) AS level FROM f),
h AS (SELECT source, z, n, CASE WHEN isfull THEN cap::DOUBLE ELSE w * level END AS target FROM g),
x AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, d.source, size, z, n, target,
    least(CASE WHEN z > 0 THEN target / z ELSE 0.0 END, 3.0) AS want,
    (('0x' || md5('lexmill-mix:' || doc_id)[1:12])::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS r
  FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
y AS (SELECT *, floor(want)::BIGINT AS sure, want - floor(want) AS p FROM x),
k AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN r / (1 - r) / (p / (1 - p)) END AS rank FROM y),
b AS (
  SELECT *, floor(rank * (p / (1 - p)) / (1 + rank * (p / (1 - p))) * greatest(ceil(n / 4096.0), 1)) AS bin FROM k),
o AS (SELECT source, max(target) - sum(sure * size) AS open FROM b GROUP BY source),
q AS (
  SELECT source, bin, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY bin) AS after FROM b WHERE bin IS NOT NULL GROUP BY source, bin),
v AS (
  SELECT b.*, q.after <= open AS whole, CASE WHEN after - words < open AND after > open THEN open - (after - words) END AS left_
  FROM b LEFT JOIN o ON o.source IS NOT DISTINCT FROM b.source LEFT JOIN q ON q.source IS NOT DISTINCT FROM b.source AND q.bin = b.bin),
e1 AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank) <= left_ AS fits FROM v WHERE left_ IS NOT NULL),
e2 AS (SELECT *, left_ - coalesce(sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source), 0) AS gap FROM e1),
e3 AS (
  SELECT *, CASE WHEN NOT fits THEN abs(size - gap) END AS off_ FROM e2),
e4 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off_ NULLS LAST, rank, size) AS place FROM e3),
m AS (SELECT rid FROM e4 WHERE fits OR (place = 1 AND off_ < gap))
SELECT v.doc_id, v.size, v.z AS source_size, v.target,
  ((sure + CASE WHEN m.rid IS NOT NULL THEN 1 WHEN whole THEN 1 ELSE 0 END) * v.size)::BIGINT AS taken
FROM v LEFT JOIN m ON m.rid = v.rid
"""

_RULES = {"symbols": ("n_symbols", "word_chars", 0.90, 10), "repeats": ("n_repeat_words", "n_words", 0.98, 3), "capitals": ("n_capitals", "word_chars", 0.98, 3), "word_length": ("word_chars", "n_words", 0.98, 3)}
_BUCKET = "CASE WHEN v <= 0 THEN 0 ELSE 1 + ceil(ln(v::DOUBLE) / ln(1.05::DOUBLE))::INTEGER END"
_VALUE = "CASE WHEN {b} = 0 THEN 0 ELSE floor(pow(1.05::DOUBLE, {b} - 1))::BIGINT END"


def _by_measure(i: int) -> str:
    return "CASE measure " + " ".join(f"WHEN '{m}' THEN {r[i]}" for m, r in _RULES.items()) + " END"


OP10 = rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
g AS (
  SELECT doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
z AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM z, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))))::BIGINT AS n_distinct,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals
  FROM w LEFT JOIN rep USING (doc_id)),
x AS (
  SELECT *, n_lines - n_distinct AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {", ".join(f"CASE WHEN {b} > 0 THEN 1000000 * {a} // {b} ELSE 0 END AS {k}" for k, (a, b, _, _) in _RULES.items())} FROM m),
long AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {k} AS v FROM x WHERE NOT base_failed" for k in _RULES)}),
c0 AS (SELECT lang, source, measure, {_BUCKET} AS b, count(*)::DOUBLE AS n FROM long GROUP BY ALL),
c1 AS (SELECT lang, measure, b, sum(n) AS n FROM c0 GROUP BY ALL),
c2 AS (SELECT measure, b, sum(n) AS n FROM c1 GROUP BY ALL),
s1 AS (
  SELECT lang, measure, b, sum(n) AS n FROM (
    SELECT * FROM c1 UNION ALL
    SELECT l.lang, c2.measure, c2.b, c2.n * 200 / t.d FROM (SELECT DISTINCT lang FROM c1) l, c2, (SELECT sum(n) AS d FROM c2 WHERE measure = 'symbols') t) GROUP BY ALL),
s0 AS (
  SELECT lang, source, measure, b, sum(n) AS n FROM (
    SELECT * FROM c0 UNION ALL
    SELECT k.lang, k.source, s1.measure, s1.b, s1.n * 200 / t.d FROM (SELECT DISTINCT lang, source FROM c0) k JOIN s1 ON s1.lang IS NOT DISTINCT FROM k.lang
      JOIN (SELECT lang, sum(n) AS d FROM s1 WHERE measure = 'symbols' GROUP BY lang) t ON t.lang IS NOT DISTINCT FROM k.lang) GROUP BY ALL),
h AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY b) + 1e-6 AS run, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM s0),
q AS (
  SELECT lang, source, measure, min(CASE WHEN run >= total * 0.5 THEN b END) AS b50, min(CASE WHEN run >= total * {_by_measure(2)} THEN b END) AS bup FROM h GROUP BY ALL),
f AS (
  SELECT lang, source, measure, up + {_by_measure(3)} * (up - low) AS fence
  FROM (SELECT *, {_VALUE.format(b="b50")} AS low, {_VALUE.format(b="bup")} AS up FROM q)),
bad AS (
  SELECT DISTINCT x.doc_id FROM x JOIN f ON f.lang IS NOT DISTINCT FROM x.lang AND f.source IS NOT DISTINCT FROM x.source
  WHERE CASE f.measure {" ".join(f"WHEN '{k}' THEN x.{k}" for k in _RULES)} END > fence)
SELECT x.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM x LEFT JOIN bad USING (doc_id)
"""
