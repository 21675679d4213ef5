"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from .license_rules import AFTER, BEFORE, compiled
from .queries import SEED

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (
  SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 100 = 0
), s AS (
  SELECT a.vec_id AS query_id, a.q AS asked, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

URLS = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), rules(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM h LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

MIX = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS.format('text')}) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS ticket FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM d GROUP BY source
), o AS (
  SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights,
    CAST(coalesce(sum(3 * source_size) OVER w, 0) AS BIGINT) AS before, CAST(coalesce(sum(weight) OVER w, 0) AS BIGINT) AS used
  FROM s WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST) AS k FROM o
), l AS (
  SELECT total - before AS rest, weights - used AS share FROM f WHERE cap * (weights - used) >= (total - before) * weight ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN share IS NULL OR cap * share < rest * weight THEN CAST(cap AS DOUBLE)
    ELSE CAST(rest AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(share AS DOUBLE) END AS target FROM f LEFT JOIN l ON true
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t
), x AS (
  SELECT doc_id, d.source, size, source_size, target, whole, CAST(floor(target) AS BIGINT) - whole * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ticket, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM x
"""

#: The control strings of the chat template in the order in which they are escaped, the escape character first.
_CONTROLS = ("<|", "</s>", "<s>", "[/INST]", "[INST]", "<</SYS>>", "<<SYS>>")


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\b')"
    for c in _CONTROLS:
        out = f"replace({out}, '{c}', '\\c{(chr(92) + 'j').join(c)}\\e')"
    return out


CHAT = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, '<|turn|>' || {_escaped('role')} || '<|says|>' || {_escaped('text')} || '<|end|>' AS formatted FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

#: Links of a table ``l(a, b)`` of both directions to the smallest number that each node reaches.
_REACHED = """r(node, low) AS (
  SELECT a, least(a, min(b)) FROM l GROUP BY a
  UNION
  SELECT l.a, min(r.low) FROM r JOIN l ON l.b = r.node GROUP BY l.a
), p AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS size FROM v
), l AS MATERIALIZED (
  SELECT s.vec_id AS a, t.vec_id AS b FROM u s JOIN u t ON s.vec_id <> t.vec_id AND len(s.x) = len(t.x)
  WHERE list_dot_product(s.x, t.x) / (s.size * t.size) >= 0.9
), {_REACHED}, n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(p.component_id, e.vec_id) AS component_id, coalesce(p.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN p ON p.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

REPEATS = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, {_WORDS.format('text')} AS w FROM documents
), k AS MATERIALIZED (
  SELECT doc_id, i, list_slice(w, i, i + 12) AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)
), f AS (SELECT win, min(doc_id) AS first FROM k GROUP BY win HAVING min(doc_id) < max(doc_id)
), g AS (
  SELECT doc_id, list_distinct(flatten(list(generate_series(i, i + 12)))) AS gone FROM k JOIN f USING (win) WHERE first < doc_id GROUP BY doc_id
), x AS (
  SELECT d.doc_id, d.w, coalesce(g.gone, []) AS gone FROM d LEFT JOIN g ON g.doc_id = d.doc_id
), h AS (
  SELECT doc_id, list_aggregate(list(word ORDER BY i), 'string_agg', ' ') AS kept FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM x) t
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS gd, unnest(gone) AS gi FROM x) q WHERE q.gd = t.doc_id AND q.gi = t.i) GROUP BY doc_id
)
SELECT x.doc_id, CAST(len(x.w) AS BIGINT) AS n_words, CAST(len(x.gone) AS BIGINT) AS n_removed, sha256(coalesce(h.kept, '')) AS kept_sha256
FROM x LEFT JOIN h ON h.doc_id = x.doc_id
"""

JACCARD = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, {_WORDS.format('text')} AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(list_transform(generate_series(1, greatest(1, len(w) - 4)), lambda i: list_slice(w, i, i + 4)))) AS grams FROM d WHERE len(w) > 0
), c AS MATERIALIZED (SELECT grams, min(doc_id) AS class_id, count(*) AS copies FROM s GROUP BY grams
), g AS (SELECT class_id, len(grams) AS n, unnest(grams) AS gram FROM c
), m AS (
  SELECT x.class_id AS a, y.class_id AS b FROM g x JOIN g y ON x.gram = y.gram AND x.class_id < y.class_id
  GROUP BY 1, 2 HAVING 5 * count(*) >= 4 * (any_value(x.n) + any_value(y.n) - count(*))
), l AS MATERIALIZED (SELECT a, b FROM m UNION ALL SELECT b, a FROM m
), {_REACHED}, n AS (SELECT a, sum(copies) AS n FROM l JOIN c ON c.class_id = l.b GROUP BY a)
SELECT e.doc_id, coalesce(c.class_id, e.doc_id) AS class_id, CAST(coalesce(n.n, 0) + coalesce(c.copies - 1, 0) AS BIGINT) AS n_links,
  coalesce(p.component_id, c.class_id, e.doc_id) AS component_id, coalesce(p.component_id, c.class_id, e.doc_id) = e.doc_id AS kept
FROM documents e LEFT JOIN s ON s.doc_id = e.doc_id LEFT JOIN c ON c.grams = s.grams LEFT JOIN p ON p.node = c.class_id LEFT JOIN n ON n.a = c.class_id
"""


def _draw(group: int) -> str:
    return f"CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), {8 * group - 7}, 8) AS BIGINT)"


INFILL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
    {_draw(1)} AS h1, {_draw(2)} AS h2, {_draw(3)} AS h3, {_draw(4)} AS h4 FROM documents
), c AS (
  SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def _crc_table() -> str:
    rows = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        rows.append(byte)
    return "[" + ", ".join(map(str, rows)) + "]::BIGINT[]"


_FEATURES = r"""
  SELECT {key} AS id, w, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f
  FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}) x"""

RESAMPLE = rf"""
WITH d AS MATERIALIZED ({_FEATURES.format(key="doc_id", table="documents")}
), b AS MATERIALIZED ({_FEATURES.format(key="item_id", table="benchmark")}
), df AS MATERIALIZED (SELECT id, unnest(f) AS f FROM d), bf AS MATERIALIZED (SELECT id, unnest(f) AS f FROM b
), u AS (SELECT DISTINCT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)
), k AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
    lambda s, c: xor(({_crc_table()})[(xor(s, c) & 255) + 1], s >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM u
), s AS (SELECT bucket, count(*) AS s FROM df JOIN k USING (f) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM bf JOIN k USING (f) GROUP BY bucket
), g AS (
  SELECT s.bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM df) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT count(*) FROM bf) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), w AS (SELECT id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY id
), r AS (
  SELECT d.id, len(d.w) AS n_words, CAST(len(d.f) AS BIGINT) AS n_features, coalesce(w.weight, 0) AS weight,
    coalesce(w.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('7:' || coalesce(CAST(d.id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN w ON w.id = d.id
), o AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, id) AS k, count(*) FILTER (n_words >= 20) OVER () AS n FROM r
)
SELECT id AS doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 25 * n // 100 THEN k END AS rank FROM o
"""

_RULES = ", ".join(f"({r.number}, '{r.label}', '{r.keyword}', '{r.pattern}', {r.priority}, {r.confidence}, '{r.kind}')" for r in compiled())

LICENSES = rf"""
WITH rules(rule, label, keyword, pattern, priority, confidence, kind) AS (VALUES {_RULES}
), d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), u AS (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d
), h AS (
  SELECT doc_id, p, w[p + 1] AS k, ' ' || array_to_string(w[greatest(p - {BEFORE}, 0) + 1 : p], ' ') || CASE WHEN p > 0 THEN ' ' ELSE '' END || '@' || array_to_string(w[p + 1 : p + {AFTER + 1}], ' ') || ' ' AS around
  FROM u WHERE w[p + 1] IN (SELECT keyword FROM rules)
), m AS (
  SELECT doc_id, p, rule, label, priority, confidence, kind, regexp_extract(around, pattern) AS m FROM h JOIN rules ON k = keyword WHERE regexp_matches(around, pattern)
), i AS MATERIALIZED (
  SELECT *, p - (len(string_split(string_split(m, '@')[1], ' ')) - 2) AS start, p - (len(string_split(string_split(m, '@')[1], ' ')) - 2) + len(string_split(m, ' ')) - 2 AS stop FROM m
), k AS (
  SELECT * FROM i x WHERE NOT EXISTS (
    SELECT 1 FROM i y WHERE y.doc_id = x.doc_id AND y.start <= x.start AND y.stop >= x.stop AND y.priority >= x.priority
      AND (y.start < x.start OR y.stop > x.stop OR y.priority > x.priority OR y.rule < x.rule))
), b AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM i WHERE kind = 'BASE' GROUP BY doc_id
), a AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM k UNION ALL SELECT doc_id, label FROM i WHERE kind = 'BASE') GROUP BY doc_id
), s AS (SELECT doc_id, CAST(max(confidence) AS DOUBLE) AS score FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""

#: Ids are distinct in the tables of these; texts and vectors are whole.
ORACLES = {
    "op1_topk": TOPK, "op2_urls": URLS, "op4_chat": CHAT, "op5_mix": MIX, "op6_neardup_vectors": NEAR_VECTORS, "op8_repeats": REPEATS,
    "op9_jaccard": JACCARD, "op11_infill": INFILL, "op12_licenses": LICENSES, "op13_resample": RESAMPLE,
}
