"""The text queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

from .licenses import NOTICES, PERCENT, PHRASES

OP9 = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS pos, words FROM w WHERE len(words) >= 35
), h AS (
  SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 34], ' ')) AS h FROM s
), r AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1
), c AS (
  SELECT DISTINCT doc_id, pos + d AS place FROM r, (SELECT unnest(range(35)) AS d)
), p AS (
  SELECT doc_id, list(place) AS gone FROM c GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN p ON w.doc_id = p.doc_id
"""

OP10 = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), s AS (
  SELECT doc_id, unnest(range(0, n - 199)) AS pos, h FROM d WHERE n >= 200
), k AS (
  SELECT doc_id, pos, md5(substr(h, 2 * pos + 1, 400)) AS k FROM s
), r AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY k) AS n FROM k) WHERE n > 1
), i AS (
  SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 200 THEN 0 ELSE 1 END AS fresh FROM r
), g AS (
  SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM i
), v AS (
  SELECT doc_id, min(pos) AS a, max(pos) + 200 AS z FROM g GROUP BY doc_id, g
), e AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM v
), t AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM e JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN head IS NULL THEN b ELSE unhex(head || substr(h, 2 * last + 1)) END) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), g AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(x, lambda y: y <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""

OP8 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id
FROM w JOIN c ON w.doc_id = c.a LEFT JOIN n ON w.doc_id = n.doc_id
"""

OP12 = """
WITH t AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS i))
), h AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM documents, t
), a AS (
  SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM h
), w AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN words
    ELSE list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS words FROM a
), s AS (
  SELECT doc_id, unnest(range(1, n - 4)) AS i, words FROM w WHERE n >= 12
), g AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 5], ' ')) AS g FROM s
), p AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i
), l AS (
  SELECT doc_id, q, min(i) - 1 AS start, count(*) + 5 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p) GROUP BY doc_id, q, island
), r AS (
  SELECT doc_id, start, length, min(q) AS period FROM l WHERE length >= 12 AND length >= 2 * q GROUP BY doc_id, start, length
), b AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS place FROM r
), o AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM r GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r
), u AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(n)) AS i FROM w WHERE doc_id IN (SELECT doc_id FROM r)
), k AS (
  SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN gone ON u.doc_id = gone.doc_id AND u.i = gone.i WHERE gone.i IS NULL GROUP BY u.doc_id
)
SELECT w.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256,
  sha256(CASE WHEN n_runs IS NULL THEN array_to_string(words, ' ') ELSE coalesce(kept, '') END) AS collapsed_sha256
FROM w LEFT JOIN o ON w.doc_id = o.doc_id LEFT JOIN b ON w.doc_id = b.doc_id AND place = 1 LEFT JOIN k ON w.doc_id = k.doc_id
"""


def _licenses() -> str:
    """Every block of every text against every notice, without any filter."""
    def words(column: str) -> str:
        plain = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"list_filter(string_split_regex({plain}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

    def rows(pairs: list[tuple[str, str]]) -> str:
        return ", ".join(f"('{label}', '{text}')" for label, text in pairs)

    return f"""
WITH d AS (SELECT doc_id, {words('text')} AS words FROM documents
), m AS (
  SELECT label, list_distinct(words) AS words, CAST(2 ** ceil(log2(len(words))) AS BIGINT) AS step
  FROM (SELECT label, {words('text')} AS words FROM (VALUES {rows([(label, one) for label, many in NOTICES.items() for one in many])}) v(label, text))
), f AS (SELECT label, {words('text')} AS words FROM (VALUES {rows([(label, one) for one, label in PHRASES.items()])}) v(label, text)
), p AS (
  SELECT doc_id, label, unnest(list_filter(range(len(d.words)), lambda i: d.words[i + 1:i + len(f.words)] = f.words)) AS place FROM d, f
), b AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_distinct(list(label)) AS labels FROM p GROUP BY doc_id
), s AS (SELECT DISTINCT step FROM m
), k AS (
  SELECT doc_id, step, list_distinct(words[start + 1:start + 2 * step]) AS words FROM (SELECT doc_id, step, words, unnest(range(0, len(words), step)) AS start FROM d, s)
), c AS (
  SELECT doc_id, label, len(list_intersect(k.words, m.words)) AS common, len(m.words) AS size FROM k JOIN m ON k.step = m.step
), e AS (
  SELECT doc_id, list_distinct(list(label)) AS labels, max(common / size) AS share FROM c WHERE 100 * common >= {PERCENT} * size GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(e.labels, [])))), ',') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN e ON d.doc_id = e.doc_id
"""


def text_sql() -> dict[str, str]:
    return {
        "op4_embedding_near_dedup": OP4, "op8_jaccard_join": OP8,
        "op9_substring_dedup": OP9, "op10_suffix_array_dedup": OP10,
        "op12_periodic_runs": OP12, "op13_license_scan": _licenses(),
    }
