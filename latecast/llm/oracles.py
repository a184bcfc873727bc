"""The same results in SQL that DuckDB runs over the given tables."""

from __future__ import annotations

OP1 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat('7:', doc_id::VARCHAR)) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, sum(source_size) OVER ()::BIGINT
           - coalesce(sum(3 * source_size) OVER o, 0)::BIGINT AS rest,
         sum(w) OVER ()::BIGINT - coalesce(sum(w) OVER o, 0)::BIGINT AS rest_w
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT rest, rest_w FROM r WHERE 3 * source_size * rest_w >= rest * w
  ORDER BY 3 * source_size / w, source NULLS LAST LIMIT 1),
b AS (
  SELECT r.source, r.source_size,
         CASE WHEN 3 * source_size * r.rest_w < r.rest * w THEN (3 * source_size)::DOUBLE
              ELSE (l.rest * w)::DOUBLE / l.rest_w END AS target,
         CASE WHEN 3 * source_size * r.rest_w < r.rest * w THEN 3 * source_size
              ELSE l.rest * w // l.rest_w END AS budget
  FROM r CROSS JOIN level l),
p AS (
  SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size
                 + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM p
"""


OP2 = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
b AS (SELECT *, regexp_replace(line, '^[ \t\x0B\x0C\r]+|[ \t\x0B\x0C\r]+$', '', 'g') AS bare FROM l),
g AS (SELECT bare FROM b WHERE bare <> ''
      GROUP BY bare HAVING count(DISTINCT coalesce('s' || source, 'n')) >= 10),
h AS (SELECT b.*, g.bare IS NOT NULL AS hit FROM b LEFT JOIN g ON b.bare = g.bare)
SELECT doc_id, count(*) FILTER (WHERE bare <> '') AS n_lines,
       count(*) FILTER (WHERE hit) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), ''))
         AS text_sha256
FROM h GROUP BY doc_id
"""

OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END) AS sh
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
      FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id
      WHERE 100 * common >= 85 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.reached = u.a)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reached) AS component_id,
       doc_id = min(reached) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

OP6 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP9 = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


OP11 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos,
         unnest(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN i + 34 <= len(ws)
                THEN md5(array_to_string(ws[i:i + 34], ' ')) END)) AS win
  FROM d),
m AS (SELECT *, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 THEN 1 ELSE 0 END AS again
      FROM w),
c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY pos
                ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m),
t AS (
  SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '') AS kept
  FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


OP13 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2),
         lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) AS s(m)),
f AS (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY ALL),
words AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, n AS a FROM f WHERE m > 1 AND n >= 30),
cut AS (
  SELECT c.*, k, array_to_string(ws[:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y
  FROM c, (VALUES (1), (2), (3)) AS s(k) WHERE k < m),
scored AS (
  SELECT cut.lang, cut.phrase, a, min({'s': ((2000000::HUGEINT * a) // (x.n + y.n))::BIGINT, 'k': k,
         'l': x.n, 'r': y.n}) AS best
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x
           JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y
  GROUP BY ALL),
parts AS (
  SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda n:
         list_transform(range(1, m - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))))) AS phrase
  FROM c WHERE m > 2),
longer AS (SELECT lang, phrase, max(a) AS most FROM parts GROUP BY ALL),
kept AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY best.s DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase
  WHERE o.most IS NULL OR 100 * o.most < 80 * a)
SELECT kept.lang, rank, phrase, a, best.l AS l, best.r AS r, words.n, best.s AS score
FROM kept JOIN words ON words.lang = kept.lang WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1, "op2_line_dedup": OP2, "op5_near_dup": OP5,
    "op6_exact_topk": OP6, "op7_source_mixing": OP7, "op9_warc": OP9,
        "op11_substring_dedup": OP11, "op13_collocations": OP13,
    }
