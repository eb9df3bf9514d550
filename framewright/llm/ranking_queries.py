"""Queries of phrase mining and lexical search, each beside its SQL."""

from __future__ import annotations

from framewright.llm.collocations import collocations
from framewright.llm.lexical import ranked_search
from framewright.llm.registry import query, read

COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
tokens AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS (
  SELECT lang, k, w[i] AS w1, CASE WHEN k > 1 THEN w[i + 1] ELSE '' END AS w2, CASE WHEN k > 2 THEN w[i + 2] ELSE '' END AS w3
  FROM tokens, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, w1, w2, w3, count(*)::HUGEINT AS n FROM grams GROUP BY ALL),
words AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
pairs AS (
  SELECT p.lang, p.w1, p.w2, p.n AS a, x.n AS l, y.n AS r, 1000000 * p.n * p.n // (x.n * y.n) AS score
  FROM f p JOIN f x ON x.lang = p.lang AND x.k = 1 AND x.w1 = p.w1 JOIN f y ON y.lang = p.lang AND y.k = 1 AND y.w1 = p.w2
  WHERE p.k = 2 AND p.n >= 10),
threes AS (
  SELECT p.lang, p.w1, p.w2, p.w3, p.n AS a, x.n AS l1, yz.n AS r1, xy.n AS l2, z.n AS r2,
    1000000 * p.n * p.n // (x.n * yz.n) AS s1, 1000000 * p.n * p.n // (xy.n * z.n) AS s2
  FROM f p JOIN f x ON x.lang = p.lang AND x.k = 1 AND x.w1 = p.w1 JOIN f yz ON yz.lang = p.lang AND yz.k = 2 AND yz.w1 = p.w2 AND yz.w2 = p.w3
    JOIN f xy ON xy.lang = p.lang AND xy.k = 2 AND xy.w1 = p.w1 AND xy.w2 = p.w2 JOIN f z ON z.lang = p.lang AND z.k = 1 AND z.w1 = p.w3
  WHERE p.k = 3 AND p.n >= 10),
kept AS (
  SELECT lang, w1 || ' ' || w2 AS phrase, a, l, r, score FROM pairs p
  WHERE NOT EXISTS (SELECT 1 FROM threes t WHERE t.lang = p.lang AND t.w1 = p.w1 AND t.w2 = p.w2 AND 100 * t.a >= 50 * p.a)
    AND NOT EXISTS (SELECT 1 FROM threes t WHERE t.lang = p.lang AND t.w2 = p.w1 AND t.w3 = p.w2 AND 100 * t.a >= 50 * p.a)
  UNION ALL
  SELECT lang, w1 || ' ' || w2 || ' ' || w3, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM threes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, w.n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN words w ON w.lang = r.lang WHERE rank <= 2000
"""


@query("op11_collocations", COLLOCATIONS_SQL)
def op11_collocations(spark, sf_dir):
    return collocations(read(spark, sf_dir, "documents"))


SEARCH_SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
sizes AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
postings AS (SELECT term, doc_id, count(*) AS tf FROM terms GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM postings, sizes GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), sizes GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op13_lexical_search", SEARCH_SQL)
def op13_lexical_search(spark, sf_dir):
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
