"""SQL over the given tables for the queries that SQL can state.

The language filters, the ring, surrogates, BPE, template slots, the classifier and SimHash are tested against
brute force instead.
"""

from __future__ import annotations

from logspark.llm.licenses import COVERAGE, MERGE, MIN_VOTES, NOTICES, PHRASES, STRETCH, WORD
from logspark.llm.secret_scan import BASE, RULES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(
    f"({i}, {_quoted(label)}, {i < len(PHRASES)}, string_split({_quoted(text)}, ' '))" for i, (label, text) in enumerate([*PHRASES, *NOTICES])
)

_LICENSES = f"""
WITH t(tid, label, is_base, w) AS (VALUES {_TEMPLATES}),
g AS (SELECT tid, label, is_base, len(w) AS n_words, len(w) - 1 AS n_grams, i - 1 AS tpos, w[i] AS a, w[i + 1] AS b FROM t, unnest(range(1, len(w))) AS u(i)),
d AS (SELECT doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_quoted(WORD)}) AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM d, unnest(range(1, len(w))) AS u(i)),
h AS (SELECT doc_id, tid, label, is_base, n_words, n_grams, pos - tpos AS diagonal, pos, tpos FROM p JOIN g USING (a, b)),
v AS (SELECT doc_id, tid, label, is_base, n_words, n_grams, diagonal, count(*) AS votes, min(pos) AS f, max(pos) AS l
  FROM h GROUP BY ALL HAVING CASE WHEN is_base THEN count(*) = n_grams ELSE count(*) >= {MIN_VOTES} END),
s AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) > {MERGE}, true) AS apart FROM v WHERE NOT is_base),
k AS (SELECT *, sum(apart::INT) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS span FROM s),
c AS (SELECT k.doc_id, k.tid, k.label, k.span, count(DISTINCT h.tpos) / any_value(k.n_grams) AS covered, max(l) - min(f) + 2 AS n, any_value(k.n_words) AS n_words
  FROM k JOIN h ON h.doc_id = k.doc_id AND h.tid = k.tid AND h.diagonal = k.diagonal GROUP BY ALL),
found AS (
  SELECT doc_id, label, diagonal AS place, 1.0::DOUBLE AS score FROM v WHERE is_base UNION ALL
  SELECT doc_id, label, NULL, covered FROM c WHERE covered >= {COVERAGE} AND n <= {STRETCH} * n_words),
r AS (SELECT doc_id, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place IS NOT NULL) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
  max(score) AS score FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)"""

_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, {rank} AS rank, {_quoted(kind)} AS kind, {least} AS least, string_split_regex(x, {_quoted(pattern)}) AS gaps, "
    f"regexp_extract_all(x, {_quoted(pattern)}) AS found, regexp_extract_all(x, {_quoted(pattern)}, {group}) AS secret FROM d"
    for rank, (kind, pattern, group, least) in enumerate(RULES)
)
_LISTED = "kind || ':' || (e - n) || ':' || e"

_SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
m AS ({_MATCHES}),
u AS (SELECT doc_id, rank, kind, least, i, length(found[i]) AS n, length(secret[i]) AS size, length(gaps[i]) AS gap FROM m, unnest(range(1, len(found) + 1)) AS v(i)),
s AS (SELECT *, (sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS e FROM u),
k AS (SELECT * FROM s WHERE size >= least),
r AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  string_agg({_LISTED}, ',' ORDER BY e - n, rank) FILTER (rank < {len(BASE)}) AS base, string_agg({_LISTED}, ',' ORDER BY e - n, rank) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (doc_id)"""

# At the size of the given tables every bucket is probed, so the search is exact.
_NEIGHBOURS = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM e AS q JOIN e AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RANKED = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM q) GROUP BY ALL),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, len(w)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY doc_id, w, term),
g AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, c GROUP BY term, n_docs),
s AS (
  SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN t USING (term) JOIN g USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10"""

_COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
c AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, w[i:i + m - 1] AS words, count(*)::HUGEINT AS f FROM p, unnest(range(1, 6)) AS x(m), unnest(range(1, len(w) - m + 2)) AS u(i) GROUP BY ALL),
o AS (SELECT * FROM g WHERE f >= 100),
k AS (SELECT o.lang, o.words, o.f AS a, k, l.f AS l, r.f AS r, (1000 * o.f * n) // (l.f * r.f) AS score
  FROM o JOIN c USING (lang), unnest(range(1, len(o.words))) AS x(k)
  JOIN o AS l ON l.lang = o.lang AND l.words = o.words[1:k] JOIN o AS r ON r.lang = o.lang AND r.words = o.words[k + 1:]),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS best FROM k),
h AS (SELECT lang, words[i:i + m - 1] AS words, max(f) AS longest FROM o, unnest(range(2, len(words))) AS x(m), unnest(range(1, len(words) - m + 2)) AS u(i) GROUP BY ALL),
s AS (SELECT m.*, array_to_string(m.words, ' ') AS phrase FROM m LEFT JOIN h USING (lang, words) WHERE best = 1 AND (longest IS NULL OR 100 * longest < 100 * a)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM z JOIN c USING (lang) WHERE rank <= 2000"""

ORACLES: dict[str, str] = {
    "op1_license_scan": _LICENSES, "op2_secret_scan": _SECRETS, "op4_nearest_neighbours": _NEIGHBOURS, "op11_lexical_search": _RANKED,
    "op12_collocations": _COLLOCATIONS,
}
