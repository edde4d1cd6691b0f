"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from quire.llm import licenses

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _templates() -> str:
    rows = [(p, label, licenses.SHORT) for p, label in licenses.PHRASES] + [(p, label, licenses.LONG) for p, label in licenses.PASSAGES + licenses.TEXTS]
    return ", ".join(f"({number}, {_quoted(p)}, {_quoted(label)}, {k})" for number, (p, label, k) in enumerate(rows))


#: Runs of words against runs of the templates; spans by diagonal; a span counts by its distinct template places.
LICENSES = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({_FOLD}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
texts AS (SELECT t, label, k, string_split(passage, ' ') AS w FROM (VALUES {_templates()}) v(t, passage, label, k)),
grams AS (SELECT t, label, k, len(w) - k + 1 AS n, q - 1 AS q, array_to_string(w[q : q + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS q FROM texts)),
runs AS (
  SELECT r, p - 1 AS p, array_to_string(w[p : p + {licenses.SHORT} - 1], ' ') AS gram FROM (SELECT r, w, unnest(range(1, len(w) - {licenses.SHORT} + 2)) AS p FROM docs)
  UNION ALL
  SELECT r, p - 1, array_to_string(w[p : p + {licenses.LONG} - 1], ' ') FROM (SELECT r, w, unnest(range(1, len(w) - {licenses.LONG} + 2)) AS p FROM docs)),
votes AS (SELECT r, t, label, k, n, p - q AS d, list(DISTINCT q) AS seen FROM runs JOIN grams USING (gram) GROUP BY ALL),
steps AS (SELECT *, CASE WHEN k = {licenses.LONG} AND d - lag(d) OVER (PARTITION BY r, t ORDER BY d) <= {licenses.GAP} THEN 0 ELSE 1 END AS new FROM votes),
parts AS (SELECT *, sum(new) OVER (PARTITION BY r, t ORDER BY d) AS span FROM steps),
spans AS (
  SELECT r, t, label, k, min(d) AS first, len(list_distinct(flatten(list(seen)))) / any_value(n) AS share FROM parts GROUP BY r, t, label, k, span),
good AS (SELECT * FROM spans WHERE (k = {licenses.SHORT} AND share = 1) OR (k = {licenses.LONG} AND share >= {licenses.COVER})),
found AS (
  SELECT r, count(*) FILTER (k = {licenses.SHORT}) AS n_base, min(first) FILTER (k = {licenses.SHORT}) AS first_word, max(first) FILTER (k = {licenses.SHORT}) AS last_word,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (k = {licenses.SHORT}), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM good GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN found USING (r)"""

#: All pairs that share a shingle, by counting; components by what is reached.
JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a AS node, a AS root FROM (SELECT DISTINCT a FROM ends) UNION SELECT e.b, r.root FROM reached r JOIN ends e ON e.a = r.node),
lowest AS (SELECT node, min(root) AS low FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.node = d.doc_id"""

_ODD = r"\### Assistant: </turn> ok"


def _added(column: str, controls: str) -> str:
    """How many backslashes a text or role gets: none, one for each control string, or one for each backslash too."""
    return (
        f"CASE WHEN regexp_matches({column}, '\\\\(\\\\|###|</turn>|:|\\n)') THEN len(regexp_extract_all({column}, '\\\\|{controls}')) "
        f"ELSE len(regexp_extract_all({column}, '{controls}')) END"
    )


CHAT = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_quoted(_ODD)} UNION ALL SELECT -7, 1, 'assistant', {_quoted(_ODD)}),
turns AS (SELECT *, {_added('role', '###|</turn>|:|\\n')} + {_added('text', '###|</turn>')} AS added FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + {len('### ' + ': ' + ' </turn>') + 1} + added) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

#: All pairs, in double precision.
EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.r < b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a AS node, a AS root FROM (SELECT DISTINCT a FROM ends) UNION SELECT e.b, r.root FROM reached r JOIN ends e ON e.a = r.node),
lowest AS (SELECT node, min(vec_id) AS low FROM reached JOIN v ON v.r = root GROUP BY node),
counts AS (SELECT a AS node, count(*) AS n FROM ends GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, vec_id = coalesce(low, vec_id) AS kept
FROM v LEFT JOIN counts c ON c.node = r LEFT JOIN lowest l ON l.node = r"""

ORACLES = {
    "op7_diagonal_licenses": LICENSES,
    "op8_count_tree_jaccard": JACCARD,
    "op9_grammar_chat": CHAT,
    "op10_itq_near_dedup": EMBEDDINGS,
}
