"""The rows of the registered queries in SQL, for those that SQL can express."""

from __future__ import annotations

from themeloom.llm import licences, sql_structure

_OP1 = r"""
WITH marked AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(\n)', '\1' || chr(1), 'g'),
    '([.!?][ \t])', '\1' || chr(1), 'g'), '(\p{Ll} )(\p{Lu})', '\1' || chr(1) || '\2', 'g') AS t FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, list_filter(string_split(t, chr(1)), lambda x: x <> '') AS u FROM marked),
units AS (SELECT doc_id, unnest(range(len(u))) AS k, unnest(u) AS unit FROM split),
placed AS (
  SELECT *, coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
         lower(trim(regexp_replace(unit, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm, len(regexp_extract_all(unit, '[^\x20\x09-\x0D]+')) AS n FROM units),
ranked AS (
  SELECT *, CASE WHEN n < 3 THEN 's' WHEN row_number() OVER (PARTITION BY norm ORDER BY doc_id, k) > 1 THEN 'r' ELSE 'o' END AS kind,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY doc_id, k) AS first_id FROM placed),
grouped AS (SELECT *, count(*) FILTER (WHERE kind = 'o') OVER (PARTITION BY doc_id ORDER BY k) AS g FROM ranked),
bounds AS (SELECT doc_id, g, min(k) AS a, max(k) AS b FROM grouped WHERE kind = 'r' GROUP BY ALL),
runs AS (
  SELECT doc_id, x.g, min(pos) AS s, max(pos + length(unit)) AS e, sum(n) AS words, arg_min(first_id, k) AS kept
  FROM grouped x JOIN bounds USING (doc_id) WHERE x.g = bounds.g AND k BETWEEN a AND b AND kind <> 'o' GROUP BY doc_id, x.g HAVING sum(n) >= 25),
stay AS (
  SELECT x.doc_id, string_agg(unit, '' ORDER BY k) AS text FROM grouped x
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = x.doc_id AND x.pos >= r.s AND x.pos < r.e) GROUP BY x.doc_id),
spans AS (SELECT doc_id, count(*) AS n, string_agg(s || '-' || e || ':' || kept, ',' ORDER BY s) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(stay.text, '') END AS text, coalesce(n, 0) AS n_removed, coalesce(spans, '') AS removed_spans
FROM documents d LEFT JOIN stay USING (doc_id) LEFT JOIN spans USING (doc_id)
"""

_OP2 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) v(d) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: list_contains(string_split('{stop}', ' '), x)))::BIGINT AS n_stop_words
  FROM w LEFT JOIN cov USING (doc_id)),
j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         concat_ws(',', CASE WHEN n_words < 50 THEN 'length' END,
           CASE WHEN n_words = 0 OR word_chars / n_words NOT BETWEEN 2 AND 15 THEN 'word_length' END,
           CASE WHEN n_symbols / n_words > 0.1 THEN 'symbols' END,
           CASE WHEN n_words = 0 OR n_stop_words / n_words < 0.06 THEN 'stop_words' END,
           CASE WHEN n_dup_lines / n_lines > 0.5 THEN 'repeated_lines' END) AS failed_rules FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, n_lines, n_stop_words, failed_rules FROM j
"""

_STOP = (
    "a an and are as at be been but by can for from had has have he her his i if in into is it its not of on or our she so "
    "than that the their them then there these they this to was we were what when which who will with would you your aber "
    "als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist "
    "mit nach nicht noch oder sich sie sind über um und von vor war wie wird zu zum zur au aux avec ce ces cette dans de "
    "des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour que qui sa se ses son sont sur "
    "un une vous al como con de del el ella en entre era es esta este ha la las lo los más me muy no o para pero por que se "
    "si sin sobre su sus también un una y ya"
)

_OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.a = doc_id GROUP BY doc_id
"""

_OP10 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.l > 0 AND b.l > 0
  WHERE list_dot_product(a.x, b.x) / (a.l * b.l) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN k USING (vec_id)
"""


def _op9() -> str:
    letters = {name: chr(0x100 + k) for k, name in enumerate(licences.SENTENCES)}
    known = ", ".join(f"('{s}', '{letters[name]}')" for name, forms in licences.SENTENCES.items() for s in forms)
    patterns = [(licence, r"\.{0,1}".join(letters[s] for s in sequence)) for licence, sequence in licences.RULES]
    either = "|".join(p for _, p in patterns)
    named = " ".join(f"WHEN regexp_full_match(m, '{p}') THEN '{licence}'" for licence, p in patterns)
    return rf"""
WITH s AS (
  SELECT doc_id, unnest(range(len(x))) AS k, unnest(x) AS sentence FROM (
    SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[ \t\r\f\v]+', '\1' || chr(10), 'g'), chr(10)) AS x FROM documents)),
known(form, letter) AS (VALUES {known}),
c AS (
  SELECT doc_id, string_agg(coalesce(letter, '.'), '' ORDER BY k) AS codes
  FROM (SELECT *, trim(regexp_replace(lower(sentence), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS norm FROM s WHERE trim(sentence, ' ') <> '')
  LEFT JOIN known ON form = norm GROUP BY doc_id),
f AS (SELECT d.doc_id, coalesce(codes, '') AS codes, regexp_extract_all(coalesce(codes, ''), '{either}') AS found FROM documents d LEFT JOIN c USING (doc_id))
SELECT doc_id, length(codes)::BIGINT AS n_sentences, length(replace(codes, '.', ''))::BIGINT AS n_known, len(found)::BIGINT AS n_matches,
       CASE WHEN len(found) > 0 THEN (strpos(codes, found[1]) - 1)::BIGINT END AS first_sentence,
       array_to_string(list_sort(list_distinct(list_transform(found, lambda m: CASE {named} END))), ',') AS licences FROM f
"""


def statements() -> dict[str, str]:
    return {
        "op1_line_dedup": _OP1, "op2_quality_rules": _OP2.replace("{stop}", _STOP), "op7_jaccard_join": _OP7,
        "op9_licences": _op9(), "op10_near_vectors": _OP10, **sql_structure.statements(),
    }
