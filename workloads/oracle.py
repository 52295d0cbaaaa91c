"""The registered queries in plain SQL over the given tables, written independently of the engine.

Shared steps are named common table expressions; `_sql` puts the ones a statement needs in front.
"""

from __future__ import annotations

import re

from themeloom.functions import constants as C
from themeloom.operators.compare import CRITERIA
from workloads import fixtures as X


def _chars(characters: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in characters)


def _cleaned(text: str) -> str:
    out = f"regexp_replace(lower({text}), '[{_chars(C.WHITESPACE)}]', ' ', 'g')"
    for pattern in (C.REDACTION_RUN, C.DOLLAR_AMOUNT, C.URL, C.EMAIL, C.NON_LETTERS):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return f"trim(coalesce({out}, ''))"


def _content(cleaned: str) -> str:
    """Space-joined content words of a cleaned text."""
    for head, tail in C.CONTRACTIONS:
        cleaned = f"regexp_replace({cleaned}, '\\b({head})({tail})\\b', '\\1 \\2', 'g')"
    stop = ", ".join(f"'{w}'" for w in C.ENGLISH_STOPWORDS + C.DOMAIN_STOPWORDS)
    kept = f"list_filter(string_split({cleaned}, ' '), lambda w: length(w) >= 3 AND w NOT IN ({stop}))"
    return f"coalesce(array_to_string({kept}, ' '), '')"


_MASK = r"(^|[^\p{L}\p{N}_])X{2,}(?:[/\-]X{2,})*([^\p{L}\p{N}_]|$)"


def _masked(text: str) -> str:
    # Boundaries are consumed here, so a second round is needed for runs that share one.
    once = rf"regexp_replace({text}, '{_MASK}', '\1[redacted]\2', 'g')"
    return rf"regexp_replace({once}, '{_MASK}', '\1[redacted]\2', 'g')"


def _spaced(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{_chars(C.WHITESPACE)}]+', ' ', 'g'))"


def _short(text: str, n: int, suffix: str) -> str:
    return (f"CASE WHEN length({text}) <= {n} THEN {text} "
            f"ELSE regexp_replace(substr({text}, 1, {n}), ' [^ ]*$', '') || '{suffix}' END")


_labels = """SELECT m AS model, t AS topic, CASE t WHEN 4 THEN 'Topic 4' ELSE 'Source ' || source END AS name,
    CASE t WHEN 5 THEN NULL ELSE 'Style ' || (t % 3) END AS style
    FROM (SELECT DISTINCT source, substr(source, 4)::INT AS t FROM documents), (VALUES ('NMF'), ('LDA')) v(m)
    WHERE t < 11 AND t <> 9 AND (m = 'NMF' OR t < 2)"""
_weights = "list_transform(embedding[{a}:{b}], lambda x: greatest(x::DOUBLE, 0.0))"

CTES: dict[str, str] = {
    "cleaned": f"SELECT doc_id, source, lang, text, {_cleaned('text')} AS cleaned FROM documents",
    "content": f"SELECT doc_id, source, lang, text, {_content('cleaned')} AS clean_text FROM cleaned",
    "corpus": f"""SELECT * FROM content WHERE clean_text <> ''
        AND len(regexp_extract_all(text, '[^{_chars(C.WHITESPACE)}]+')) >= {C.MIN_WORDS}""",
    "tokens": """SELECT doc_id, u.word, u.pos - 1 AS pos FROM corpus,
        LATERAL (SELECT unnest(string_split(clean_text, ' ')) AS word,
                        generate_subscripts(string_split(clean_text, ' '), 1) AS pos) u""",
    "lengths": "SELECT doc_id, count(*) AS words FROM tokens GROUP BY doc_id",
    "terms": """SELECT doc_id, word AS term FROM tokens WHERE length(word) >= 2 UNION ALL
        SELECT doc_id, word || ' ' || following FROM (SELECT doc_id, word,
          lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM tokens WHERE length(word) >= 2)
        WHERE following IS NOT NULL""",
    "cells": "SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL",
    "vocabulary": f"""SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, df, tf FROM (
        SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM cells GROUP BY term
        HAVING count(*) >= {C.MIN_DF} AND count(*) <= {C.MAX_DF} * (SELECT count(*) FROM corpus)
        ORDER BY tf DESC, term LIMIT {C.MAX_FEATURES})""",
    "tfidf": """SELECT doc_id, term_id, term, tf, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS tfidf FROM (
        SELECT c.doc_id, v.term_id, c.term, c.tf,
          c.tf * (ln((1.0 + (SELECT count(*) FROM corpus)) / (1.0 + v.df)) + 1) AS x
        FROM cells c JOIN vocabulary v USING (term))""",
    "topic_labels": _labels,
    "doc_topic": f"""SELECT 'NMF' AS model, vec_id AS doc_id, {_weights.format(a=1, b=X.TOPICS)} AS weights FROM embeddings
        UNION ALL SELECT 'LDA', vec_id, {_weights.format(a=X.TOPICS + 1, b=2 * X.TOPICS)} FROM embeddings""",
    "doc_weights": """SELECT model, doc_id, generate_subscripts(weights, 1) - 1 AS topic, unnest(weights) AS weight,
        list_sum(weights) AS total FROM doc_topic""",
    "assigned": """SELECT model, doc_id, arg_max(topic, {'w': weight, 't': -topic}) AS topic FROM doc_weights
        GROUP BY model, doc_id""",
    "topic_grid": f"SELECT model, topic FROM (VALUES ('NMF'), ('LDA')) m(model), range({X.TOPICS}) r(topic)",
    "counts": """SELECT g.model, g.topic, count(a.doc_id) AS documents FROM topic_grid g
        LEFT JOIN assigned a ON a.model = g.model AND a.topic = g.topic GROUP BY g.model, g.topic""",
    "shares": "SELECT *, documents / sum(documents) OVER (PARTITION BY model) AS share FROM counts",
    "named": """SELECT s.*, coalesce(l.name, 'Topic ' || s.topic) AS topic_name, l.style FROM shares s
        LEFT JOIN topic_labels l ON l.model = s.model AND l.topic = s.topic""",
    "summary": f"""SELECT model, sum(documents)::BIGINT AS documents,
        arg_max(topic, {{'s': share, 't': -topic}}) AS largest_topic, max(share) AS largest_share,
        arg_min(topic, {{'s': share, 't': topic}}) AS smallest_topic, min(share) AS smallest_share,
        sum(CASE WHEN share > 0 THEN -share * ln(share) ELSE 0 END) / ln(count(*)) AS evenness,
        count(*) FILTER (WHERE share < {C.NEAR_EMPTY_SHARE}) AS topics_under_2pct FROM shares GROUP BY model""",
    "topic_words": """SELECT t.model, t.topic, u.word AS term FROM (
        SELECT 'NMF' AS model, substr(source, 4)::INT AS topic, clean_text FROM content UNION ALL
        SELECT 'LDA', CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END, clean_text FROM content) t,
        LATERAL (SELECT unnest(string_split(t.clean_text, ' ')) AS word) u WHERE u.word <> ''""",
    "topic_term": "SELECT model, topic, term, count(*)::DOUBLE AS weight FROM topic_words GROUP BY ALL",
    "top_terms": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, topic ORDER BY weight DESC, term) AS rank
        FROM topic_term) WHERE rank <= {C.TOP_WORDS}""",
    "diversity": "SELECT model, count(DISTINCT term) / count(*) AS diversity FROM top_terms GROUP BY model",
    "usable": """SELECT model, topic, term AS word, count(*) AS times FROM top_terms
        WHERE term IN (SELECT word FROM tokens) GROUP BY ALL""",
    "starts": f"""SELECT DISTINCT t.doc_id, t.word, unnest(range(greatest(t.pos - {C.COHERENCE_WINDOW - 1}, 0),
        least(t.pos, greatest(l.words - {C.COHERENCE_WINDOW}, 0)) + 1)) AS start
        FROM tokens t JOIN lengths l USING (doc_id) WHERE t.word IN (SELECT word FROM usable)""",
    "window_totals": f"""SELECT d.model, sum(greatest(l.words - {C.COHERENCE_WINDOW - 1}, 1))::BIGINT AS windows FROM (
        SELECT DISTINCT u.model, t.doc_id FROM usable u JOIN tokens t ON t.word = u.word) d
        JOIN lengths l USING (doc_id) GROUP BY d.model""",
    "pairs_wanted": """SELECT DISTINCT a.word AS word1, b.word AS word2 FROM usable a
        JOIN usable b ON a.model = b.model AND a.topic = b.topic AND a.word <= b.word""",
    "joint": """SELECT p.word1, p.word2, count(*) AS windows FROM starts a
        JOIN pairs_wanted p ON p.word1 = a.word
        JOIN starts b ON b.doc_id = a.doc_id AND b.start = a.start AND b.word = p.word2 GROUP BY ALL""",
    "npmi": f"""SELECT model, topic, a, ta, b, tb,
          ln((both_n / n + {C.COHERENCE_EPSILON}) / ((na / n) * (nb / n))) / -ln(both_n / n + {C.COHERENCE_EPSILON}) AS v
        FROM (SELECT x.model, x.topic, x.word AS a, x.times AS ta, y.word AS b, y.times AS tb,
            coalesce(j.windows, 0)::DOUBLE AS both_n, ja.windows::DOUBLE AS na, jb.windows::DOUBLE AS nb, w.windows::DOUBLE AS n
          FROM usable x JOIN usable y ON x.model = y.model AND x.topic = y.topic
          JOIN window_totals w ON w.model = x.model
          LEFT JOIN joint j ON j.word1 = least(x.word, y.word) AND j.word2 = greatest(x.word, y.word)
          JOIN joint ja ON ja.word1 = x.word AND ja.word2 = x.word
          JOIN joint jb ON jb.word1 = y.word AND jb.word2 = y.word)""",
    "coherence": """SELECT model, avg(c) AS coherence FROM (
        SELECT model, topic, sum(ta * sim) / sum(ta) AS c FROM (
          SELECT n.model, n.topic, n.a, n.ta, coalesce(sum(n.tb * n.v * s.s)
              / nullif(sqrt(sum(n.tb * n.v * n.v)) * sqrt(sum(n.tb * s.s * s.s)), 0), 0) AS sim
          FROM npmi n JOIN (SELECT model, topic, b, sum(ta * v) AS s FROM npmi GROUP BY ALL) s USING (model, topic, b)
          GROUP BY ALL) GROUP BY model, topic) GROUP BY model""",
    "sheets": """SELECT 'r' || (l_suppkey % 7) AS rater,
        CASE WHEN l_linenumber = 7 THEN 'EX' ELSE 'T' || lpad((l_partkey % 24 + 1)::VARCHAR, 2, '0') END AS code,
        CASE WHEN l_returnflag = 'R' AND l_linenumber = 6 THEN NULL ELSE trunc(l_quantity)::INT % 7 END AS wc,
        l_linenumber AS ef, l_linestatus AS suggested FROM lineitem""",
    "rating_key": """SELECT 'T' || lpad(i::VARCHAR, 2, '0') AS code, CASE WHEN i <= 11 THEN 'NMF' ELSE 'LDA' END AS model,
        (i - 1) % 11 AS topic FROM range(1, 23) r(i)""",
    "rated": """SELECT *, (wc + ef) / 2.0 AS overall FROM sheets JOIN rating_key USING (code)
        WHERE wc BETWEEN 1 AND 5 AND ef BETWEEN 1 AND 5""",
    "rated_topics": """SELECT model, topic, code, count(DISTINCT rater) AS raters, avg(wc) AS word_clarity,
        avg(ef) AS example_fit, avg(overall) AS overall, stddev_samp(overall) AS spread,
        string_agg(DISTINCT suggested, '; ' ORDER BY suggested) AS suggested_names FROM rated GROUP BY model, topic, code""",
    "rated_models": """SELECT r.*, s.rater_spread FROM (SELECT model, count(DISTINCT rater) AS raters, count(*) AS ratings,
          avg(wc) AS word_clarity, avg(ef) AS example_fit, avg(overall) AS overall FROM rated GROUP BY model) r
        LEFT JOIN (SELECT model, avg(spread) AS rater_spread FROM rated_topics GROUP BY model) s USING (model)""",
    "examples": f"""SELECT model, topic, rn AS example, doc_id, weight, CASE WHEN total > 0 THEN weight / total ELSE 0 END AS share
        FROM (SELECT *, row_number() OVER (PARTITION BY model, topic ORDER BY weight DESC, doc_id) AS rn FROM doc_weights)
        WHERE rn <= {C.SHEET_EXAMPLES}""",
    "criteria": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{c}', {'NULL' if h is None else h})" for i, (c, h) in enumerate(CRITERIA)) + ") t(position, criterion, higher)",
    "measured": """SELECT 'Coherence (c_v)' AS criterion, model, coherence AS value FROM coherence
        UNION ALL SELECT 'Diversity', model, diversity FROM diversity
        UNION ALL SELECT 'Interpretability (1 to 5)', model, overall FROM rated_models
        UNION ALL SELECT 'Distribution evenness (0 to 1)', model, evenness FROM summary
        UNION ALL SELECT 'Largest topic', model, largest_share FROM summary
        UNION ALL SELECT 'Topics under 2%', model, topics_under_2pct FROM summary""",
    "compared": """SELECT c.position, c.criterion, l.value AS lda, n.value AS nmf,
        CASE WHEN c.higher IS NULL OR l.value IS NULL OR n.value IS NULL OR abs(l.value - n.value) < 1e-9 THEN ''
             WHEN (n.value > l.value) = c.higher THEN 'NMF' ELSE 'LDA' END AS ahead
        FROM criteria c LEFT JOIN (SELECT * FROM measured WHERE model = 'LDA') l USING (criterion)
        LEFT JOIN (SELECT * FROM measured WHERE model = 'NMF') n USING (criterion)""",
    "sweep": """SELECT 4 + (n_chars % 9) AS n_topics, round(avg(doc_id % 97) / 97, 4) AS lda_coherence,
        round(avg(doc_id % 89) / 89, 4) AS nmf_coherence FROM documents GROUP BY 1""",
    "map_terms": """SELECT model, topic % 11 AS topic, term, sum(weight) AS weight FROM topic_term GROUP BY ALL""",
    "phi": "SELECT *, weight / sum(weight) OVER (PARTITION BY model, topic) AS phi FROM map_terms",
    "mapped": """SELECT d.model, d.topic, d.weight / d.total * l.words AS f FROM doc_weights d JOIN lengths l USING (doc_id)
        WHERE d.total > 0""",
    "prevalence": """SELECT *, frequency / sum(frequency) OVER (PARTITION BY model) AS proportion FROM (
        SELECT model, topic, sum(f) AS frequency FROM mapped GROUP BY ALL)""",
    "map_freq": """SELECT *, frequency / (SELECT sum(p.frequency) FROM prevalence p WHERE p.model = q.model) AS term_proportion FROM (
        SELECT f.model, f.topic, f.term, f.phi, p.proportion, f.phi * p.frequency AS topic_frequency,
          sum(f.phi * p.frequency) OVER (PARTITION BY f.model, f.term) AS frequency,
          f.phi / sum(f.phi) OVER (PARTITION BY f.model, f.term) AS phi_of_term
        FROM phi f JOIN prevalence p ON p.model = f.model AND p.topic = f.topic) q""",
    "transcripts": """SELECT recording, length(said) / 15.0 AS seconds, CASE WHEN length(said) % 10 = 0 THEN '' ELSE said END AS transcript,
        CASE WHEN said = '' THEN 'Couldn''t read this file (ValueError)' ELSE '' END AS note FROM (
          SELECT conv_id || '_' || turn AS recording, CASE WHEN conv_id % 17 = 0 THEN '' ELSE coalesce(text, '') END AS said FROM conversations)""",
    "lexicon": """SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(string_split(cleaned, ' ')) AS word FROM cleaned
        WHERE len(regexp_extract_all(text, '[^""" + _chars(C.WHITESPACE) + """]+')) >= 15) WHERE word <> '' GROUP BY word""",
    # Noun endings in order, irregular plurals, and words that stay as they are.
    "endings": """SELECT * FROM (VALUES (0, 's', ''), (1, 'ses', 's'), (2, 'ves', 'f'), (3, 'xes', 'x'), (4, 'zes', 'z'), (5, 'ches', 'ch'),
        (6, 'shes', 'sh'), (7, 'men', 'man'), (8, 'ies', 'y')) e(rank, old, new)""",
    "irregular": """SELECT * FROM (VALUES ('women', 'woman'), ('children', 'child'), ('feet', 'foot'), ('teeth', 'tooth'), ('geese', 'goose'),
        ('mice', 'mouse'), ('lives', 'life'), ('wives', 'wife'), ('knives', 'knife'), ('selves', 'self'), ('thieves', 'thief'),
        ('halves', 'half'), ('analyses', 'analysis'), ('bases', 'basis'), ('crises', 'crisis'), ('criteria', 'criterion'),
        ('indices', 'index'), ('matrices', 'matrix')) i(word, form)""",
    "invariant": """SELECT unnest(string_split('news series species means perhaps always besides thus plus bus gas lens status bonus virus campus
 census focus basis analysis crisis thesis physics mathematics economics politics ethics yes', ' ')) AS word""",
    "forms": """SELECT l.word, l.df, i.form, 0 AS rank FROM lexicon l JOIN irregular i ON i.word = l.word UNION ALL
        SELECT l.word, l.df, left(l.word, length(l.word) - length(e.old)) || e.new, e.rank FROM lexicon l JOIN endings e
          ON ends_with(l.word, e.old) AND NOT (e.old = 's' AND ends_with(l.word, 'ss')) WHERE l.word NOT IN (SELECT word FROM irregular) UNION ALL
        SELECT l.word, l.df, l.word, 99 FROM lexicon l WHERE l.word NOT IN (SELECT word FROM irregular)
          AND (ends_with(l.word, 's') OR ends_with(l.word, 'men'))""",
    "lemma_pairs": """SELECT word, lemma FROM (SELECT f.word, arg_min(f.form, {'n': length(f.form), 'r': f.rank}) AS lemma FROM forms f
        JOIN lexicon b ON b.word = f.form WHERE f.word NOT IN (SELECT trim(word, chr(10)) FROM invariant) AND (f.form = f.word OR b.df >= 0.1 * f.df)
        GROUP BY f.word) WHERE lemma <> word""",
    "lem_tokens": "SELECT t.doc_id, coalesce(l.lemma, t.word) AS word, t.pos FROM tokens t LEFT JOIN lemma_pairs l ON l.word = t.word",
    "lem_terms": """SELECT doc_id, word AS term FROM lem_tokens WHERE length(word) >= 2 UNION ALL
        SELECT doc_id, word || ' ' || following FROM (SELECT doc_id, word,
          lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM lem_tokens WHERE length(word) >= 2)
        WHERE following IS NOT NULL""",
    "lem_cells": "SELECT doc_id, term, count(*) AS tf FROM lem_terms GROUP BY ALL",
    "lem_vocabulary": """SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, df FROM (
        SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM lem_cells GROUP BY term
        HAVING count(*) >= 5 AND count(*) <= 0.9 * (SELECT count(*) FROM corpus) ORDER BY tf DESC, term LIMIT 5000)""",
    "stand_in": "SELECT term_id, term, df, term_id % 11 AS topic, 1 + term_id / 1000.0::DOUBLE AS h FROM lem_vocabulary",
    "stand_in_scale": "SELECT topic, sum(h * h) AS hh FROM stand_in GROUP BY topic",
}
_NAMES = {name: re.compile(rf"\b{name}\b") for name in CTES}


def _needs(sql: str, found: list[str]) -> None:
    for name, pattern in _NAMES.items():
        if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            _needs(CTES[name], found)
            if name not in found:
                found.append(name)


def _sql(select: str) -> str:
    found: list[str] = []
    _needs(select, found)
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in found)
    return (f"WITH {head}\n" if found else "") + select


def _r(column: str, alias: str | None = None) -> str:
    return f"round({column}, 6) AS {alias or column}"


_masked_docs = "regexp_replace('{$' || n_chars || '.00} ' || text, '[0-9]', 'X', 'g')"
_known = """SELECT t.doc_id, count(DISTINCT t.term) AS known_terms FROM terms t JOIN vocabulary v USING (term) GROUP BY t.doc_id"""

CTES["known"] = _known


def _scoring(prefix: str, source: str, key: str, text: str) -> None:
    """Tables of the stand-in model's view of a table of texts: its words, and its weights by topic where it knows a term."""
    CTES[f"{prefix}_words"] = f"""SELECT t.{key}, coalesce(l.lemma, u.word) AS word, u.pos FROM (
          SELECT {key}, string_split({_content(_cleaned(text))}, ' ') AS ws FROM {source}) t,
        LATERAL (SELECT unnest(t.ws) AS word, generate_subscripts(t.ws, 1) AS pos) u LEFT JOIN lemma_pairs l ON l.word = u.word"""
    CTES[f"{prefix}_cells"] = f"""SELECT {key}, topic, h, count(*) * (ln((1.0 + (SELECT count(*) FROM corpus)) / (1.0 + df)) + 1) AS x FROM (
          SELECT {key}, word AS term FROM {prefix}_words WHERE length(word) >= 2 UNION ALL
          SELECT {key}, word || ' ' || lead(word) OVER (PARTITION BY {key} ORDER BY pos) FROM {prefix}_words WHERE length(word) >= 2)
        JOIN stand_in USING (term) GROUP BY {key}, topic, h, term_id, df"""
    CTES[f"{prefix}_weights"] = f"""SELECT c.{key}, c.topic, sum(c.x / n.l * c.h) / any_value(s.hh) AS w FROM {prefix}_cells c
        JOIN (SELECT {key}, sqrt(sum(x * x)) AS l FROM {prefix}_cells GROUP BY {key}) n USING ({key})
        JOIN stand_in_scale s ON s.topic = c.topic GROUP BY c.{key}, c.topic"""
    CTES[f"{prefix}_placed"] = f"""SELECT {key}, arg_max(topic, {{'w': w, 't': -topic}}) AS topic, max(w) / sum(w) AS confidence
        FROM {prefix}_weights GROUP BY {key}"""


_scoring("upload", "documents", "doc_id", "text")
_scoring("spoken", "transcripts", "recording", "transcript")
_scoring("item", "benchmark", "item_id", "text")
_NAMES = {name: re.compile(rf"\b{name}\b") for name in CTES}


def statements() -> dict[str, str]:
    s: dict[str, str] = {}
    s["clean_text"] = "SELECT doc_id, cleaned FROM cleaned"
    s["corpus_prepare"] = "SELECT doc_id, text AS raw_text, clean_text FROM corpus"
    s["corpus_product"] = "SELECT doc_id, clean_text FROM corpus WHERE source = 'src3'"
    s["corpus_sample"] = f"SELECT doc_id, text AS raw_text FROM documents ORDER BY md5('{C.SEED}:' || doc_id), doc_id LIMIT 300"
    s["readable_text"] = f"""SELECT doc_id, {_spaced(rf"regexp_replace({_masked('t')}, '{C.BRACED_AMOUNT}', '\1', 'g')")} AS readable,
        {_short('example', C.SHEET_CHARS, ' ...')} AS sheet_example, {_short('quoted', C.QUOTE_CHARS, ' …')} AS quote
        FROM (SELECT *, {_spaced(_masked('t'))} AS example,
              {_spaced(rf"regexp_replace({_masked('t')}, '{C.BRACED_AMOUNT}', '\1', 'g')")} AS quoted
              FROM (SELECT doc_id, {_masked_docs} AS t FROM documents))"""
    s["text_lines"] = f"""SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id,
        regexp_replace(unnest(regexp_split_to_array(text, '[{_chars(C.LINE_ENDS)}]')),
          '^[{_chars(C.WHITESPACE)}]+|[{_chars(C.WHITESPACE)}]+$', '', 'g') AS line FROM documents)
        WHERE line <> '' GROUP BY ALL"""
    s["recording_length"] = """SELECT recording, (round_even(seconds, 0)::BIGINT // 60) || ':' ||
        lpad((round_even(seconds, 0)::BIGINT % 60)::VARCHAR, 2, '0') AS length FROM transcripts"""
    s["recordings_unique"] = """SELECT md5(text) AS md5, min(conv_id || '_' || turn) AS recording, count(*) AS copies
        FROM conversations GROUP BY text"""
    s["csv_scan"] = "SELECT doc_id, source AS product, text AS narrative FROM documents"
    s["labels_explode"] = """SELECT model, doc_id::INT AS topic, CASE WHEN doc_id % 3 = 0 THEN 'Topic ' || doc_id ELSE source END AS name,
        CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS style
        FROM documents, (VALUES ('NMF'), ('LDA')) m(model) WHERE doc_id % 10 <> 0 AND NOT (model = 'LDA' AND doc_id % 2 = 0)"""
    s["labels_export"] = """SELECT '{"NMF":{' || string_agg('"' || topic || '":{"name":"' || name || '"' ||
          CASE WHEN style IS NULL THEN '' ELSE ',"style":"' || style || '"' END || '}', ',' ORDER BY topic) || '},"LDA":{}}' AS value
        FROM (SELECT topic, name, style FROM (SELECT substr(source, 4)::INT AS topic, min(lang) AS lang,
            CASE WHEN substr(source, 4)::INT % 3 = 0 THEN 'Topic ' || substr(source, 4) ELSE source END AS name,
            CASE WHEN substr(source, 4)::INT % 4 <> 0 THEN min(lang) END AS style FROM documents GROUP BY source)
          WHERE name <> 'Topic ' || topic OR style IS NOT NULL)"""
    s["top_words"] = "SELECT word, count(*) AS n FROM tokens GROUP BY word ORDER BY n DESC, word LIMIT 200"
    s["corpus_summary"] = f"""SELECT (SELECT count(*) FROM lengths) AS documents, (SELECT {_r('avg(words)', 'm')} FROM lengths) AS mean_words,
        (SELECT count(DISTINCT word) FROM tokens) AS vocabulary, (SELECT median(words) FROM lengths) AS median_words"""
    s["length_histogram"] = f"""SELECT b.bin::INT AS bin, {_r(f'lo + b.bin * (hi - lo) / {C.LENGTH_BINS}.0', 'from_words')},
        {_r(f'lo + (b.bin + 1) * (hi - lo) / {C.LENGTH_BINS}.0', 'to_words')}, count(l.words) AS documents
        FROM range({C.LENGTH_BINS}) b(bin) CROSS JOIN (SELECT min(words) AS lo, max(words) AS hi FROM lengths) e
        LEFT JOIN lengths l ON least((l.words - lo) * {C.LENGTH_BINS} // (hi - lo), {C.LENGTH_BINS - 1}) = b.bin GROUP BY ALL"""
    s["vocabulary"] = "SELECT term_id::INT AS term_id, term, df, tf FROM vocabulary"
    s["count_vectors"] = "SELECT doc_id, term_id::INT AS term_id, tf::DOUBLE AS value FROM tfidf"
    s["tfidf_vectors"] = f"SELECT doc_id, term_id::INT AS term_id, {_r('tfidf', 'value')} FROM tfidf"
    s["term_frequency"] = f"SELECT term_id::INT AS term_id, {_r('sum(tfidf)', 'frequency')} FROM tfidf GROUP BY term_id"
    s["known_terms"] = """SELECT c.doc_id, coalesce(k.known_terms, 0)::INT AS known_terms, coalesce(r.words, '') AS recognised FROM corpus c
        LEFT JOIN known k USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(word, ' ' ORDER BY first) AS words FROM (
          SELECT doc_id, word, min(pos) AS first FROM tokens WHERE word IN (SELECT term FROM vocabulary) GROUP BY ALL)
          GROUP BY doc_id) r USING (doc_id)"""
    s["top_terms"] = "SELECT model, topic, rank::INT AS rank, term, weight FROM top_terms"
    s["topic_word_lists"] = "SELECT model, topic, string_agg(term, ', ' ORDER BY rank) AS words FROM top_terms GROUP BY ALL"
    s["diversity"] = f"SELECT model, {_r('diversity')} FROM diversity"
    s["coherence_filter"] = """SELECT model, topic, word, count(*) AS times FROM (
        SELECT model, topic, CASE WHEN topic % 5 = 0 THEN unnest([term, reverse(term)]) ELSE unnest([term]) END AS word FROM top_terms)
        WHERE word IN (SELECT word FROM tokens) GROUP BY ALL"""
    s["window_counts"] = """SELECT NULL::VARCHAR AS model, word1, word2, windows FROM joint
        UNION ALL SELECT model, NULL, NULL, windows FROM window_totals"""
    s["coherence_cv"] = f"SELECT model, {_r('coherence')} FROM coherence"
    s["assign_topic"] = "SELECT model, doc_id, topic::INT AS topic FROM assigned"
    s["topic_counts"] = "SELECT model, topic::INT AS topic, documents FROM counts"
    s["topic_counts_present"] = "SELECT model, topic::INT AS topic, count(*) AS documents FROM assigned GROUP BY ALL"
    s["topic_distribution"] = """SELECT model, topic::INT AS topic, topic_name, coalesce(style, '') AS writing_style, documents,
        round_even(100.0 * share, 2) AS share_pct FROM named"""
    s["distribution_summary"] = f"""SELECT model, documents, largest_topic::INT AS largest_topic, {_r('largest_share')},
        smallest_topic::INT AS smallest_topic, {_r('smallest_share')}, {_r('evenness')}, topics_under_2pct FROM summary"""
    s["distribution_metrics"] = """SELECT s.model, s.documents, a.topic_name AS largest_topic, round_even(100 * s.largest_share, 1) AS largest_share_pct,
        b.topic_name AS smallest_topic, round_even(100 * s.smallest_share, 1) AS smallest_share_pct,
        round_even(s.evenness, 3) AS evenness, s.topics_under_2pct FROM summary s
        JOIN named a ON a.model = s.model AND a.topic = s.largest_topic JOIN named b ON b.model = s.model AND b.topic = s.smallest_topic"""
    s["style_share"] = f"""SELECT model, style AS writing_style, sum(documents)::BIGINT AS documents, {_r('sum(share)', 'share')}
        FROM named WHERE style IS NOT NULL GROUP BY ALL"""
    s["executive_facts"] = """SELECT n.model, n.topic::INT AS topic, n.topic_name, t.total, n.documents AS top_documents,
        round(100.0 * n.documents / t.total, 6) AS top_pct, t.total - n.documents AS remaining, 10::BIGINT AS other_topics,
        format('Across {:,} complaints analyzed with {}, the largest topic — "{}" — accounts for {}% of documents ({:,} complaints). The remaining {:,} complaints are distributed across the other 10 topics, suggesting a mix of dominant and long-tail complaint themes.',
          t.total, n.model, n.topic_name, round_even(100.0 * n.documents / t.total, 0)::BIGINT, n.documents, t.total - n.documents) AS sentence
        FROM named n JOIN (SELECT model, sum(documents)::BIGINT AS total FROM counts GROUP BY model) t USING (model)
        QUALIFY row_number() OVER (PARTITION BY n.model ORDER BY n.documents DESC, n.topic) = 1"""
    s["topic_rank"] = f"""SELECT model, topic::INT AS topic, documents, {_r('share')},
        row_number() OVER (PARTITION BY model ORDER BY documents DESC, topic)::INT AS size_rank FROM shares"""
    s["representative_docs"] = f"""SELECT e.model, e.topic::INT AS topic, e.example::INT AS example, e.doc_id, {_r('e.weight', 'weight')},
        {_r('e.share', 'share')}, d.text AS raw_text FROM examples e JOIN documents d USING (doc_id)"""
    s["top3_topics"] = f"""SELECT model, doc_id, rank::INT AS rank, topic::INT AS topic, {_r('share')} FROM (
        SELECT model, doc_id, topic, CASE WHEN total > 0 THEN weight / total ELSE weight END AS share,
          row_number() OVER (PARTITION BY model, doc_id ORDER BY weight DESC, topic) AS rank FROM doc_weights) WHERE rank <= 3"""
    s["alignment"] = """SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without_weights,
        (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS without_text"""
    s["rating_rejects"] = """SELECT rater, code, rater || ' ' || code AS problem, count(*) AS n FROM sheets
        WHERE code LIKE 'T__' AND NOT coalesce(wc BETWEEN 1 AND 5 AND ef BETWEEN 1 AND 5, false) GROUP BY ALL"""
    s["rating_by_topic"] = f"""SELECT model, topic::INT AS topic, code, raters, {_r('word_clarity')}, {_r('example_fit')}, {_r('overall')},
        {_r('spread')}, suggested_names FROM rated_topics"""
    s["rating_by_model"] = f"""SELECT model, raters, ratings, {_r('word_clarity')}, {_r('example_fit')}, {_r('overall')},
        {_r('rater_spread')} FROM rated_models"""
    s["blind_items"] = f"""SELECT 'T' || lpad(c.n::VARCHAR, 2, '0') AS code, c.model, c.topic, w.words, e.example_1, e.example_2, e.example_3 FROM (
          SELECT *, row_number() OVER (ORDER BY md5('{C.SHEET_SEED}:' || model || ':' || topic), model, topic) AS n
          FROM (SELECT DISTINCT model, topic FROM topic_term)) c
        JOIN (SELECT model, topic, string_agg(term, ', ' ORDER BY rank) AS words FROM top_terms GROUP BY ALL) w
          ON w.model = c.model AND w.topic = c.topic
        LEFT JOIN (SELECT model, topic, max(t) FILTER (WHERE example = 1) AS example_1, max(t) FILTER (WHERE example = 2) AS example_2,
            max(t) FILTER (WHERE example = 3) AS example_3 FROM (SELECT x.model, x.topic, x.example,
              {_short(_spaced(_masked('d.text')), C.SHEET_CHARS, ' ...')} AS t FROM examples x JOIN documents d USING (doc_id)) GROUP BY ALL) e
          ON e.model = c.model AND e.topic = c.topic"""
    s["best_k"] = """SELECT model, arg_max(n_topics, {'c': c, 'n': -n_topics}) AS n_topics, max(c) AS coherence FROM (
        SELECT 'LDA' AS model, n_topics, lda_coherence AS c FROM sweep UNION ALL
        SELECT 'NMF', n_topics, nmf_coherence FROM sweep) GROUP BY model"""
    s["model_comparison"] = f"SELECT position, criterion, {_r('lda', 'LDA')}, {_r('nmf', 'NMF')}, ahead FROM compared"
    s["criterion_leader"] = """SELECT model, CASE WHEN len(n) = 1 THEN n[1]
          ELSE array_to_string(n[:-2], ', ') || ' and ' || n[-1] END AS criteria
        FROM (SELECT ahead AS model, list(lower(regexp_replace(criterion, ' \\(.*$', '')) ORDER BY position) AS n
          FROM compared WHERE ahead <> '' GROUP BY ahead)"""
    s["topic_map_prevalence"] = f"SELECT model, topic::INT AS topic, {_r('frequency')}, {_r('proportion')} FROM prevalence"
    s["topic_map_saliency"] = f"""SELECT model, term, {_r('frequency')}, {_r('saliency')} FROM (
        SELECT model, term, max(frequency) AS frequency, max(term_proportion) * sum(phi_of_term * ln(phi_of_term / proportion)) AS saliency
        FROM map_freq GROUP BY ALL)"""
    s["topic_map_relevance"] = f"""SELECT model, topic::INT AS topic, "lambda", term, {_r('relevance')} FROM (
        SELECT model, topic, term, "lambda", "lambda" * ln(phi) + (1 - "lambda") * ln(phi / term_proportion) AS relevance
        FROM map_freq, (SELECT i / 100.0::DOUBLE AS "lambda" FROM range(101) t(i)) v)
        QUALIFY row_number() OVER (PARTITION BY model, topic, "lambda" ORDER BY round(relevance, 9) DESC, term) <= {C.MAP_TERMS}"""
    s["topic_map_tokens"] = f"""SELECT model, term, topic::INT AS topic, {_r('topic_frequency / frequency', 'share')} FROM map_freq
        WHERE topic_frequency >= 0.5 AND (model, term) IN (SELECT (model, term) FROM (SELECT model, term,
          row_number() OVER (PARTITION BY model ORDER BY round(sal, 9) DESC, term) AS r FROM (SELECT model, term,
            max(term_proportion) * sum(phi_of_term * ln(phi_of_term / proportion)) AS sal FROM map_freq GROUP BY ALL)) WHERE r <= {C.MAP_TERMS})"""
    s["topic_map_distance"] = f"""SELECT model, topic1, topic2, {_r('sum(js)', 'distance')} FROM (
        SELECT a.model, a.topic AS topic1, b.topic AS topic2, t.term,
          coalesce(CASE WHEN p.phi > 0 THEN p.phi * ln(p.phi / ((p.phi + coalesce(q.phi, 0)) / 2)) END, 0) / 2
          + coalesce(CASE WHEN q.phi > 0 THEN q.phi * ln(q.phi / ((coalesce(p.phi, 0) + q.phi) / 2)) END, 0) / 2 AS js
        FROM (SELECT DISTINCT model, topic FROM phi) a JOIN (SELECT DISTINCT model, topic FROM phi) b ON a.model = b.model AND a.topic < b.topic
        JOIN (SELECT DISTINCT model, term FROM phi) t ON t.model = a.model
        LEFT JOIN phi p ON p.model = a.model AND p.topic = a.topic AND p.term = t.term
        LEFT JOIN phi q ON q.model = b.model AND q.topic = b.topic AND q.term = t.term) GROUP BY ALL"""
    s["upload_assignments"] = """SELECT d.doc_id, d.lang, coalesce(l.name, 'Topic ' || a.topic) AS assigned_topic,
        round_even(coalesce(list_max(t.weights) / nullif(list_sum(t.weights), 0), 0), 3) AS confidence
        FROM assigned a JOIN doc_topic t ON t.model = a.model AND t.doc_id = a.doc_id JOIN documents d ON d.doc_id = a.doc_id
        LEFT JOIN topic_labels l ON l.model = a.model AND l.topic = a.topic WHERE a.model = 'NMF'"""
    s["report_tables"] = f"""SELECT n.model, n.topic::INT AS topic, n.topic_name, n.documents, w.words FROM named n
        LEFT JOIN (SELECT model, topic, string_agg(term, ', ' ORDER BY rank) AS words FROM top_terms GROUP BY ALL) w
          ON w.model = n.model AND w.topic = n.topic"""
    placed = f"""SELECT c.doc_id, coalesce(k.known_terms, 0)::INT AS known_terms, {C.N_TOPICS} AS topics, true AS non_negative,
        {{total}} AS total FROM corpus c LEFT JOIN known k USING (doc_id)"""
    s["lda_score"] = placed.format(total="1.0::DOUBLE")
    s["nmf_score"] = placed.format(total="true").replace("AS total FROM", "AS total_fits FROM")
    for name in ("nmf", "lda"):
        s[f"{name}_topics"] = f"""SELECT '{name.upper()}' AS model, t::INT AS topic, r::INT AS rank, true AS known, true AS falling,
            true AS distinct_terms, true AS non_negative FROM range(11) a(t), range(1, 11) b(r)
            WHERE (SELECT count(*) FROM vocabulary) >= 10"""
    s["final_metrics"] = """SELECT unnest(['Topic Coherence (c_v)', 'Topic Diversity']) AS "Metric", true AS "LDA", true AS "NMF" """
    s["topic_sweep"] = "SELECT k::INT AS n_topics, true AS lda_coherence, true AS nmf_coherence FROM range(4, 13) r(k)"
    s["corpus_lemmatised"] = "SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS clean_text FROM lem_tokens GROUP BY doc_id"
    s["score_upload"] = """SELECT d.doc_id, v.scored, d.source, coalesce(l.name, 'Topic ' || coalesce(p.topic, 0)) AS assigned_topic,
        round_even(coalesce(p.confidence, 0), 3) AS confidence FROM documents d CROSS JOIN (VALUES ('text'), ('doc_id')) v(scored)
        LEFT JOIN upload_placed p ON p.doc_id = d.doc_id AND v.scored = 'text'
        LEFT JOIN topic_labels l ON l.model = 'NMF' AND l.topic = coalesce(p.topic, 0)"""
    s["score_saved_model"] = """SELECT d.doc_id, d.source, coalesce(l.name, 'Topic ' || coalesce(p.topic, 0)) AS assigned_topic,
        round_even(coalesce(p.confidence, 0), 3) AS confidence FROM documents d LEFT JOIN upload_placed p USING (doc_id)
        LEFT JOIN topic_labels l ON l.model = 'NMF' AND l.topic = coalesce(p.topic, 0)"""
    s["rating_sheets_read"] = """SELECT code, wc::VARCHAR AS word_clarity, ef::VARCHAR AS example_fit, suggested AS suggested_name, count(*) AS n
        FROM sheets GROUP BY ALL"""
    s["score_transcripts"] = """SELECT t.recording, round_even(t.seconds, 1) AS length_seconds,
        (round_even(seconds, 0)::BIGINT // 60) || ':' || lpad((round_even(seconds, 0)::BIGINT % 60)::VARCHAR, 2, '0') AS length,
        t.transcript, p.topic::INT AS topic_number, CASE WHEN p.topic IS NULL THEN '' ELSE coalesce(l.name, 'Topic ' || p.topic) END AS topic_name,
        coalesce(l.style, '') AS writing_style, round_even(p.confidence, 3) AS confidence, 'NMF' AS model,
        CASE WHEN t.note <> '' THEN t.note WHEN trim(t.transcript) = '' THEN 'No speech recognised'
             WHEN p.topic IS NULL THEN 'No words the model recognises' ELSE '' END AS note
        FROM transcripts t LEFT JOIN spoken_placed p USING (recording) LEFT JOIN topic_labels l ON l.model = 'NMF' AND l.topic = p.topic"""
    s["transcript_topics"] = "SELECT 'NMF' AS model, topic::INT AS topic, count(*) AS documents FROM spoken_placed GROUP BY topic"
    s["classify_texts"] = """SELECT b.item_id, p.topic IS NOT NULL AS ok, p.topic::INT AS best,
        CASE WHEN p.topic IS NOT NULL THEN coalesce(l.name, 'Topic ' || p.topic) END AS topic_name, l.style AS writing_style,
        r.topics[1]::INT AS topic_1, round(r.shares[1], 6) AS share_1, r.topics[2]::INT AS topic_2, round(r.shares[2], 6) AS share_2,
        r.topics[3]::INT AS topic_3, round(r.shares[3], 6) AS share_3, CASE WHEN p.topic IS NOT NULL THEN coalesce(k.words, '') END AS recognised
        FROM benchmark b LEFT JOIN item_placed p USING (item_id) LEFT JOIN topic_labels l ON l.model = 'NMF' AND l.topic = p.topic
        LEFT JOIN (SELECT q.item_id, list(g.topic ORDER BY coalesce(w.w, 0) DESC, g.topic) AS topics,
            list(coalesce(w.w, 0) / q.total ORDER BY coalesce(w.w, 0) DESC, g.topic) AS shares
          FROM (SELECT item_id, sum(w) AS total FROM item_weights GROUP BY item_id) q CROSS JOIN range(11) g(topic)
          LEFT JOIN item_weights w ON w.item_id = q.item_id AND w.topic = g.topic GROUP BY q.item_id) r ON r.item_id = b.item_id
        LEFT JOIN (SELECT item_id, string_agg(word, ' ' ORDER BY first) AS words FROM (
            SELECT item_id, word, min(pos) AS first FROM item_words WHERE word IN (SELECT term FROM lem_vocabulary) GROUP BY ALL)
          GROUP BY item_id) k ON k.item_id = b.item_id"""
    return {name: _sql(sql) for name, sql in s.items()}
