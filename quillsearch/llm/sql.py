"""SQL oracles of the training-data queries, where SQL can express them."""

from __future__ import annotations

from quillsearch.functions.text import SPACE_RE2

_BEST = rf"""
WITH best AS (
  SELECT upper(regexp_replace(qid, '^{SPACE_RE2}+|{SPACE_RE2}+$', '', 'g')) AS qid, did, max(score) AS score
  FROM evaluation
  WHERE qid IS NOT NULL AND did IS NOT NULL AND score IS NOT NULL AND isfinite(score)
  GROUP BY ALL),
ranked AS (
  SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM best)
"""

_TERMS = """
WITH once AS (
  SELECT term, docno, line_no, arg_max(tf, written_at) AS tf FROM postings WHERE term IS NOT NULL GROUP BY ALL),
counted AS (
  SELECT term, CAST(coalesce(sum(tf), 0) AS BIGINT) AS occurrences, count(*) AS n_rows, count(DISTINCT docno) AS n_docs
  FROM once GROUP BY term),
total AS (SELECT count(DISTINCT docno) AS n FROM postings WHERE term IS NOT NULL)
"""

_VERSIONS = """
WITH RECURSIVE texts AS (SELECT docno, any_value(text) AS text FROM collection_docs WHERE text IS NOT NULL GROUP BY docno),
words AS (SELECT docno, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM texts),
seqs AS (SELECT DISTINCT docno, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS s FROM words),
sizes AS (SELECT docno, count(*) AS n FROM seqs GROUP BY docno),
shared AS (SELECT a.docno AS docno_a, b.docno AS docno_b, count(*) AS n FROM seqs a JOIN seqs b ON a.s = b.s AND a.docno < b.docno GROUP BY ALL),
pairs AS (SELECT docno_a, docno_b FROM shared s JOIN sizes x ON x.docno = docno_a JOIN sizes y ON y.docno = docno_b
          WHERE 2 * s.n >= x.n + y.n - s.n)
"""

_COSINES = """
WITH vecs AS (
  SELECT docno, any_value([x::DOUBLE FOR x IN vec]) AS v FROM lsi_matrix
  WHERE vec IS NOT NULL AND len(vec) = 128 AND len([x FOR x IN vec IF x IS NULL OR isnan(x)]) = 0
    AND len([x FOR x IN vec IF x <> 0]) > 0
  GROUP BY docno),
cosines AS (SELECT a.docno AS a, b.docno AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cos FROM vecs a JOIN vecs b ON a.docno <> b.docno),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS rank FROM cosines)
"""

# spaces inside a sequence aren't compared: it begins where a word begins, ends where one ends, and may cut words otherwise.
_WORDS = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM test_items WHERE text IS NOT NULL),
iseq AS (SELECT DISTINCT item_id, unnest([array_to_string(w[k:k + 4], '') FOR k IN range(1, len(w) - 3)]) AS s FROM i),
dseq AS (SELECT DISTINCT doc_id, unnest(flatten([[array_to_string(w[k:k + n], '') FOR k IN range(1, len(w) - n + 1)] FOR n IN range(0, 68)])) AS s FROM d),
size AS (SELECT item_id, count(*) AS sequences FROM iseq GROUP BY item_id)
"""

ORACLES = {
    "p7_words": _WORDS + """
        SELECT doc_id, item_id, count(*) AS shared, any_value(sequences) AS sequences
        FROM iseq JOIN dseq USING (s) JOIN size USING (item_id) GROUP BY doc_id, item_id HAVING count(*) * 3 >= any_value(sequences)""",
    "p8_limits": rf"""
        SELECT DISTINCT regexp_replace(lower(regexp_replace(source, '^{SPACE_RE2}+|{SPACE_RE2}+$', '', 'g')), '[\s_-]+', '_', 'g') AS source,
               0::BIGINT AS n_over, true AS within_a_document
        FROM source_weights WHERE source IS NOT NULL""",
    "p5_found": _COSINES + "SELECT DISTINCT least(a, b) AS docno_a, greatest(a, b) AS docno_b FROM ranked WHERE rank <= 5 AND cos >= 0.85",
    "p5_search": _COSINES + "SELECT a AS docno, b AS similar, cos FROM ranked WHERE rank <= 5 AND a % 100 = 0",
    "p3_found": _VERSIONS + "SELECT docno_a, docno_b FROM pairs",
    "p3_groups": _VERSIONS + """,
        ends AS (SELECT docno_a AS a, docno_b AS b FROM pairs UNION ALL SELECT docno_b, docno_a FROM pairs),
        reach AS (SELECT docno AS a, docno AS b FROM sizes UNION SELECT r.a, t.b FROM reach r JOIN ends t ON t.a = r.b),
        class AS (SELECT docno, md5(string_agg(s, '|' ORDER BY s)) AS c FROM seqs GROUP BY docno),
        links AS (SELECT x.docno, count(DISTINCT y.c) AS n FROM ends JOIN class x ON x.docno = a JOIN class y ON y.docno = b
                  WHERE x.c <> y.c GROUP BY ALL)
        SELECT a AS docno, min(b) AS group_id, coalesce(any_value(l.n), 0) AS n_links
        FROM reach LEFT JOIN links l ON l.docno = a GROUP BY a""",
    "p2_found": _BEST + "SELECT qid, did FROM ranked WHERE rank <= 10",
    "p2_topn": _BEST + "SELECT qid, did, rank, score FROM ranked WHERE rank <= 10",
    "p6_found": _TERMS + """
        SELECT term, 'rare' AS mark FROM counted WHERE n_docs = 1
        UNION ALL SELECT term, 'common' FROM counted, total WHERE n_docs * 2 > n""",
    "p6_frequencies": _TERMS + """
        SELECT term, occurrences, n_rows, n_docs,
               nullif(concat_ws(',', CASE WHEN n_docs = 1 THEN 'rare' END, CASE WHEN n_docs * 2 > n THEN 'common' END), '') AS mark
        FROM counted, total""",
}
