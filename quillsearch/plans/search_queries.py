"""Queries of the search engine's operators over the test tables, with their SQL oracles.

Corpus: ``collection_docs``, once per docno. Queries: the latest row of every qid. Judgments: ``qrels``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsearch.functions import codecs, scoring
from quillsearch.functions.text import SPACE_RE2, clean_key, words_by_pattern, words_by_space
from quillsearch.operators import dictionary, encoded, evaluate, index, retrieve, vector
from quillsearch.plans.engine import SearchEngine
from quillsearch.session import scratch, stored, table
from quillsearch.sources import collection

_INDEXES: dict[tuple[str, str], index.Index] = {}
_ENCODED: dict[tuple[str, str, str, str], encoded.EncodedIndex] = {}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(block, doc_id, text)`` of every docno with a text, once."""
    docs = table(spark, sf_dir, "collection_docs").where("text is not null and docno is not null")
    return docs.groupBy(F.col("docno").alias("doc_id")).agg(F.max("text").alias("text"), F.max("block").alias("block"))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(qid, text)``: the text delivered last."""
    rows = table(spark, sf_dir, "queries").where("qid is not null and text is not null")
    return rows.groupBy(clean_key(F.col("qid")).alias("qid")).agg(F.max_by("text", F.struct("created_at", "text")).alias("text"))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "qrels").where("qid is not null and did is not null")
    return rows.select(clean_key(F.col("qid")).alias("qid"), F.col("did").alias("doc_id")).distinct()


def built(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of a data directory, built once per application, as a search engine does."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = index.Index.build(corpus(spark, sf_dir))
    return _INDEXES[key]


def opened(spark: SparkSession, sf_dir: str, codec: str, terms: str) -> encoded.EncodedIndex:
    """The index as it lies on disk: written with a codec and a term dictionary once per application, and opened."""
    key = (spark.sparkContext.applicationId, sf_dir, codec, terms)
    if key not in _ENCODED:
        path = scratch(spark, "index")
        encoded.EncodedIndex.save(built(spark, sf_dir), path, codec, terms)
        _ENCODED[key] = encoded.EncodedIndex.load(spark, path, codec, terms)
    return _ENCODED[key]


def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids of all document paths, in sorted order."""
    return dictionary.dense_ids(table(spark, sf_dir, "collection_docs").select(F.col("doc_path").alias("term"))).toDF("doc_path", "doc_id")


def radix_tree_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all words of all queries by descent in the stored radix tree."""
    tree = opened(spark, sf_dir, "vbe", "patricia").dictionary
    return tree.ids_of(retrieve.query_terms(query_set(spark, sf_dir)))


def radix_tree_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms with their ids, read back from the labels of the stored radix tree."""
    return opened(spark, sf_dir, "vbe", "patricia").dictionary.all()


def stored_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings, decoded from the stored lists."""
    return opened(spark, sf_dir, "elias-gamma", "patricia").scan()


def bm25_topk_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.top_k(opened(spark, sf_dir, "standard", "idmap"), query_set(spark, sf_dir), 10)


def bm25_topk_vbe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.top_k(opened(spark, sf_dir, "vbe", "patricia"), query_set(spark, sf_dir), 10)


def bm25_topk_elias_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.pruned_top_k(opened(spark, sf_dir, "elias-gamma", "patricia"), query_set(spark, sf_dir), 10)


def tokenize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.size(words_by_space(F.col("text"))).cast("long").alias("n_tokens"))


def tokenize_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.size(words_by_pattern(F.col("text"))).cast("long").alias("n_tokens"))


def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings_of(corpus(spark, sf_dir))


def postings_block_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.merge_postings(index.block_postings(corpus(spark, sf_dir)))


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).docs


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.corpus_stats(built(spark, sf_dir).docs).withColumn("avg_dl", F.round("avg_dl", 6))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).terms


def postings_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of every word of every query."""
    return built(spark, sf_dir).lookup(retrieve.query_terms(query_set(spark, sf_dir)))


def term_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.dense_ids(built(spark, sf_dir).terms)


def radix_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.radix_nodes(built(spark, sf_dir).terms)


def radix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.lookup(built(spark, sf_dir).terms, retrieve.query_terms(query_set(spark, sf_dir)))


def gap_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.gap_rows(built(spark, sf_dir).postings).select("term", "doc_id", "gap")


def codec_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.codec_sizes(built(spark, sf_dir).postings)


def _hex(spark: SparkSession, sf_dir: str, codec: str) -> DataFrame:
    lists = index.encoded(built(spark, sf_dir).postings, codec)
    return lists.select("term", F.hex("ids").alias("ids_hex"), F.hex("tfs").alias("tfs_hex"))


def standard_encode_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(spark, sf_dir, "standard")


def vbe_encode_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(spark, sf_dir, "vbe")


def eg_encode_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(spark, sf_dir, "elias-gamma")


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings that an encoded and decoded index doesn't give back, per codec."""
    postings = built(spark, sf_dir).postings.select("term", "doc_id", "tf")
    out = None
    for codec in codecs.CODECS:
        back = index.decoded(index.encoded(postings, codec), codec).withColumn("side", F.lit(1))
        both = postings.withColumn("side", F.lit(-1)).unionByName(back)
        # term by term first, so that the final sum meets one number per term and document
        off = both.groupBy("term", "doc_id", "tf").agg(F.sum("side").alias("d")).agg(F.coalesce(F.sum(F.abs("d")), F.lit(0)).alias("mismatches"))
        row = off.select(F.lit(codec).alias("codec"), "mismatches")
        out = row if out is None else out.unionByName(row)
    return out


def term_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = retrieve.term_bounds(built(spark, sf_dir))
    return bounds.select("term", "df", "max_tf", F.round("ub_tfidf", 6).alias("ub_tfidf"), F.round("ub_bm25", 6).alias("ub_bm25"))


def _top(spark: SparkSession, sf_dir: str, pruned: bool = False, **options) -> DataFrame:
    run = retrieve.pruned_top_k if pruned else retrieve.top_k
    return run(built(spark, sf_dir), query_set(spark, sf_dir), 10, **options)


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, mode="tfidf")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, mode="bm25")


def bm25_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, mode="bm25", k1=2.0, b=0.5)


def tfidf_wand_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, pruned=True, mode="tfidf")


def bm25_wand_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, pruned=True, mode="bm25")


def query_dup_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query with its words twice: scores double."""
    twice = query_set(spark, sf_dir).select("qid", F.concat_ws(" ", "text", "text").alias("text"))
    return retrieve.top_k(built(spark, sf_dir), twice, 10)


def query_unknown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query with a word that no document has: the same result."""
    more = query_set(spark, sf_dir).select("qid", F.concat_ws(" ", "text", F.lit("§unknown§")).alias("text"))
    return retrieve.top_k(built(spark, sf_dir), more, 10)


def knn_exact_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest embeddings of every one whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vector.knn(rows, rows.where(F.col("id") % 100 == 0), 10)


def tfidf_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.cosine_top_k(corpus(spark, sf_dir), query_set(spark, sf_dir), 10)


def lsi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.LsiIndex.build(stored(corpus(spark, sf_dir), "corpus"), 128).query(query_set(spark, sf_dir), 10)


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir)


def eval_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the BM25 ranking of every query, 1,000 documents deep."""
    asked, judged = query_set(spark, sf_dir), judgments(spark, sf_dir)
    top = retrieve.top_k(built(spark, sf_dir), asked, 1000, judged=judged)
    return evaluate.per_query(top, judged, asked)


def eval_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mean(eval_per_query(spark, sf_dir))


def query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries written as lines ``QID words`` and read back."""
    path = scratch(spark, "queries")
    query_set(spark, sf_dir).select(F.concat_ws(" ", F.regexp_replace("qid", r"\s", "_"), F.regexp_replace("text", r"[\r\n]", " "))).write.text(path)
    return collection.read_queries(spark, path)


def qrels_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judgments written as lines ``QID DOCID`` and read back."""
    path = scratch(spark, "qrels")
    judgments(spark, sf_dir).select(F.concat_ws(" ", F.regexp_replace("qid", r"\s", "_"), "doc_id")).write.text(path)
    return collection.read_qrels(spark, path)


def dense_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance of all pairs of 30 queries and 1,033 documents."""
    return collection.dense_qrels(judgments(spark, sf_dir))


def demo_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.demo_queries(spark)


def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query through the engine, pruned, as printed lines."""
    engine = SearchEngine(built(spark, sf_dir))
    top = collection.with_paths(engine.search(query_set(spark, sf_dir), 10, "tfidf", "wand"), engine.paths)
    return collection.result_lines(top)


def engine_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SearchEngine(built(spark, sf_dir)).evaluate(query_set(spark, sf_dir), judgments(spark, sf_dir), 1000, scoring="bm25", retrieval="wand")


def scoring_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formulas where something is 0."""
    grid = spark.range(0, 54).select(
        (F.col("id") % 3 * 5).alias("n"), (F.floor(F.col("id") / 3) % 3 * 2).alias("df"), (F.floor(F.col("id") / 9) % 3).alias("tf"), (F.floor(F.col("id") / 27) * 7).alias("avg")
    )
    n, df, tf, avg = (F.col(c) for c in ("n", "df", "tf", "avg"))
    made = grid.withColumn("idf_tfidf", scoring.tfidf_idf(n, df)).withColumn("idf_bm25", scoring.bm25_idf(n, df))
    made = made.withColumn("tfidf", scoring.tfidf_term(F.col("idf_tfidf"), tf)).withColumn("bm25", scoring.bm25_term(F.col("idf_bm25"), tf, F.lit(9), avg, 1.2, 0.75))
    return made.select("n", "df", "tf", "avg", *(F.round(c, 6).alias(c) for c in ("idf_tfidf", "idf_bm25", "tfidf", "bm25")))


def lsi_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a vector index holds after it was saved and opened: components, terms, documents, and those of length 1."""
    path = scratch(spark, "lsi")
    vector.LsiIndex.build(stored(corpus(spark, sf_dir), "corpus"), 128).save(path)
    opened_ = vector.LsiIndex.load(spark, path)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda at, x: at + x.cast("double") * x))
    docs = opened_.docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.abs(length - 1) < 1e-5).cast("long")).alias("n_unit"))
    terms = opened_.terms.agg(F.count(F.lit(1)).alias("n_terms"), F.max(F.size("v")).cast("long").alias("components"))
    return terms.crossJoin(docs).select("components", "n_terms", "n_docs", "n_unit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokenize_ws, tokenize_word, postings_tf, postings_block_merge, doc_stats, corpus_stats, term_stats,
        postings_lookup, term_ids, radix_nodes, radix_lookup, gap_list, codec_sizes, standard_encode_hex, vbe_encode_hex,
        eg_encode_hex, codec_roundtrip, term_bounds, tfidf_topk, bm25_topk, bm25_params, tfidf_wand_topk,
        bm25_wand_topk, query_dup_terms, query_unknown_terms, knn_exact_l2, tfidf_cosine_topk, lsi_topk, qrels,
        eval_per_query, eval_mean, doc_ids, radix_tree_lookup, radix_tree_terms, stored_scan, bm25_topk_standard,
        bm25_topk_vbe, bm25_topk_elias_gamma, query_file, qrels_file, dense_qrels, demo_queries, engine_search,
        engine_evaluate, scoring_guards, lsi_artifacts,
    )
}

_DOCS = """docs AS (SELECT docno AS doc_id, max(text) AS text, max(block) AS block FROM collection_docs
  WHERE text IS NOT NULL AND docno IS NOT NULL GROUP BY docno)"""
_POST = _DOCS + rf""",
occ AS (SELECT doc_id, unnest(string_split_regex(text, '{SPACE_RE2}+')) AS term FROM docs),
post AS (SELECT term, doc_id, count(*) AS tf FROM occ WHERE term <> '' GROUP BY ALL),
dls AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS dl FROM post GROUP BY doc_id),
corp AS (SELECT count(*) AS n, avg(dl) AS a, min(dl) AS m FROM dls),
terms AS (SELECT term, count(*) AS df, max(tf) AS max_tf, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term)"""
_ASK = rf""",
asked AS (SELECT upper(regexp_replace(qid, '^{SPACE_RE2}+|{SPACE_RE2}+$', '', 'g')) AS qid, arg_max(text, struct_pack(c := created_at, t := text)) AS text
  FROM queries WHERE qid IS NOT NULL AND text IS NOT NULL GROUP BY 1),
qraw AS (SELECT qid, unnest(string_split_regex(text, '{SPACE_RE2}+')) AS term FROM asked),
qterms AS (SELECT qid, term, count(*) AS qtf FROM qraw WHERE term <> '' GROUP BY ALL)"""
_JUDGED = rf"""judged AS (SELECT DISTINCT upper(regexp_replace(qid, '^{SPACE_RE2}+|{SPACE_RE2}+$', '', 'g')) AS qid, did AS doc_id
  FROM qrels WHERE qid IS NOT NULL AND did IS NOT NULL)"""


def _bm25(k1: float, b: float) -> str:
    return f"ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * dl / a))"


_TFIDF = "ln(n::DOUBLE / df) * (1 + ln(tf))"


def _ranking(score: str, factor: int = 1, k: int = 10) -> str:
    return f"""{_POST}{_ASK},
scored AS (SELECT qid, doc_id, round(sum(qtf * {factor} * {score}), 6) AS score
  FROM qterms JOIN post USING (term) JOIN terms USING (term) JOIN dls USING (doc_id), corp GROUP BY ALL),
ranked AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored
  QUALIFY rank <= {k})"""


def _top_sql(score: str, factor: int = 1) -> str:
    return f"WITH {_ranking(score, factor)} SELECT qid, rank, doc_id, score FROM ranked"


_METRICS = f"""WITH {_ranking(_bm25(1.2, 0.75), k=1000)}, {_JUDGED},
rels AS (SELECT r.qid, r.rank, CASE WHEN j.qid IS NULL THEN 0 ELSE 1 END AS rel FROM ranked r LEFT JOIN judged j USING (qid, doc_id)),
rich AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS hits,
  row_number() OVER (PARTITION BY qid ORDER BY rel DESC, rank) AS ideal FROM rels),
sums AS (SELECT qid,
  0.2::DOUBLE * sum(CASE WHEN rank < n THEN rel * pow(0.8::DOUBLE, rank - 1) ELSE 0 END) AS rbp,
  sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg,
  sum(CASE WHEN ideal <= 10 THEN rel / log2(ideal + 1) ELSE 0 END) AS idcg,
  sum(CASE WHEN rel > 0 THEN hits::DOUBLE / rank ELSE 0 END) / nullif(sum(rel), 0) AS ap FROM rich GROUP BY qid),
per AS (SELECT asked.qid, round(coalesce(rbp, 0), 6) AS rbp, round(coalesce(dcg, 0), 6) AS dcg,
  round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg, round(coalesce(ap, 0), 6) AS ap FROM asked LEFT JOIN sums USING (qid))"""

_GAPS = _POST + ", gaps AS (SELECT term, doc_id, tf, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM post)"
_VBE = "array_to_string([printf('%02X', ((({0}) >> (7 * i)) & 127) + CASE WHEN i = 0 THEN 128 ELSE 0 END) FOR i IN range(CAST(ceil(length(bin({0})) / 7.0) AS BIGINT) - 1, -1, -1)], '')"
_BITS = "repeat('0', length(bin({0})) - 1) || bin({0})"
_BYTES = "array_to_string([printf('%02X', list_sum([CASE WHEN substr({0}, k * 8 + j, 1) = '1' THEN 1 << (8 - j) ELSE 0 END FOR j IN range(1, 9)])::BIGINT) FOR k IN range(0, CAST(ceil(length({0}) / 8.0) AS BIGINT))], '')"

ORACLES = {
    "tokenize_ws": rf"WITH {_DOCS} SELECT doc_id, len(list_filter(string_split_regex(text, '{SPACE_RE2}+'), lambda x: x <> '')) AS n_tokens FROM docs",
    "tokenize_word": rf"WITH {_DOCS} SELECT doc_id, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS n_tokens FROM docs",
    "postings_tf": f"WITH {_POST} SELECT term, doc_id, tf FROM post",
    "postings_block_merge": f"WITH {_POST} SELECT term, doc_id, tf FROM post",
    "doc_stats": f"WITH {_POST} SELECT doc_id, dl FROM dls",
    "corpus_stats": f"WITH {_POST} SELECT n AS n_docs, round(a, 6) AS avg_dl, m AS min_dl FROM corp",
    "term_stats": f"WITH {_POST} SELECT term, df, max_tf, cf FROM terms",
    "postings_lookup": f"WITH {_POST}{_ASK} SELECT term, doc_id, tf FROM post WHERE term IN (SELECT term FROM qterms)",
    "term_ids": f"WITH {_POST} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM terms",
    "radix_lookup": f"""WITH {_POST}{_ASK}, ids AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM terms)
        SELECT a.term, coalesce(term_id, -1) AS term_id FROM (SELECT DISTINCT term FROM qterms) a LEFT JOIN ids ON ids.term = a.term""",
    "radix_nodes": f"""WITH {_POST},
        nb AS (SELECT term, lead(term) OVER (ORDER BY term) AS next FROM terms),
        inn AS (SELECT substr(term, 1, coalesce(list_max([i FOR i IN range(1, least(length(term), length(next)) + 1)
                  IF substr(term, 1, i) = substr(next, 1, i)]), 0)::BIGINT) AS node FROM nb WHERE next IS NOT NULL),
        nodes AS (SELECT node, max(t) AS t FROM (SELECT term AS node, 1 AS t FROM terms UNION ALL SELECT node, 0 FROM inn UNION ALL SELECT '', 0) GROUP BY node),
        pre AS (SELECT node, unnest([substr(node, 1, i) FOR i IN range(0, length(node))]) AS p FROM nodes WHERE node <> ''),
        par AS (SELECT pre.node, arg_max(p, length(p)) AS parent FROM pre JOIN nodes ON nodes.node = p GROUP BY pre.node)
        SELECT node, parent, CASE WHEN parent IS NULL THEN node ELSE substr(node, length(parent) + 1) END AS label, t = 1 AS is_term
        FROM nodes LEFT JOIN par USING (node)""",
    "gap_list": f"WITH {_GAPS} SELECT term, doc_id, gap FROM gaps",
    "codec_sizes": f"""WITH {_GAPS} SELECT term, count(*) * 16 AS std_bytes,
        CAST(sum(ceil(length(bin(gap)) / 7.0)) + sum(ceil(length(bin(tf)) / 7.0)) AS BIGINT) AS vbe_bytes,
        CAST(8 + ceil(sum(2 * length(bin(gap + 1)) - 1) / 8.0) + ceil(sum(2 * length(bin(tf)) - 1) / 8.0) AS BIGINT) AS eg_bytes
        FROM gaps GROUP BY term""",
    "standard_encode_hex": f"""WITH {_POST} SELECT term,
        string_agg(array_to_string([printf('%02X', (doc_id >> (8 * i)) & 255) FOR i IN range(0, 8)], ''), '' ORDER BY doc_id) AS ids_hex,
        string_agg(array_to_string([printf('%02X', (tf >> (8 * i)) & 255) FOR i IN range(0, 8)], ''), '' ORDER BY doc_id) AS tfs_hex
        FROM post GROUP BY term""",
    "vbe_encode_hex": f"""WITH {_GAPS} SELECT term, string_agg({_VBE.format("gap")}, '' ORDER BY doc_id) AS ids_hex,
        string_agg({_VBE.format("tf")}, '' ORDER BY doc_id) AS tfs_hex FROM gaps GROUP BY term""",
    "eg_encode_hex": f"""WITH {_GAPS}, bits AS (SELECT term, count(*) AS n, string_agg({_BITS.format("gap + 1")}, '' ORDER BY doc_id) AS i,
        string_agg({_BITS.format("tf")}, '' ORDER BY doc_id) AS t FROM (SELECT * FROM gaps) GROUP BY term)
        SELECT term, printf('%08X', n) || {_BYTES.format("i")} AS ids_hex,
               printf('%08X', n) || {_BYTES.format("t")} AS tfs_hex FROM bits""",
    "codec_roundtrip": "SELECT unnest(['standard', 'vbe', 'elias-gamma']) AS codec, 0::BIGINT AS mismatches",
    "term_bounds": f"""WITH {_POST} SELECT term, df, max_tf, round(ln(n::DOUBLE / df) * (1 + ln(max_tf)), 6) AS ub_tfidf,
        round({_bm25(1.2, 0.75).replace(" tf ", " max_tf ").replace("(tf ", "(max_tf ").replace("* dl", "* greatest(m, 1)")}, 6) AS ub_bm25 FROM terms, corp""",
    "query_file": f"""WITH {_DOCS}{_ASK} SELECT regexp_replace(qid, '\\s', '_', 'g') AS qid,
        array_to_string(list_filter(string_split_regex(regexp_replace(text, '[\\r\\n]', ' ', 'g'), '{SPACE_RE2}+'), lambda x: x <> ''), ' ') AS text FROM asked""",
    "qrels_file": f"WITH {_JUDGED} SELECT DISTINCT regexp_replace(qid, '\\s', '_', 'g') AS qid, doc_id FROM judged",
    "dense_qrels": f"""WITH {_JUDGED}, grid AS (SELECT 'Q' || q AS qid, d AS doc_id FROM range(1, 31) a(q), range(1, 1034) b(d))
        SELECT qid, doc_id, CASE WHEN j.qid IS NULL THEN 0 ELSE 1 END AS rel FROM grid LEFT JOIN judged j USING (qid, doc_id)""",
    "demo_queries": "SELECT * FROM (VALUES "
    + ", ".join(f"('D{i + 1}', '{q}')" for i, q in enumerate(collection.DEMO_QUERIES))
    + ") AS v(qid, text)",
    "engine_search": f"WITH {_ranking(_TFIDF)} SELECT qid, rank, rpad(doc_id::VARCHAR, 30, ' ') || ' ' || printf('%.3f', round(score::DECIMAL(18, 6), 3)::DOUBLE) AS line FROM ranked",
    "engine_evaluate": _METRICS + """ SELECT count(*) AS n_queries, round(avg(rbp), 5) AS rbp, round(avg(dcg), 5) AS dcg,
        round(avg(ndcg), 5) AS ndcg, round(avg(ap), 5) AS ap FROM per""",
    "scoring_guards": """WITH g AS (SELECT id % 3 * 5 AS n, id // 3 % 3 * 2 AS df, id // 9 % 3 AS tf, id // 27 * 7 AS avg FROM range(54) t(id)),
        i AS (SELECT *, CASE WHEN n > 0 AND df > 0 THEN ln(n::DOUBLE / df) ELSE 0 END AS a,
              CASE WHEN n > 0 AND df > 0 THEN ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) ELSE 0 END AS b FROM g)
        SELECT n, df, tf, avg, round(a, 6) AS idf_tfidf, round(b, 6) AS idf_bm25,
               round(CASE WHEN tf > 0 THEN a * (1 + ln(tf)) ELSE 0 END, 6) AS tfidf,
               round(CASE WHEN tf > 0 THEN b * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 9 / CASE WHEN avg > 0 THEN avg ELSE 1 END)) ELSE 0 END, 6) AS bm25 FROM i""",
    "lsi_artifacts": rf"""WITH {_DOCS}, w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS term FROM docs),
        c AS (SELECT count(DISTINCT term) AS t, count(DISTINCT doc_id) AS d FROM w), n AS (SELECT count(*) AS n FROM docs)
        SELECT least(128, n - 1, t - 1) AS components, t AS n_terms, d AS n_docs, d AS n_unit FROM c, n""",
    "doc_ids": """SELECT doc_path, row_number() OVER (ORDER BY doc_path) - 1 AS doc_id
        FROM (SELECT DISTINCT doc_path FROM collection_docs WHERE doc_path IS NOT NULL)""",
    "radix_tree_lookup": f"""WITH {_POST}{_ASK}, ids AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM terms)
        SELECT a.term, coalesce(term_id, -1) AS term_id FROM (SELECT DISTINCT term FROM qterms) a LEFT JOIN ids ON ids.term = a.term""",
    "radix_tree_terms": f"WITH {_POST} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM terms",
    "stored_scan": f"WITH {_POST} SELECT term, doc_id, tf FROM post",
    "bm25_topk_standard": _top_sql(_bm25(1.2, 0.75)),
    "bm25_topk_vbe": _top_sql(_bm25(1.2, 0.75)),
    "bm25_topk_elias_gamma": _top_sql(_bm25(1.2, 0.75)),
    "tfidf_topk": _top_sql(_TFIDF),
    "bm25_topk": _top_sql(_bm25(1.2, 0.75)),
    "bm25_params": _top_sql(_bm25(2.0, 0.5)),
    "tfidf_wand_topk": _top_sql(_TFIDF),
    "bm25_wand_topk": _top_sql(_bm25(1.2, 0.75)),
    "query_dup_terms": _top_sql(_bm25(1.2, 0.75), 2),
    "query_unknown_terms": _top_sql(_bm25(1.2, 0.75)),
    "knn_exact_l2": """
        WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings)
        SELECT qid, rank, id, score FROM (
          SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
            SELECT q.vec_id AS qid, v.vec_id AS id, 0.0 - round(list_sum([(q.e[i] - v.e[i]) * (q.e[i] - v.e[i]) FOR i IN range(1, len(v.e) + 1)]), 6) AS score
            FROM v q, v WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""",
    "tfidf_cosine_topk": rf"""WITH {_DOCS}{_ASK},
        num AS (SELECT count(*) AS n FROM docs),
        dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS term FROM docs) GROUP BY ALL),
        w AS (SELECT term, ln((1.0::DOUBLE + n) / (1 + count(*))) + 1 AS idf FROM dt, num GROUP BY term, n),
        qt AS (SELECT qid AS doc_id, term, count(*) AS tf FROM (SELECT qid, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS term FROM asked) GROUP BY ALL),
        dv AS (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS x FROM dt JOIN w USING (term)),
        qv AS (SELECT doc_id AS qid, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS y FROM qt JOIN w USING (term)),
        s AS (SELECT qid, doc_id, round(sum(x * y), 6) AS score FROM qv JOIN dv USING (term) GROUP BY ALL)
        SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s QUALIFY rank <= 10""",
    "qrels": f"WITH {_JUDGED} SELECT qid, doc_id FROM judged",
    "eval_per_query": _METRICS + " SELECT * FROM per",
    "eval_mean": _METRICS + """ SELECT count(*) AS n_queries, round(avg(rbp), 5) AS rbp, round(avg(dcg), 5) AS dcg,
        round(avg(ndcg), 5) AS ndcg, round(avg(ap), 5) AS ap FROM per""",
}
