"""Command line: build indexes, search, evaluate."""

from __future__ import annotations

import argparse

from quillsearch.functions.codecs import CODECS
from quillsearch.operators.encoded import DICTIONARIES, EncodedIndex
from quillsearch.operators.index import INDEX_MODES, Index
from quillsearch.operators.vector import LsiIndex
from quillsearch.plans.engine import RETRIEVALS, SearchEngine
from quillsearch.session import local_session
from quillsearch.sources import collection


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillsearch")
    sub = p.add_subparsers(dest="do", required=True)
    index = sub.add_parser("index")
    index.add_argument("--data-dir", default="collection")
    index.add_argument("--index-mode", choices=INDEX_MODES, default="bsbi")
    vector = sub.add_parser("vector-build")
    vector.add_argument("--data-dir", default="collection")
    vector.add_argument("--components", type=int, default=128)
    search = sub.add_parser("search")
    search.add_argument("query", nargs="*")
    run = sub.add_parser("evaluate")
    run.add_argument("--query-file", default="queries.txt")
    run.add_argument("--qrels", default="qrels.txt")
    run.add_argument("--any-judgments", action="store_true", help="don't insist on the known judgments")
    for x in (index, vector, search, run):
        x.add_argument("--output-dir", default="index")
    for x in (index, search, run):
        x.add_argument("--compression", choices=CODECS, default="vbe")
        x.add_argument("--term-dict", choices=tuple(DICTIONARIES), default="idmap")
    for x, k in ((search, 10), (run, 1000)):
        x.add_argument("--scoring", choices=("tfidf", "bm25"), default="tfidf")
        x.add_argument("--retrieval", choices=RETRIEVALS, default="full")
        x.add_argument("--k", type=int, default=k)
        x.add_argument("--bm25-k1", type=float, default=1.2)
        x.add_argument("--bm25-b", type=float, default=0.75)
        x.add_argument("--vector-dir")
    a = p.parse_args(args)
    spark = local_session("*")
    if a.do == "index":
        made = Index.build(collection.read_collection(spark, a.data_dir), a.index_mode)
        EncodedIndex.save(made, a.output_dir, a.compression, a.term_dict)
        print(f"{made.n_docs} documents, average length {made.avg_dl:.3f}")
    elif a.do == "vector-build":
        made = LsiIndex.build(collection.read_collection(spark, a.data_dir), a.components)
        made.save(a.output_dir)
        print(f"{made.components} components")
    else:
        vectors = a.vector_dir or a.output_dir
        if a.retrieval == "faiss":
            if not LsiIndex.has_artifacts(spark, vectors):
                raise FileNotFoundError(f"there is no vector index in {vectors}; build one with vector-build")
            engine = SearchEngine(vectors=LsiIndex.load(spark, vectors))
        else:
            engine = SearchEngine(EncodedIndex.load(spark, a.output_dir, a.compression, a.term_dict))
        how = {"scoring": a.scoring, "retrieval": a.retrieval, "k1": a.bm25_k1, "b": a.bm25_b}
        if a.do == "search":
            asked = spark.createDataFrame([("Q", " ".join(a.query))], "qid string, text string") if a.query else collection.demo_queries(spark)
            texts = {r["qid"]: r["text"] for r in asked.collect()}
            top = collection.with_paths(engine.search(asked, a.k, **how), engine.paths)
            last = None
            for r in collection.result_lines(top).orderBy("qid", "rank").toLocalIterator():
                if r["qid"] != last:
                    print(f"Query  : {texts[r['qid']]}\nResults:")
                    last = r["qid"]
                print(r["line"])
        else:
            qrels = collection.read_qrels(spark, a.qrels)
            if not a.any_judgments:
                collection.check_judgments(qrels)
            got = engine.evaluate(collection.read_queries(spark, a.query_file), qrels, a.k, **how).head()
            for name, value in got.asDict().items():
                print(f"{name}: {value}")


if __name__ == "__main__":
    main()
