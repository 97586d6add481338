"""python -m pagelode.cli init|crawl|parse|index|pagerank|search|explain|stats|web: the engine over Parquet folders."""

from __future__ import annotations

import argparse
import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagelode import web
from pagelode.logs import logger
from pagelode.operators import frontier, graph, pagerank, search
from pagelode.operators import index as ix
from pagelode.operators.index import Index
from pagelode.sources import pages as src
from pagelode.sources.web import WebSource
from pagelode.streaming.frontier import crawl


def _init(spark, a):
    empty = spark.createDataFrame([], "url string, doc_id string, domain string, depth int, priority int, status string, retries int, last_attempt_at timestamp, created_at timestamp, next_attempt_at timestamp")
    seeds = spark.createDataFrame([(u, 0) for u in a.urls], "url string, depth int")
    frontier.enqueue(empty, seeds, F.current_timestamp(), priority=1).write.mode("overwrite").parquet(f"{a.out}/url_queue.parquet")


def _parse(spark, a):
    raw = spark.read.parquet(a.pages)
    src.parsed(raw).withColumn("pagerank", F.lit(0.0)).write.mode("overwrite").parquet(f"{a.out}/pages.parquet")
    src.links(raw, general=True).write.mode("overwrite").parquet(f"{a.out}/links.parquet")


def _index(spark, a):
    pages = spark.read.parquet(f"{a.out}/pages.parquet")
    i = Index.of_pages(pages, ranks=pages.select("doc_id", F.col("pagerank").alias("rank")))
    for name in ("postings", "docs", "df"):
        key = "term" if name != "docs" else "doc_id"
        order = ["term", "doc_id"] if name == "postings" else [key]
        getattr(i, name).repartitionByRange(key).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{a.out}/{name}.parquet")
    docs, df = (spark.read.parquet(f"{a.out}/{n}.parquet").count() for n in ("docs", "df"))
    state = graph.index_status(spark, docs, df, _status(spark, a)["version"]).collect()
    spark.createDataFrame(state).write.mode("overwrite").parquet(f"{a.out}/index_status.parquet")
    print(json.dumps({"processed": docs}))


def _load(spark, a) -> Index:
    return Index(*(spark.read.parquet(f"{a.out}/{n}.parquet") for n in ("postings", "docs", "df")))


def _status(spark, a) -> dict:
    """The stored state of the index; a new one before the first build."""
    try:
        return spark.read.parquet(f"{a.out}/index_status.parquet").first().asDict()
    except AnalysisException:
        return {"last_indexed_at": None, "total_docs": 0, "total_terms": 0, "version": 0}


def _crawl(spark, a):
    """Rounds of visits over the network; pages and links found are added to the tables."""
    spark.dataSource.register(WebSource)
    queue = spark.read.parquet(f"{a.out}/url_queue.parquet")

    def fetched(chosen):
        # The urls of one round: as many as hosts times visits at once.
        asked = [r["url"] for r in chosen.select("url").collect()]
        got = spark.read.format("pagelode_web").option("urls", " ".join(asked)).option("partitions", a.threads).load()
        return chosen.select("url", "depth").join(got.drop("page_id"), "url")

    log = logger()
    queue, seen = crawl(queue, fetched, lambda k: F.current_timestamp(), a.rounds, max_pages=a.number, max_seconds=a.time, told=lambda x: log.info("%s", x))
    queue.write.mode("overwrite").parquet(f"{a.out}/url_queue.next")
    spark.read.parquet(f"{a.out}/url_queue.next").write.mode("overwrite").parquet(f"{a.out}/url_queue.parquet")
    if seen is not None:
        seen.withColumn("page_id", F.monotonically_increasing_id()).select("page_id", "url", "html").write.mode("append").parquet(f"{a.out}/raw.parquet")


def _explain(spark, a):
    print(json.dumps(web.explained(_load(spark, a), a.doc_id, a.query), ensure_ascii=False, indent=2))


def _web(spark, a):
    from wsgiref.simple_server import make_server

    pages, links = (spark.read.parquet(f"{a.out}/{n}.parquet") for n in ("pages", "links"))
    with make_server(a.host, a.port, web.create_app(_load(spark, a), pages, links)) as server:
        server.serve_forever()


def _pagerank(spark, a):
    pages, links = (spark.read.parquet(f"{a.out}/{n}.parquet") for n in ("pages", "links"))
    ranks = pagerank.pagerank(links.select(F.col("from_doc_id").alias("src"), F.col("to_doc_id").alias("dst")), pages)
    ranks.write.mode("overwrite").parquet(f"{a.out}/ranks.parquet")
    pagerank.titled(spark.read.parquet(f"{a.out}/ranks.parquet"), pages).show(truncate=80)


def _search(spark, a):
    print(json.dumps(search.search(_load(spark, a), a.query, a.limit, a.offset, a.mode), ensure_ascii=False, indent=2))


def _stats(spark, a):
    i = _load(spark, a)
    pages, links = (spark.read.parquet(f"{a.out}/{n}.parquet") for n in ("pages", "links"))
    print(graph.engine_stats(ix.index_stats(i.postings, i.docs), pages, links).toJSON().first())


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pagelode")
    parser.add_argument("--out", default="pagelode-data", help="the engine's folder")
    steps = parser.add_subparsers(dest="step", required=True)
    steps.add_parser("init").add_argument("urls", nargs="+")
    steps.add_parser("parse").add_argument("pages", help="Parquet with page_id, url, html")
    steps.add_parser("index")
    steps.add_parser("pagerank")
    steps.add_parser("stats")
    s = steps.add_parser("search")
    s.add_argument("query")
    s.add_argument("--mode", default="hybrid")
    s.add_argument("--limit", type=int, default=20)
    s.add_argument("--offset", type=int, default=0)
    c = steps.add_parser("crawl")
    c.add_argument("-n", "--number", type=int, help="pages, at most")
    c.add_argument("-t", "--time", type=float, help="seconds, at most")
    c.add_argument("--rounds", type=int, default=1000)
    c.add_argument("--threads", type=int, default=20, help="urls fetched side by side")
    e = steps.add_parser("explain")
    e.add_argument("doc_id")
    e.add_argument("query")
    w = steps.add_parser("web")
    w.add_argument("--host", default="127.0.0.1")
    w.add_argument("--port", type=int, default=8000)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("pagelode").getOrCreate()
    {"init": _init, "parse": _parse, "index": _index, "pagerank": _pagerank, "search": _search, "stats": _stats, "crawl": _crawl, "explain": _explain, "web": _web}[a.step](spark, a)


if __name__ == "__main__":
    main()
