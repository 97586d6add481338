"""The search facade: spelling, parsing, ranking, details, snippets and the count of full matches."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.config import DEFAULT, Config
from pagelode.functions import query as q

from . import ranking, spell
from .index import Index


def parse(spark, text: str) -> dict:
    """What a query says: tokens, terms, phrases, filters, intent."""
    row = spark.range(1).select(F.lit(text).alias("q")).select(
        q.tokens(F.col("q")).alias("tokens"), q.terms(F.col("q")).alias("terms"), q.phrases(F.col("q")).alias("phrases"), q.intent(F.col("q")).alias("intent"), *[q.filter_value(F.col("q"), f).alias(f) for f in q.FILTERS]
    ).first()
    out = row.asDict()
    filters = {f: v for f in q.FILTERS if (v := out.pop(f)) is not None}
    return {"original": text, **out, "filters": filters, "is_valid": bool(out["terms"])}


def results(index: Index, terms: list[str], mode: str = "hybrid", limit: int | None = None, offset: int = 0, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, url, title, snippet, final, bm25, pagerank): one page, rounded as it is shown."""
    page = ranking.ranked(index, terms, mode, limit, offset, config)
    named = ranking.details(page, index)
    shown = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("url", F.lit("")))
    return named.select("doc_id", "url", "title", ranking.snippet(shown, terms, config).alias("snippet"), F.round("final", 6).alias("final"), F.round("bm25", 4).alias("bm25"), F.round("pagerank", 8).alias("pagerank")).orderBy(F.desc("final"), F.desc("bm25"), "doc_id")


def search(index: Index | None, text: str, limit: int | None = None, offset: int = 0, mode: str = "hybrid", config: Config = DEFAULT) -> dict:
    """The answer to one query, as the HTTP interface gives it. Always of one shape, without an index too."""
    began = time.time()
    answer = {"query": text, "corrected": None, "corrections": [], "total": 0, "page": offset // ranking.clamp(limit, config) + 1, "results": [], "error": None}
    if index is None:
        return answer | {"error": "index not loaded", "time_ms": 0.0}
    if not text or not text.strip():
        return answer | {"time_ms": 0.0}
    spark = index.docs.sparkSession
    asked = spark.createDataFrame([(0, text)], "query_id int, query string")
    spelt = spell.correct_queries(asked, spell.dictionary(index.df)).first()
    if spelt["corrections"]:
        answer |= {"corrected": spelt["corrected"], "corrections": [(c["original"], c["corrected"]) for c in spelt["corrections"]]}
    parsed = parse(spark, spelt["corrected"])
    if parsed["is_valid"]:
        rows = results(index, parsed["terms"], mode, limit, offset, config).collect()
        answer |= {"results": [r.asDict() for r in rows], "total": ranking.match_count(index, parsed["terms"]).first()[0]}
    return answer | {"time_ms": round(1000 * (time.time() - began), 1)}


def results_of_many(index: Index, queries: DataFrame, limit: int = 20, config: Config = DEFAULT) -> DataFrame:
    """(query_id, doc_id, bm25, final, rank) for a table (query_id, terms) of queries, hybrid, in one plan.

    Queries meet postings in a join on the term; maxima and ranks are per query."""
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    if index.impacts is not None and config == DEFAULT:
        scored = asked.join(index.impacts, "term").groupBy("query_id", "doc_id").agg(ranking.summed(F.col("part")).alias("bm25"), F.first("pagerank").alias("pagerank"))
        return _best_of_each(scored, limit, config)
    figures = ranking.corpus(index.docs)
    known = index.df.crossJoin(F.broadcast(figures)).select("term", ranking.idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl")
    matched = asked.join(known, "term").join(index.postings.select("term", "doc_id", "freq"), "term").join(index.docs.select("doc_id", "length", "pagerank"), "doc_id")
    part = F.col("idf") * ranking.saturation(F.col("freq"), F.col("length"), F.col("avgdl"), config)
    scored = matched.groupBy("query_id", "doc_id").agg(ranking.summed(part).alias("bm25"), F.first("pagerank").alias("pagerank"))
    return _best_of_each(scored, limit, config)


def _best_of_each(scored: DataFrame, limit: int, config: Config) -> DataFrame:
    """The best of (query_id, doc_id, bm25, pagerank) by their hybrid score, for each query."""
    tops = scored.groupBy("query_id").agg(F.max("bm25").alias("_b"), F.max("pagerank").alias("_p"))
    over = lambda x, top: F.col(x) / F.when(F.col(top) > 0, F.col(top)).otherwise(F.lit(1.0))
    final = config.relevance_weight * over("bm25", "_b") + config.authority_weight * over("pagerank", "_p")
    # Rows beyond a query's limit are left out before and after the shuffle of the window.
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("final"), F.desc("bm25"), "doc_id"))
    return scored.join(tops, "query_id").withColumn("final", final).withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "doc_id", "bm25", "final", "rank")
