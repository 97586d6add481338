"""Figures of the link graph and of term use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.functions import text

from .index import apart


def out_degrees(links: DataFrame) -> DataFrame:
    return links.groupBy("from_doc_id").agg(F.count("*").alias("out_degree"))


def in_degrees(links: DataFrame) -> DataFrame:
    return links.where("to_doc_id is not null").groupBy("to_doc_id").agg(F.count("*").alias("in_degree"))


def dangling(links: DataFrame) -> DataFrame:
    """Link targets that have no links out."""
    ends = links.where("to_doc_id is not null").select(F.col("to_doc_id").alias("doc_id")).distinct()
    return ends.join(links.select(F.col("from_doc_id").alias("doc_id")).distinct(), "doc_id", "left_anti")


def link_stats(links: DataFrame) -> DataFrame:
    """One row: links, pages that link, documents linked to. Distinct ends are counted in two steps, as Catalyst plans them."""
    return links.agg(F.count("*").alias("total_links"), F.countDistinct("from_doc_id").alias("linking_pages"), F.countDistinct("to_doc_id").alias("linked_documents"))


def keywords(documents: DataFrame, n: int = 20) -> DataFrame:
    """(doc_id, word, freq, rank): each document's most frequent words of three to twenty letters, ties by word."""
    counted = (
        documents.select("doc_id", F.explode(text.plain_words(F.col("text"))).alias("word"))
        .where(F.col("word").rlike("^[a-z]{3,}$") & ~F.col("word").isin(*text.KEYWORD_STOP_WORDS))
        .groupBy("doc_id", "word")
        .agg(F.count("*").alias("freq"))
    )
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("freq"), "word"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n)


def term_positions(documents: DataFrame) -> DataFrame:
    """(doc_id, term, positions): places of each plain word, from 0.

    Made within each row, without a shuffle; rows that share a doc_id are one document and meet by (doc_id, term)."""
    once, shared = apart(documents)
    ordered = F.sort_array(F.transform(text.plain_words(F.col("text")), lambda t, pos: F.struct(t.alias("term"), pos.alias("pos"))))
    found = text.runs(ordered, lambda a, first, n: F.struct(F.get(a, first - 1)["term"].alias("term"), F.transform(F.slice(a, first, n), lambda x: x["pos"]).alias("positions")))
    out = once.select("doc_id", F.explode(found).alias("p")).select("doc_id", "p.term", "p.positions")
    if shared is None:
        return out
    rows = shared.select("doc_id", F.posexplode(text.plain_words(F.col("text"))).alias("pos", "term"))
    return out.union(rows.groupBy("doc_id", "term").agg(F.array_sort(F.collect_list("pos")).alias("positions")))


def term_counts(tokens: DataFrame, weight: float = 1.0) -> DataFrame:
    """(doc_id, term, weighted) of index tokens."""
    return tokens.groupBy("doc_id", "term").agg((F.count("*") * F.lit(weight)).alias("weighted"))


def engine_stats(index_stats: DataFrame, pages: DataFrame, links: DataFrame, version: int = 1) -> DataFrame:
    """One row of index, page and link figures and the index version."""
    counted = pages.agg(F.count("*").alias("pages"))
    # Each side is one row.
    return index_stats.crossJoin(F.broadcast(counted)).crossJoin(F.broadcast(link_stats(links))).withColumn("version", F.lit(version))


def index_status(spark, total_docs: int, total_terms: int, version: int = 0):
    """The one row of an index's state; a new state has the next version."""
    return spark.range(1).select(F.current_timestamp().alias("last_indexed_at"), F.lit(total_docs).alias("total_docs"), F.lit(total_terms).alias("total_terms"), F.lit(version + 1).alias("version"))


def top_pages(pages: DataFrame, n: int = 10) -> DataFrame:
    return pages.orderBy(F.desc("pagerank"), "doc_id").limit(n)
