"""BM25, its fusion with authority, pages of results, match counts, explanations and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.config import DEFAULT, Config

from .index import Index, corpus

MODES = ("relevance", "authority", "hybrid")


def idf(n_docs: Column, df: Column) -> Column:
    """Of a term in df of n_docs documents; 0 if it is in none."""
    return F.when(df > 0, F.greatest(F.lit(0.0), F.log((n_docs - df + 0.5) / (df + 0.5) + 1))).otherwise(F.lit(0.0))


def saturation(freq: Column, length: Column, avgdl: Column, config: Config = DEFAULT) -> Column:
    mean = F.when(avgdl > 0, avgdl).otherwise(F.lit(1.0))
    return freq * (config.k1 + 1) / (freq + config.k1 * (1 - config.b + config.b * length / mean))


def summed(part: Column) -> Column:
    """A sum in units of 2^-60, as two sums of whole numbers: the same in any order of rows, so that equal documents tie exactly."""
    unit = float(1 << 30)
    high = F.floor(part * unit)
    return (F.sum(high) + F.sum(F.floor((part * unit - high) * unit)) / unit) / unit


def query_postings(index: Index, terms: list[str]) -> DataFrame:
    """Postings of the terms alone; the literals are pushed to the scan and prune buckets."""
    return index.postings.where(F.col("term").isin(*terms))


def idfs(index: Index, terms: list[str] | None = None) -> DataFrame:
    """(term, df, idf)."""
    df = index.df if terms is None else index.df.where(F.col("term").isin(*terms))
    # The corpus figures are one row.
    return df.crossJoin(F.broadcast(corpus(index.docs))).select("term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"))


def contributions(index: Index, terms: list[str], config: Config = DEFAULT) -> DataFrame:
    """(doc_id, term, freq, df, idf, length, avgdl, part) of every match."""
    figures = corpus(index.docs)
    matched = query_postings(index, terms).select("term", "doc_id", "freq")
    # There are as many rows as query terms; documents join by their key.
    known = idfs(index, terms)
    scored = matched.join(F.broadcast(known), "term").join(index.docs.select("doc_id", "length"), "doc_id").crossJoin(F.broadcast(figures.select("avgdl")))
    return scored.withColumn("part", F.col("idf") * saturation(F.col("freq"), F.col("length"), F.col("avgdl"), config))


def impacts(index: Index, config: Config = DEFAULT) -> DataFrame:
    """(term, doc_id, part, pagerank) of all postings: what each adds to a score, beside its document's authority."""
    figures = corpus(index.docs)
    known = idfs(index).select("term", "idf")
    matched = index.postings.select("term", "doc_id", "freq").join(known, "term").join(index.docs.select("doc_id", "length", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank")), "doc_id").crossJoin(F.broadcast(figures.select("avgdl")))
    return matched.select("term", "doc_id", (F.col("idf") * saturation(F.col("freq"), F.col("length"), F.col("avgdl"), config)).alias("part"), "pagerank")


def bm25(index: Index, terms: list[str], config: Config = DEFAULT) -> DataFrame:
    """(doc_id, bm25) of documents with any term. Stored impacts have the usual parameters."""
    if index.impacts is not None and config == DEFAULT:
        return index.impacts.where(F.col("term").isin(*terms)).groupBy("doc_id").agg(summed(F.col("part")).alias("bm25"))
    return contributions(index, terms, config).groupBy("doc_id").agg(summed(F.col("part")).alias("bm25"))


def bm25_of(index: Index, doc_ids: DataFrame, terms: list[str], config: Config = DEFAULT) -> DataFrame:
    """(doc_id, bm25) of given documents, 0 without a match."""
    return doc_ids.select("doc_id").join(bm25(index, terms, config), "doc_id", "left").fillna({"bm25": 0.0})


def _tops(matched: DataFrame) -> DataFrame:
    """One row of the largest scores. Its plan has the exchanges of matched again, which are reused, so matches are scored once."""
    return matched.agg(F.max("bm25").alias("_b"), F.max("pagerank").alias("_p"))


def fused(index: Index, terms: list[str], mode: str = "hybrid", config: Config = DEFAULT) -> DataFrame:
    """(doc_id, bm25, pagerank, final); modes other than authority and hybrid are relevance.

    Scores are divided by their maxima over the matches, or by 1 if those are 0."""
    if index.impacts is not None and config == DEFAULT:
        matched = index.impacts.where(F.col("term").isin(*terms)).groupBy("doc_id").agg(summed(F.col("part")).alias("bm25"), F.first("pagerank").alias("pagerank"))
    else:
        matched = bm25(index, terms, config).join(index.docs.select("doc_id", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank")), "doc_id", "left").fillna({"pagerank": 0.0})
    scored = matched.crossJoin(F.broadcast(_tops(matched)))
    relevance = F.col("bm25") / F.when(F.col("_b") > 0, F.col("_b")).otherwise(F.lit(1.0))
    authority = F.col("pagerank") / F.when(F.col("_p") > 0, F.col("_p")).otherwise(F.lit(1.0))
    final = {"authority": authority, "hybrid": config.relevance_weight * relevance + config.authority_weight * authority}.get(mode, relevance)
    return scored.select("doc_id", "bm25", "pagerank", final.alias("final"))


def clamp(limit: int | None, config: Config = DEFAULT) -> int:
    return min(limit or config.default_limit, config.max_limit)


def ranked(index: Index, terms: list[str], mode: str = "hybrid", limit: int | None = None, offset: int = 0, config: Config = DEFAULT) -> DataFrame:
    """A page of fused results: by final, then bm25, then doc_id."""
    return fused(index, terms, mode, config).orderBy(F.desc("final"), F.desc("bm25"), "doc_id").offset(offset).limit(clamp(limit, config))


def match_count(index: Index, terms: list[str]) -> DataFrame:
    """One row: how many documents have all the terms."""
    wanted = sorted(set(terms))
    full = query_postings(index, wanted).groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
    return full.agg(F.when(F.lit(len(wanted) > 0), F.count("*")).otherwise(F.lit(0)).alias("total"))


def details(results: DataFrame, index: Index) -> DataFrame:
    """Results with url and title; unknown documents drop out. To be joined after the limit."""
    return F.broadcast(results).join(index.docs.select("doc_id", "url", "title", "length"), "doc_id")


def snippet(text: Column, terms: list[str], config: Config = DEFAULT) -> Column:
    """Up to 200 characters, from a little before the first term that occurs, with the terms marked."""
    position = F.coalesce(*[F.when(F.locate(t.lower(), F.lower(text)) > 0, F.locate(t.lower(), F.lower(text)) - 1) for t in terms], F.lit(0)) if terms else F.lit(0)
    start = F.greatest(F.lit(0), position - config.snippet_lead)
    cut = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), F.substring(text, start + 1, F.lit(config.snippet_length)), F.when(start + config.snippet_length < F.length(text), F.lit("...")).otherwise(F.lit("")))
    out = F.when(F.length(text) > config.snippet_length, cut).otherwise(text)
    for t in terms:
        out = F.regexp_replace(out, "(?iu)" + "".join(c if c.isalnum() else "\\" + c for c in t), f"<em>{t}</em>")
    return out


def explain(index: Index, doc_id: str, terms: list[str], config: Config = DEFAULT) -> DataFrame:
    """(term, tf, df, idf, doc_length, avgdl, contribution, total, pagerank, final): a row for each term.

    Terms that the document lacks have zeros and no df. final has the hybrid weights whatever the mode."""
    spark = index.docs.sparkSession
    asked = spark.createDataFrame([(t, k) for k, t in enumerate(terms)], "term string, ord int")
    one = index.docs.where(F.col("doc_id") == doc_id).select("doc_id", "length", F.col("pagerank").alias("_rank"))
    parts = contributions(index, terms, config).where(F.col("doc_id") == doc_id).select("term", "freq", "df", "idf", "avgdl", "part")
    whole = fused(index, terms, "hybrid", config)
    tops = whole.agg(F.max("bm25").alias("_b"), F.max("pagerank").alias("_p"))
    rows = asked.join(F.broadcast(parts), "term", "left").crossJoin(F.broadcast(one)).crossJoin(F.broadcast(tops))
    every = W.partitionBy("doc_id")
    total = F.coalesce(F.sum("part").over(every), F.lit(0.0))
    ratio = lambda x, top: x / F.when(F.col(top) > 0, F.col(top)).otherwise(F.lit(1.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rows.select(
        "term",
        zero("freq").alias("tf"),
        "df",
        F.round(zero("idf"), 4).alias("idf"),
        F.when(F.col("freq").isNotNull(), F.col("length")).otherwise(F.lit(0)).alias("doc_length"),
        F.round(zero("avgdl"), 1).alias("avgdl"),
        F.round(zero("part"), 4).alias("contribution"),
        F.round(total, 4).alias("total"),
        F.round("_rank", 8).alias("pagerank"),
        F.round(config.relevance_weight * ratio(total, "_b") + config.authority_weight * ratio(F.col("_rank"), "_p"), 6).alias("final"),
    )


def result_details(index: Index, doc_id: str, terms: list[str], config: Config = DEFAULT) -> DataFrame:
    """(doc_id, url, title, length, bm25) of one document for the terms; bm25 is 0 without a match, and no row without the document."""
    one = index.docs.where(F.col("doc_id") == doc_id).select("doc_id", "url", "title", "length")
    return bm25_of(index, one, terms, config).join(one, "doc_id").select("doc_id", "url", "title", "length", "bm25")


def page_numbers(total: Column, limit: Column, offset: Column) -> Column:
    """page_window as a column."""
    pages = F.greatest(F.lit(1), F.ceil(total / limit)).cast("int")
    start = F.greatest(F.lit(1), F.floor(offset / limit).cast("int") - 3)
    last = F.least(pages, start + 9)
    return F.when(start <= last, F.sequence(start, last)).otherwise(F.array().cast("array<int>"))


def clamped(limit: Column, config: Config = DEFAULT) -> Column:
    """clamp as a column: none or 0 is the usual limit."""
    return F.least(F.when(F.coalesce(limit, F.lit(0)) == 0, config.default_limit).otherwise(limit), F.lit(config.max_limit))


def page_window(total: int, limit: int, offset: int) -> list[int]:
    """Page numbers shown under results: ten at most, four before the current one."""
    pages = max(1, -(-total // limit))
    start = max(1, offset // limit + 1 - 4)
    return list(range(start, min(pages, start + 9) + 1))
