"""PageRank by power iteration over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.config import DEFAULT, Config
from pagelode.session import checkpointed


#: Links of one source in one row, at most; a source with more has several rows.
BLOCK = 8192


def _by_source(edges: DataFrame, parts: int) -> DataFrame:
    """(src, out, targets) of (src, dst): links out, as often as they stand, in rows of BLOCK at most; dealt and sorted by src.

    A window over sorted rows numbers them, so a source of any size spills and never is one row."""
    numbered = edges.repartition(parts, "src").withColumns({"_n": F.row_number().over(W.partitionBy("src").orderBy("dst")), "out": F.count("*").over(W.partitionBy("src"))})
    rows = numbered.groupBy("src", "out", F.floor((F.col("_n") - 1) / BLOCK).alias("_block")).agg(F.collect_list("dst").alias("targets"))
    return checkpointed(rows.select("src", "out", "targets").sortWithinPartitions("src"))


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, config: Config = DEFAULT, iterations: int | None = None) -> DataFrame:
    """(doc_id, rank) over edges (src, dst) and nodes (doc_id); ranks sum to 1.

    Repeated edges count as often as they stand; self-links count; ends that are no node yet are nodes. Rows with a null
    end are ignored. Stops when no rank changes by the tolerance, or after ``iterations`` exactly if given.
    Edges are read once, into rows by source that are dealt and sorted once. The mass of nodes without links out is spread evenly: as
    ranks sum to 1, the even share is (1 - d * passed on) / n, and what is passed on is the rank of nodes with links out. With a fixed
    number of steps, nodes without links out are ranked in the last alone, as nothing flows from them."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = _by_source(edges.where("src is not null and dst is not null").select("src", "dst"), parts)
    every = links.select(F.col("src").alias("doc_id"), F.lit(True).alias("passes")).union(links.select(F.explode("targets"), F.lit(False)))
    if nodes is not None:
        every = every.union(nodes.select("doc_id", F.lit(False)).where("doc_id is not null"))
    every = checkpointed(every.groupBy("doc_id").agg(F.max("passes").alias("passes")).repartition(parts, "doc_id").sortWithinPartitions("doc_id"))
    n, active = every.agg(F.count("*"), F.count_if("passes")).first()
    if not n:
        return every.select("doc_id", F.lit(0.0).alias("rank"))
    ranks = every.withColumn("rank", F.lit(1.0 / n))

    def step(links: DataFrame, ranks: DataFrame, kept: DataFrame) -> DataFrame:
        flow = links.join(ranks.select(F.col("doc_id").alias("src"), "rank"), "src").select((F.col("rank") / F.col("out")).alias("share"), F.explode("targets").alias("doc_id"))
        moved = flow.groupBy("doc_id").agg(F.sum("share").alias("got"))
        # What is passed on is one row.
        passed = ranks.where("passes").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("passed"))
        rank = (1 - config.damping * F.col("passed")) / n + config.damping * F.coalesce("got", F.lit(0.0))
        return checkpointed(kept.join(moved, "doc_id", "left").crossJoin(F.broadcast(passed)).select("doc_id", "passes", *[c for c in kept.columns if c == "old"], rank.alias("rank")))

    if iterations is None:
        for _ in range(config.max_iterations):
            ranks = step(links, ranks, ranks.select("doc_id", "passes", F.col("rank").alias("old")))
            if ranks.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] < config.tolerance:
                break
    elif iterations:
        inner, sources = links, every
        if iterations > 1 and 2 * active < n:
            sources = checkpointed(every.where("passes"))
            ranks = sources.withColumn("rank", F.lit(1.0 / n))
            between = links.select("src", "out", F.explode("targets").alias("doc_id")).join(sources.select("doc_id"), "doc_id", "left_semi")
            inner = checkpointed(between.repartition(parts, "src").select("src", "out", F.array("doc_id").alias("targets")).sortWithinPartitions("src"))
        for _ in range(iterations - 1):
            ranks = step(inner, ranks, sources)
        ranks = step(links, ranks, every)
    total = ranks.agg(F.sum("rank")).first()[0]
    return ranks.select("doc_id", (F.col("rank") / total).alias("rank"))


def top(ranks: DataFrame, n: int = 10) -> DataFrame:
    return ranks.orderBy(F.desc("rank"), "doc_id").limit(n)


def titled(ranks: DataFrame, pages: DataFrame, n: int = 10) -> DataFrame:
    """The top ranks with title and url; an unknown page has its doc_id for a title."""
    return F.broadcast(top(ranks, n)).join(pages.select("doc_id", "title", "url"), "doc_id", "left").select("doc_id", "rank", F.coalesce("title", "doc_id").alias("title"), F.coalesce("url", F.lit("")).alias("url"))


def stored(pages: DataFrame, ranks: DataFrame) -> DataFrame:
    """pages with the ranks of their documents; a page without one keeps what it had."""
    joined = pages.join(ranks.select("doc_id", "rank"), "doc_id", "left")
    return joined.withColumn("pagerank", F.coalesce("rank", "pagerank")).drop("rank")


def summary(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.count("*").alias("nodes"), F.max("rank").alias("max_rank"), F.min("rank").alias("min_rank"), F.avg("rank").alias("mean_rank"))
