"""The crawl frontier as a table: what is due, in which order, how many per host, and what follows a visit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.config import DEFAULT, Config
from pagelode.functions import urls


def enqueue(queue: DataFrame, found: DataFrame, now: Column, priority: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """queue and the urls of found (url, depth) that are valid, in scope and new, as pending rows."""
    new = (
        found.select(urls.normalize(F.col("url")).alias("url"), "depth")
        .where(urls.is_valid(F.col("url")) & urls.in_scope(F.col("url"), config.scope))
        .groupBy("url")
        .agg(F.min("depth").alias("depth"))
        .join(queue.select("url"), "url", "left_anti")
    )
    return queue.unionByName(
        new.select("url", urls.doc_id(F.col("url")).alias("doc_id"), urls.domain(F.col("url")).alias("domain"), F.col("depth").cast("int").alias("depth"), F.lit(config.link_priority if priority is None else priority).alias("priority"), F.lit("pending").alias("status"), F.lit(0).alias("retries"), F.lit(None).cast("timestamp").alias("last_attempt_at"), now.alias("created_at"), now.alias("next_attempt_at"))
    )


def due(queue: DataFrame, now: Column, domain: str | None = None) -> DataFrame:
    out = queue.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= now))
    return out if domain is None else out.where(F.col("domain") == domain)


def next_urls(queue: DataFrame, now: Column, n: int = 1, domain: str | None = None) -> DataFrame:
    """The n next due urls: by priority, depth, age, url."""
    return due(queue, now, domain).orderBy("priority", "depth", "created_at", "url").limit(n)


def round_of(queue: DataFrame, now: Column, config: Config = DEFAULT) -> DataFrame:
    """One round of visits: due urls, as many per host as may be visited at once.

    What a host has being visited counts against it, and its last visit must be the delay ago."""
    hosts = queue.groupBy("domain").agg(F.count(F.when(F.col("status") == "crawling", 1)).alias("_active"), F.max("last_attempt_at").alias("_last"))
    rested = hosts.where((F.col("_active") < config.host_concurrency) & (F.col("_last").isNull() | (F.unix_micros(now) - F.unix_micros("_last") >= int(config.host_delay_seconds * 1e6)))).select("domain", "_active")
    place = F.row_number().over(W.partitionBy("domain").orderBy("priority", "depth", "created_at", "url"))
    return due(queue, now).withColumn("place", place).where(F.col("place") <= config.host_concurrency).join(rested, "domain").where(F.col("place") + F.col("_active") <= config.host_concurrency).drop("_active")


def started(queue: DataFrame, chosen: DataFrame, now: Column) -> DataFrame:
    """queue with the chosen urls marked as being visited."""
    marked = queue.join(chosen.select("url", F.lit(True).alias("_c")), "url", "left")
    return marked.withColumns({"status": F.when(F.col("_c"), "crawling").otherwise(F.col("status")), "last_attempt_at": F.when(F.col("_c"), now).otherwise(F.col("last_attempt_at"))}).drop("_c")


def finished(queue: DataFrame, outcomes: DataFrame, now: Column, config: Config = DEFAULT) -> DataFrame:
    """queue after outcomes (url, ok, retry): completed, or pending again after a delay that grows linearly, or failed."""
    joined = queue.join(outcomes.select("url", "ok", "retry"), "url", "left")
    again = ~F.col("ok") & F.col("retry")
    status = F.when(F.col("ok"), "completed").when(again, "pending").when(~F.col("ok"), "failed").otherwise(F.col("status"))
    return joined.withColumns({"status": status, "next_attempt_at": F.when(again, retry_at(now, F.col("retries"), config)).otherwise(F.col("next_attempt_at")), "retries": F.when(~F.col("ok"), F.col("retries") + 1).otherwise(F.col("retries"))}).drop("ok", "retry")


def retry_at(now: Column, retries: Column, config: Config = DEFAULT) -> Column:
    return F.timestamp_micros(F.unix_micros(now) + (retries + 1).cast("bigint") * F.lit(config.retry_step_seconds * 1_000_000).cast("bigint"))


def status_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count("*").alias("n"))


def is_empty(queue: DataFrame) -> bool:
    return queue.where("status = 'pending'").limit(1).isEmpty()
