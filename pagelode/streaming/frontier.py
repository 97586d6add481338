"""The frontier as a stream: seen urls dropped, visits of a host spaced out, outcomes applied batch by batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelode.config import DEFAULT, Config
from pagelode.functions import urls
from pagelode.operators import frontier
from pagelode.sources import pages as src

SCHEDULE = "domain string, url string, at timestamp"


def unseen(stream: DataFrame, config: Config = DEFAULT, watermark: str | None = None) -> DataFrame:
    """Valid urls in scope of a stream (url, ts), each once: its state holds the urls seen.

    With a watermark, a url is forgotten once it is that late, so that the state stays bounded."""
    clean = stream.withColumn("url", urls.normalize(F.col("url"))).where(urls.is_valid(F.col("url")) & urls.in_scope(F.col("url"), config.scope))
    if watermark:
        return clean.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["url"])
    return clean.dropDuplicates(["url"])


def polite(stream: DataFrame, config: Config = DEFAULT, watermark: str | None = None) -> DataFrame:
    """(domain, url, at): when each url of a stream (url, domain, ts) may be visited.

    A host's state is the time from which it is free again; visits of it are the delay apart, as many at once as
    its concurrency. A host's urls of one batch come as chunks, so memory holds a chunk, and urls are in order within it.
    With a watermark, a host's state is dropped once the watermark has passed the time from which it is free; without one it is
    kept, one number for each host."""
    delay = pd.Timedelta(microseconds=int(config.host_delay_seconds * 1e6) // config.host_concurrency)

    def schedule(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        free = pd.Timestamp(state.get[0], unit="us") if state.exists else pd.Timestamp(0)
        for chunk in chunks:
            out = []
            for url, ts in chunk.sort_values(["ts", "url"])[["url", "ts"]].itertuples(index=False):
                at = max(pd.Timestamp(ts), free)
                out.append((key[0], url, at))
                free = at + delay
            yield pd.DataFrame(out, columns=["domain", "url", "at"])
        state.update((free.value // 1000,))
        if watermark:
            state.setTimeoutTimestamp(max(free.value // 1_000_000, state.getCurrentWatermarkMs() + 1))

    late = stream.withWatermark("ts", watermark) if watermark else stream
    return late.groupBy("domain").applyInPandasWithState(schedule, SCHEDULE, "free bigint", "append", GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout)


def apply_outcomes(stream: DataFrame, queue_path: str, now: Callable, config: Config = DEFAULT):
    """A query that merges a stream of outcomes (url, ok, retry) into the queue table, version by version.

    Each batch writes a version named by its number, from the one before; a batch that is run again writes the same
    version again, so a restart neither loses nor repeats an outcome."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        queue = spark.read.parquet(f"{queue_path}/version={number}")
        last = batch.groupBy("url").agg(F.max_by("ok", "ts").alias("ok"), F.max_by("retry", "ts").alias("retry"))
        frontier.finished(queue, last, now(), config).write.mode("overwrite").parquet(f"{queue_path}/version={number + 1}")

    return stream.writeStream.foreachBatch(merge)


def counters(chosen: DataFrame, responses: DataFrame) -> DataFrame:
    """One row (visited, pages, failures, bytes) of visits and what acceptable responses came of them."""
    tried = chosen.agg(F.count("*").alias("visited"))
    got = responses.agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.octet_length("html").cast("bigint")), F.lit(0)).alias("bytes"))
    # Both sides are one row.
    return tried.crossJoin(F.broadcast(got)).select("visited", "pages", (F.col("visited") - F.col("pages")).alias("failures"), "bytes")


def crawl(queue: DataFrame, fetched: Callable[[DataFrame], DataFrame], now, rounds: int, config: Config = DEFAULT, robots: DataFrame | None = None, max_pages: int | None = None, max_seconds: float | None = None, told: Callable[[dict], None] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(queue, responses) after breadth-first rounds: choose politely, ask robots, fetch, record, enqueue links of new pages.

    fetched turns chosen (url, depth, ...) rows into responses (url, depth, status_code, content_type, html); it is where
    the network is. With robots (domain, rules), urls that rules forbid are failed and not fetched. Rounds end early when nothing is due,
    after ``max_pages`` pages, or ``max_seconds`` after the start; told gets the counters so far, and the rate, after each round."""
    from pagelode.session import checkpointed
    from pagelode.sources.robots import allowed

    seen, total, began = None, {"visited": 0, "pages": 0, "failures": 0, "bytes": 0}, time.monotonic()
    for number in range(rounds):
        if max_pages is not None and total["pages"] >= max_pages or max_seconds is not None and time.monotonic() - began >= max_seconds:
            break
        chosen = frontier.round_of(queue, now(number), config)
        if max_pages is not None:
            chosen = chosen.orderBy("priority", "depth", "created_at", "url").limit(max_pages - total["pages"])
        chosen = checkpointed(chosen)
        if chosen.isEmpty():
            break
        due = chosen if robots is None else allowed(chosen, robots)
        responses = checkpointed(src.acceptable(fetched(due), config))
        got = responses.select("url", F.lit(True).alias("got"))
        may = due.select("url", F.lit(True).alias("may"))
        outcomes = chosen.select("url").join(got, "url", "left").join(may, "url", "left").select("url", F.coalesce("got", F.lit(False)).alias("ok"), F.coalesce("may", F.lit(False)).alias("retry"))
        queue = frontier.finished(frontier.started(queue, chosen, now(number)), outcomes, now(number), config)
        parents = responses.where(F.col("depth") < config.max_depth).withColumn("page_id", F.lit(0)).select("page_id", "url", "html", "depth")
        found = src.links(parents, config).join(parents.select(urls.doc_id(F.col("url")).alias("from_doc_id"), "depth"), "from_doc_id").select(F.col("to_url").alias("url"), (F.col("depth") + 1).alias("depth"))
        queue = checkpointed(frontier.enqueue(queue, found, now(number), config=config))
        seen = responses if seen is None else seen.unionByName(responses)
        total = {k: v + total[k] for k, v in counters(chosen, responses).first().asDict().items()}
        if told:
            told(total | {"rounds": number + 1, "pages_per_second": total["pages"] / max(time.monotonic() - began, 1e-9)})
    return queue, seen
