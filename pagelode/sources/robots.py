"""robots.txt rules as a table (domain, rules): a small side input, joined to urls by domain."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.functions import urls


#: Seconds for which fetched rules hold.
FRESH = 24 * 3600


def _parser(rules: str, cache: dict) -> RobotFileParser:
    if rules not in cache:
        if len(cache) >= 4096:
            cache.clear()
        cache[rules] = RobotFileParser()
        cache[rules].parse(rules.splitlines())
    return cache[rules]


def stale(domains: DataFrame, robots: DataFrame, now: Column) -> DataFrame:
    """The domains (domain) whose rules (domain, rules, fetched_at) are missing or were fetched over a day ago."""
    fresh = robots.where(F.unix_micros(now) - F.unix_micros("fetched_at") <= FRESH * 1_000_000)
    return domains.select("domain").distinct().join(fresh.select("domain"), "domain", "left_anti")


def allowed(frame: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """frame's urls that their hosts' rules allow; hosts without rules allow all."""

    @F.pandas_udf(T.BooleanType())
    def may(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cache: dict = {}
        for rules, url in batches:
            yield pd.Series([r is None or _parser(r, cache).can_fetch(agent, u) for r, u in zip(rules, url)], dtype=bool)

    joined = frame.withColumn("_domain", urls.domain(F.col("url"))).join(robots.select(F.col("domain").alias("_domain"), "rules"), "_domain", "left")
    return joined.where(may("rules", "url")).drop("_domain", "rules")


def crawl_delays(robots: DataFrame, agent: str = "*", default: float = 1.0) -> DataFrame:
    """(domain, delay_seconds) by the rules."""

    @F.pandas_udf(T.DoubleType())
    def delay(rules: pd.Series) -> pd.Series:
        return pd.Series([float(_parser(r, {}).crawl_delay(agent) or default) if r else default for r in rules], dtype=float)

    return robots.select("domain", delay("rules").alias("delay_seconds"))
