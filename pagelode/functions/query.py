"""Query strings as columns: phrases, filters, terms, expansion and intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokenize

# Words by which an intent is told, the first kind that has one.
NAVIGATIONAL = ("wiki", "homepage", "official", "site", "官网", "首页")
TRANSACTIONAL = ("download", "buy", "login", "register", "sign up", "下载", "购买", "登录", "注册", "申请")
FILTERS = ("site", "title", "filetype")


def phrases(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1))


def tokens(query: Column) -> Column:
    """Tokens of what stands outside phrases."""
    return tokenize(F.regexp_replace(query, '"[^"]+"', " "))


def terms(query: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(query)))


def filter_value(query: Column, name: str) -> Column:
    """What follows the first name:, or null. Filters are told, not applied."""
    found = F.regexp_extract(query, rf"{name}:(\S+)", 1)
    return F.when(found != "", found)


def is_valid(query: Column) -> Column:
    return F.size(terms(query)) > 0


def expand(terms_: Column) -> Column:
    """Terms of over four letters also without ing, ed, s or tion, the first that they end in."""

    def shorter(t):
        out = F.array().cast("array<string>")
        for suffix in ("tion", "s", "ed", "ing"):
            out = F.when(t.endswith(suffix), F.array(F.substring(t, F.lit(1), F.length(t) - len(suffix)))).otherwise(out)
        return F.when(F.length(t) > 4, out).otherwise(F.array().cast("array<string>"))

    return F.array_sort(F.array_distinct(F.concat(terms_, F.flatten(F.transform(terms_, shorter)))))


def intent(query: Column) -> Column:
    low = F.lower(query)
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    return F.when(has(NAVIGATIONAL), F.lit("navigational")).when(has(TRANSACTIONAL), F.lit("transactional")).otherwise(F.lit("informational"))
