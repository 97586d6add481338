"""URL functions as columns. They follow RFC 3986 splitting, not java.net.URL, so odd URLs neither fail nor vanish."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.config import Scope

_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
_IPV4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Host with port, lower-cased; empty if there is none."""
    return F.lower(_part(url, 2))


def domain(url: Column) -> Column:
    """Host up to its first colon, lower-cased."""
    return F.split_part(host(url), F.lit(":"), F.lit(1))


def path(url: Column) -> Column:
    return _part(url, 3)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body has it: it is bound as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(url: Column) -> Column:
    """Without fragment, empty query and default port; scheme and host lower-cased; runs of slashes in the path are one."""

    def whole(bare: Column) -> Column:
        where = lambda kind: let(host(bare), lambda w: F.when(kind == "http", F.regexp_replace(w, ":80$", "")).when(kind == "https", F.regexp_replace(w, ":443$", "")).otherwise(w))
        query = F.regexp_replace(_part(bare, 4), r"^\?$", "")
        return let(scheme(bare), lambda kind: F.concat(kind, F.lit("://"), where(kind), F.regexp_replace(path(bare), "/+", "/"), query))

    def relative(bare: Column) -> Column:
        return F.concat(F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^?]*", 0), "/+", "/"), F.regexp_replace(F.regexp_extract(bare, r"(?s)\?.*$", 0), r"^\?$", ""))

    return let(F.regexp_replace(url, "(?s)#.*$", ""), lambda bare: F.when(bare.rlike(_PARTS), whole(bare)).otherwise(relative(bare)))


def doc_id(url: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of the normalized URL."""
    return F.substring(F.sha2(normalize(url), 256), 1, 32)


def doc_id_of_normalized(url: Column) -> Column:
    """doc_id of a url that is normalized already: a far smaller expression."""
    return F.substring(F.sha2(url, 256), 1, 32)


def is_valid(url: Column) -> Column:
    """http or https, with a host."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def same_domain(a: Column, b: Column) -> Column:
    return domain(a) == domain(b)


def depth(url: Column, base: Column) -> Column:
    """Slashes of the path without trailing ones; 0 at the root, -1 on another host."""
    bare = F.regexp_replace(path(url), "/+$", "")
    return F.when(_part(url, 2) != _part(base, 2), F.lit(-1)).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit("/")))).cast("int")


def ipv4_number(text: Column) -> Column:
    """A strict dotted quad as a number, else null."""
    octets = F.transform(F.split(text, r"\."), lambda x: x.try_cast("bigint"))
    return F.when(text.rlike(_IPV4), F.aggregate(octets, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x))


def in_scope(url: Column, scope: Scope) -> Column:
    """Host ends with an allowed suffix, or is one without its dot, or is an IPv4 address of a range."""

    def test(name: Column) -> Column:
        tests = [name.endswith(s) | (name == s.lstrip(".")) for s in scope.suffixes]
        out = F.lit(False)
        for t in tests:
            out = out | t
        for text in scope.ipv4_ranges:
            net = ipaddress.ip_network(text, strict=False)
            out = out | let(ipv4_number(name), lambda n: F.coalesce(n.between(int(net.network_address), int(net.broadcast_address)), F.lit(False)))  # noqa: B023
        return (name != "") & out

    return let(domain(url), test)


def resolve(base: Column, href: Column) -> Column:
    """href against base where no dot segments need folding; null where they do (see resolve_any)."""
    root = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    folder = F.concat(root, F.when(path(base) == "", F.lit("/")).otherwise(F.regexp_extract(path(base), r"(?s)^(.*/)", 1)))
    dots = href.rlike(r"(^|/)\.\.?(/|$|\?|#)")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(dots, F.lit(None).cast("string"))
        .when(href.startswith("//"), F.concat(_part(base, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, path(base), href))
        .otherwise(F.concat(folder, href))
    )


def resolve_dots(base: Column, href: Column) -> Column:
    """A relative href without a host against base, dot segments folded and empty segments dropped, as urljoin does it."""
    own, rest = F.regexp_extract(href, r"(?s)^[^?#]*", 0), F.regexp_extract(href, r"(?s)[?#].*$", 0)
    folder = F.when(path(base) == "", F.lit("/")).otherwise(F.regexp_extract(path(base), r"(?s)^(.*/)", 1))
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    fold = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))
    segments = F.aggregate(F.filter(F.split(joined, "/"), lambda s: s != ""), F.array().cast("array<string>"), fold)
    ended = F.when(joined.rlike(r"(^|/)\.{0,2}$"), F.lit("/")).otherwise(F.lit(""))
    folded = F.regexp_replace(F.concat(F.lit("/"), F.array_join(segments, "/"), ended), "^//$", "/")
    return F.concat(_part(base, 1), F.lit("://"), _part(base, 2), F.when(own == "", path(base)).otherwise(folded), rest)


@F.pandas_udf(T.StringType())
def resolve_any(base: pd.Series, href: pd.Series) -> pd.Series:
    """RFC 3986 joining in full, for the few links that resolve() leaves."""

    def join(b, h):
        try:
            return urljoin(b, h) if b is not None and h is not None else None
        except ValueError:
            return None

    return pd.Series([join(b, h) for b, h in zip(base, href)], dtype=object)
