"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lean, table
from .graph import connected_components
from .minhash import _bounds, _grouped, _stars
from .vectors import finite, matrix

#: The chance, at most, that a pair at the threshold shares no bucket; vectors of a bucket, about; rows of a block.
MISS, BUCKET, BLOCK = 3e-5, 512, 1024
#: Signs that are compared before vectors are fetched; the chance, at most, that this leaves a pair at the threshold out of a bucket.
SIGNS, PRUNED = 128, 1e-6
#: Large buckets whose sizes are broadcast, at most; more are joined.
LARGE = 100_000


def tables_for(vectors: int, threshold: float, miss: float = MISS, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits, tables): bits so that buckets hold about ``bucket`` of evenly spread vectors, tables for the recall."""
    bits = min(30, max(6, round(math.log2(max(vectors, 1) / bucket + 1))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def signs_apart(threshold: float, miss: float = PRUNED) -> int:
    """How many of SIGNS signs a pair at the threshold has apart, but for a chance of ``miss``."""
    p, chance, k = math.acos(threshold) / math.pi, 0.0, -1
    while chance < 1 - miss:
        k += 1
        chance += math.comb(SIGNS, k) * p**k * (1 - p) ** (SIGNS - k)
    return k


def near_vectors(vectors: DataFrame, threshold: float = 0.95, bits: int | None = None, tables: int | None = None, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding).

    Rows with a cosine of ``threshold`` or more, in double precision, are linked. Equal vectors are one class with
    a count; classes that share the signs of ``bits`` random projections in one of ``tables`` tables meet in a bucket, first with
    SIGNS further signs alone. Those with another one nearby are then fetched whole and compared exactly.
    A pair is counted in the first table that both share, so counts need no pairs outside the task; what
    leaves a task is a count per class and a spanning star of links. Large buckets are cut into blocks that meet in pairs.

    Null vectors, zero vectors and vectors with null or non-finite components link with nothing. Vectors of unequal
    lengths are compared as if the shorter ended in zeros. A null vec_id is no id: it names no component
    that has another. Repeated rows are vectors of their own, so they link. Empty tables give empty tables."""
    sound = F.coalesce(finite("embedding") & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: x + F.lit(0).cast(vectors.schema["embedding"].dataType.elementType)).alias("embedding"))
    some = rows.where(sound)
    digests = [F.xxhash64(F.lit(k), "embedding").alias(f"h{k}") for k in (0, 1)]
    classes = some.groupBy(*digests).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = checkpointed(classes.withColumn("c", F.monotonically_increasing_id()))
    if bits is None or tables is None:
        bits, tables = tables_for(classes.count(), threshold)
    apart = signs_apart(threshold)

    def projected(column: pa.Array, number: int, what: int) -> np.ndarray:
        """Whether projections are positive, for random planes that depend on ``what`` and the dimension alone."""
        m = matrix(column)
        unit = m / np.abs(m).max(1, keepdims=True)
        planes = np.stack([np.random.default_rng([seed, what, d]).standard_normal(number) for d in range(m.shape[1])])
        return unit @ planes > 0

    def codes_of(column: pa.Array) -> np.ndarray:
        return (projected(column, bits * tables, 0).reshape(len(column), tables, bits) * (1 << np.arange(bits))).sum(2).astype(np.int64)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                key = codes_of(part.column(1)) + (np.arange(tables, dtype=np.int64) << 32)
                wide = np.packbits(projected(part.column(1), SIGNS, 1), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), tables)), *[pa.array(np.repeat(wide[:, k], tables)) for k in range(SIGNS // 64)]], ["bucket", "c", *[f"s{k}" for k in range(SIGNS // 64)]])

    members = classes.select("c", "embedding").mapInArrow(lean(buckets), "bucket bigint, c bigint, " + ", ".join(f"s{k} bigint" for k in range(SIGNS // 64)))
    large = checkpointed(members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k")).where("k > 1"))
    large = F.broadcast(large) if large.count() <= LARGE else large
    # A row's block and the one that it meets, in one number: i, j and whether the row is of block i.
    own = F.pmod(F.xxhash64("c"), F.coalesce("k", F.lit(1))).cast("int")
    met = members.join(large, "bucket", "left").withColumn("b", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)))
    pair = (F.least("b", "o").cast("bigint") * (1 << 31) + F.greatest("b", "o")).alias("pair")
    signed = met.select("bucket", pair, (F.col("b") <= F.col("o")).alias("own"), "c", *[f"s{k}" for k in range(SIGNS // 64)])

    def nearby(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members that have another one nearby, by their signs."""
        for t in _grouped(batches, 2):
            at, has = _bounds(t, 2), np.zeros(len(t), bool)
            pair, own = t.column(1).to_numpy(), t.column(2).to_numpy()
            signs = np.stack([t.column(4 + k).to_numpy() for k in range(SIGNS // 64)], 1).view(np.uint64)
            for a, z in zip(at[:-1], at[1:]):
                if z - a < 2:
                    continue
                s = signs[a:z]
                near = sum(np.bitwise_count(s[:, None, k] ^ s[None, :, k]) for k in range(s.shape[1])) <= apart
                np.fill_diagonal(near, False)
                if pair[a] % (1 << 31) != pair[a] >> 31:
                    near &= own[a:z, None] != own[None, a:z]
                has[a:z] = near.any(1)
            kept = pa.array(np.flatnonzero(has))
            yield pa.RecordBatch.from_arrays([t.column(k).combine_chunks().take(kept) for k in range(4)], ["bucket", "pair", "own", "c"])

    ordered = signed.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")
    due = ordered.mapInArrow(lean(nearby), "bucket bigint, pair bigint, own boolean, c bigint").join(classes.select("c", "n", "embedding"), "c")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 2):
            at, edges = _bounds(t, 2), []
            bucket, pair, own, c, n = (t.column(k).to_numpy() for k in range(5))
            links = np.zeros(len(t), np.int64)
            for a, z in zip(at[:-1], at[1:]):
                if z - a < 2:
                    continue
                part = t.column(5).slice(a, z - a).combine_chunks()
                m = matrix(part)
                m /= np.abs(m).max(1, keepdims=True)
                m /= np.sqrt((m * m).sum(1, keepdims=True))
                linked = m @ m.T >= threshold
                np.fill_diagonal(linked, False)
                if pair[a] % (1 << 31) != pair[a] >> 31:
                    linked &= own[a:z, None] != own[None, a:z]
                x, y = np.nonzero(linked)
                if not len(x):
                    continue
                before = codes_of(part)[:, : int(bucket[a] >> 32)]
                new = np.concatenate([~(before[x[p : p + 65536]] == before[y[p : p + 65536]]).any(1) for p in range(0, len(x), 65536)])
                links[a:z] += np.bincount(x[new], n[a:z][y[new]], z - a).astype(np.int64)
                seen = np.zeros(linked.shape, bool)
                seen[x[new], y[new]] = True
                edges += [(c[a + p], c[a + q]) for p, q in _stars(seen | seen.T)]
            some = np.flatnonzero(links)
            a, b = ([e[k] for e in edges] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c[some], np.array(a, np.int64)])), pa.array([None] * len(some) + b, pa.int64()), pa.array([*links[some], *[None] * len(b)], pa.int64())], ["a", "b", "links"])

    whole = due.select("bucket", "pair", "own", "c", "n", "embedding").repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")
    compared = checkpointed(whole.mapInArrow(lean(compare), "a bigint, b bigint, links bigint"))
    counts = compared.where("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    groups = connected_components(compared.where("b is not null").select("a", "b")).join(classes.select("c", "rep"), F.col("node") == F.col("c"))
    smallest = groups.groupBy("component").agg(F.min("rep").alias("first"))
    of_group = groups.join(smallest, "component").select("c", "first")
    of_class = classes.select("c", "h0", "h1", "rep", "n").join(counts, "c", "left").join(of_group, "c", "left")
    of_class = of_class.select("h0", "h1", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("first", "rep").alias("component_id"))
    linked = some.select("vec_id", *digests).join(of_class, ["h0", "h1"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embdedup(spark, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors at a cosine of 0.95 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.95
), r AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT d.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, d.vec_id = c.component_id AS kept
FROM embeddings d JOIN c ON c.vec_id = d.vec_id LEFT JOIN n ON n.vec_id = d.vec_id
"""
