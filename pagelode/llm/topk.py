"""Exact top-k by integer inner product: a three-phase uniform threshold over slices of the dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, lean, table
from .vectors import finite, matrix

#: Rows of a block of vectors and of a block of queries, and queries that are scored at a time; slices of the dimensions.
ROWS, QUERIES, AT_ONCE, SLICES = 4096, 8192, 512, 2
#: One block in so many, at most, gives the local lists of phase 1: any vectors' k-th score is a safe cutoff.
LISTED = 8
#: A score beyond the long range is the end of it.
_LEAST, _MOST = -(2**63), 2**63 - 1


def _pack(m: np.ndarray) -> tuple[bytes, int, bool]:
    small = bool(np.abs(m).max(initial=0) <= 32767)
    return m.astype(np.int16 if small else np.float64).tobytes(), m.shape[1], small


def _unpack(data: bytes, width: int, small: bool, n: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if small else np.float64).reshape(n, width).astype(np.float64)


def _scores(q: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
    """Per slice (every SLICES-th dimension), the inner products, exactly: as int64, or as Python's integers where 2^53 might be passed."""
    width = min(q.shape[1], d.shape[1])  # the rest of the longer is multiplied by zeros
    q, d = q[:, :width], d[:, :width]
    small = width * np.abs(q).max(initial=0) * np.abs(d).max(initial=0) < 2**53
    out = []
    for j in range(SLICES):
        a, b = q[:, j::SLICES], d[:, j::SLICES]
        if small:
            out.append((a @ b.T).astype(np.int64))
        else:
            whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
            out.append(whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)), object))
    return out


def _longs(scores) -> np.ndarray:
    return np.array([min(max(int(x), _LEAST), _MOST) for x in scores], np.int64) if scores.dtype == object else scores


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(ids, data, width, small): vectors of a task packed in blocks of at most ``rows``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                data, width, small = _pack(np.floor(64 * matrix(part.column(1))))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([data], pa.binary()), pa.array([width], pa.int32()), pa.array([small])], ["ids", "data", "width", "small"])

    return vectors.mapInArrow(lean(pack), "ids binary, data binary, width int, small boolean")


def _query_blocks(queries: DataFrame, n: int) -> DataFrame:
    """(q, qids, qdata, qwidth, qsmall, cutoffs): queries of a hash's block, packed."""
    queries = queries.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).repartition("q").sortWithinPartitions("q", "vec_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column(3).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]]) if len(number) else np.zeros(1, int)
            for a, z in zip(edges[:-1], edges[1:]):
                data, width, small = _pack(np.floor(64 * matrix(b.column(1).slice(a, z - a))))
                columns = [[int(number[a])], [b.column(0).slice(a, z - a).to_numpy().tobytes()], [data], [width], [small], [b.column(2).slice(a, z - a).to_numpy().tobytes()]]
                types = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["q", "qids", "qdata", "qwidth", "qsmall", "cutoffs"])

    return queries.mapInArrow(lean(pack), "q int, qids binary, qdata binary, qwidth int, qsmall boolean, cutoffs binary")


def _each(pairs: DataFrame, work, names: list[str], ddl: str) -> DataFrame:
    """work on each pair of blocks, some queries at a time: (query ids, vector ids, slice scores, own, cutoffs) to columns of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, qids, cut = (np.frombuffer(r[c], np.int64) for c in ("ids", "qids", "cutoffs"))
                vectors, queries = _unpack(r["data"], r["width"], r["small"], len(ids)), _unpack(r["qdata"], r["qwidth"], r["qsmall"], len(qids))
                for at in range(0, len(qids), AT_ONCE):
                    part = slice(at, at + AT_ONCE)
                    columns = work(qids[part], ids, _scores(queries[part], vectors), qids[part, None] == ids[None, :], cut[part])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return pairs.mapInArrow(lean(run), ddl)


def _largest(values: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest, in no order."""
    if len(values) <= k:
        return np.arange(len(values))
    return np.argsort(values, kind="stable")[len(values) - k :] if values.dtype == object else np.argpartition(values, len(values) - k)[len(values) - k :]


def _local_lists(k: int):
    """Phase 1: per query, the exact totals of what leads a slice's local list, at most k of them."""

    def work(qids, ids, slices, own, cut):
        out: tuple[list, list] = ([], [])
        for x in range(len(qids)):
            others = np.flatnonzero(~own[x])
            leads = np.unique(np.concatenate([others[_largest(s[x, others], k)] for s in slices]))
            total = sum(s[x, leads] for s in slices)
            total = _longs(total[_largest(total, k)])
            out[0].append(np.full(len(total), qids[x]))
            out[1].append(total)
        return [np.concatenate(o) for o in out]

    return work


def _sufficient(k: int):
    """Phases 2 and 3: the entries that reach the uniform threshold in some slice; of those alone, exact totals, from the cutoff up.

    A block's least score of a slice is what a vector has there at least. So a total at the cutoff is over the sum of these by
    some amount, and one slice has its equal share of that amount, or more: this share is the threshold. What lies under it in
    every slice is not looked at again."""

    def work(qids, ids, slices, own, cut):
        out: tuple[list, list, list] = ([], [], [])
        low = [s.min(1) for s in slices]
        for x in range(len(qids)):
            enough = ~own[x]
            if cut[x] > _LEAST:
                over = -((sum(int(v[x]) for v in low) - int(cut[x])) // len(slices))
                reached = np.zeros(len(ids), bool)
                for s, v in zip(slices, low):
                    reached |= (s[x] >= int(v[x]) + over).astype(bool)
                enough &= reached
            y = np.flatnonzero(enough)
            total = sum(s[x, y] for s in slices)
            if cut[x] > _LEAST:
                resolved = (total >= cut[x]).astype(bool)
                y, total = y[resolved], total[resolved]
            total = _longs(total)
            if len(y) > k:  # a block gives no more than k to the result
                best = np.lexsort((ids[y], ~total))[:k]
                y, total = y[best], total[best]
            out[0].append(np.full(len(y), qids[x]))
            out[1].append(ids[y])
            out[2].append(total)
        return [np.concatenate(o) for o in out]

    return work


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors of largest inner product of floor(64 * x).

    vectors and queries have vec_id and embedding. Candidates are all rows with another vec_id than the query's;
    ties go to the smaller vec_id. Queries are packed in large blocks, and each block of vectors is copied once for each of these.
    Scores are sums over slices of the dimensions. Phase 1
    gathers, from one block in LISTED, chosen by a hash, the totals of what leads a slice's local list; the k-th of these is a cutoff
    that no result lies under, as more vectors can only raise it. It is joined to its query. Phase 2 collects in every block the entries that reach a uniform threshold
    in some slice, phase 3 resolves the totals of these alone. No block gives more than k entries per query, whatever the ties.

    Null ids, null vectors and vectors with null or non-finite components take no part. Vectors of unequal
    lengths are compared as if the shorter ended in zeros. Repeated candidate rows each count; a repeated query
    row is one query (its largest vector in array order). Scores are exact; one beyond the long range is shown, and ranked, as the end of
    that range. Empty tables give empty tables."""
    valid = finite("embedding") & F.col("vec_id").isNotNull()
    data = vectors.where(valid).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    asked = queries.where(valid).groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.max("embedding").alias("embedding"))
    asked = checkpointed(asked)
    n = max(1, -(-asked.count() // QUERIES))
    blocks = checkpointed(_blocks(data, ROWS).withColumn("b", F.monotonically_increasing_id()))
    spread = max(1, blocks.count())

    def pairs(with_cutoffs: DataFrame, some: DataFrame) -> DataFrame:
        wide = some.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(spread)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        met = _query_blocks(with_cutoffs, n).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        return wide.join(met, ["q", "s"]).drop("q", "s", "b")

    first = asked.select("vec_id", "embedding", F.lit(_LEAST).alias("cutoff"))
    listed = blocks.join(blocks.select("b").orderBy(F.xxhash64("b")).limit(-(-spread // LISTED)), "b", "left_semi")
    lists = _each(pairs(first, listed), _local_lists(k), ["query_id", "total"], "query_id bigint, total bigint")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("total")))
    kth = lists.withColumn("r", place).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("total").alias("cutoff"))
    second = asked.join(kth, "vec_id", "left").select("vec_id", "embedding", F.coalesce("cutoff", F.lit(_LEAST)).alias("cutoff"))
    found = _each(pairs(second, blocks), _sufficient(k), ["query_id", "vec_id", "score"], "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i])) AS BIGINT) AS score
  FROM v q, v d WHERE q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
