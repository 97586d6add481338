"""Near-duplicate documents by HyperMinHash registers, banding, and verification on whole shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lean, maybe_among, sliced, table, texts, unused
from .graph import connected_components
from .hashes import mixed, odd, shingle_sets

#: Registers of a set, and how many make a band. At a similarity of 0.8 a pair shares no band in 5 of 100,000 cases.
BANDS, ROWS = 25, 5
#: Mantissa bits of a register, beside its count of leading zeros.
MANTISSA = 10
#: Standard deviations that an estimate may lie under the threshold before verification is spared.
MARGIN = 5
#: Members of a block: two blocks at most meet in one step.
BLOCK, VERIFY_BLOCK, VERIFY_SHINGLES = 512, 192, 1 << 20


def registers(sets: list[np.ndarray], count: int) -> np.ndarray:
    """Per set, ``count`` registers: of the smallest hash in each bucket, its leading zeros and mantissa.

    Every bucket has its own hash function over the whole set, so short sets leave no bucket empty."""
    factor = (odd(count, 77) >> np.uint64(16)).astype(np.uint32) | np.uint32(1)
    least = np.empty((len(sets), count), np.uint32)
    for row, s in enumerate(sets):
        h = (s >> np.uint64(32)).astype(np.uint32)[:, None]
        low = np.full(count, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(h), 256):
            np.minimum(low, (h[at : at + 256] * factor).min(0), out=low)
        least[row] = low
    part, exponent = np.frexp(np.maximum(least, 1).astype(np.float64))
    zeros = (32 - exponent).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA)) | ((part * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that registers of disjoint sets of n and m members agree.

    A register's cell is an interval of hash values; the chance that the smallest of n uniform values lies
    in [a, b) is (1-a)^n - (1-b)^n. Summed over exponents with the cells' mean density within each."""
    total = np.zeros(np.broadcast(n, m).shape)
    for zeros in range(0, 32):
        a, b = 2.0 ** -(zeros + 1), 2.0**-zeros
        p = np.exp(n * np.log1p(-a)) - (np.exp(n * np.log1p(-b)) if b < 1 else 0)
        q = np.exp(m * np.log1p(-a)) - (np.exp(m * np.log1p(-b)) if b < 1 else 0)
        total += p * q
    return total / (1 << MANTISSA)


def estimated(agree: np.ndarray, count: int, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of registers that agree, without the agreements due to chance."""
    chance = expected_collisions(n, m)
    return (agree / count - chance) / (1 - chance)


def _stars(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges (root, member) that connect what a symmetric boolean matrix connects."""
    todo, out = np.ones(len(adjacent), bool), []
    for root in range(len(adjacent)):
        if not todo[root]:
            continue
        todo[root], front = False, np.array([root])
        while len(front):
            front = np.flatnonzero(adjacent[front].any(0) & todo)
            todo[front] = False
            out += [(root, int(x)) for x in front]
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted batches as tables that hold whole groups of equal first ``keys`` columns."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        last = [held.column(k)[len(held) - 1] for k in range(keys)]
        if all(held.column(k)[0] == last[k] for k in range(keys)):
            continue
        at = len(held) - 1
        same = np.ones(len(held), bool)
        for k in range(keys):
            same &= np.asarray(pa.compute.equal(held.column(k), last[k]).to_numpy())
        at = len(held) - int(same[::-1].argmin())
        yield held.slice(0, at)
        held = held.slice(at)
    if held is not None and len(held):
        yield held


def _bounds(t: pa.Table, keys: int) -> np.ndarray:
    """Where groups begin in a sorted table, and its length."""
    new = np.zeros(len(t) - 1, bool)
    for k in range(keys):
        c = t.column(k).to_numpy()
        new |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(t)]])


def _in_blocks(members: DataFrame, key: str, block: int, payload: DataFrame, on: list[str], weight: int | None = None) -> DataFrame:
    """members (key, c, ...) of groups of two or more with payload, once for each pair of blocks that has their block.

    A group is cut in blocks by a hash, so that no task holds more than two of them, however large the group.
    Columns i, j name the pair, own says whether the row is of block i. Payloads are joined to members of groups alone,
    and copied for pairs of blocks after that."""
    wide = F.ceil(F.count("*") / block)
    if weight:
        wide = F.greatest(wide, F.ceil(F.sum("n") / weight))
    size = members.groupBy(key).agg(F.count("*").alias("_m"), wide.cast("int").alias("_k")).where("_m > 1")
    mine = F.pmod(F.xxhash64("c"), F.col("_k")).cast("int")
    rows = members.join(size, key).join(payload, on).withColumn("_b", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return rows.withColumns({"i": F.least("_b", "_o"), "j": F.greatest("_b", "_o"), "own": F.col("_b") <= F.col("_o")}).drop("_m", "_k", "_b", "_o")


def _linked(rows: DataFrame, key: str, payload: str, links: Callable) -> DataFrame:
    """Edges (a, b) of rows (key, i, j, own, c, n, payload): links(n, payloads) is a matrix of who links with whom."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 3):
            at, out = _bounds(t, 3), []
            i, j, own, c, n = (t.column(k).to_numpy() for k in range(1, 6))
            held = t.column(6)
            for a, b in zip(at[:-1], at[1:]):
                if b - a < 2:
                    continue
                linked = links(n[a:b], held.slice(a, b - a))
                if i[a] != j[a]:  # within a block, its own pair sees to it
                    linked &= own[a:b, None] != own[None, a:b]
                out += [(c[a + x], c[a + y]) for x, y in _stars(linked)]
            if out:
                pairs = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    ordered = rows.select(key, "i", "j", "own", "c", "n", payload).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")
    return ordered.mapInArrow(lean(step), "a bigint, b bigint")


def _likely(threshold: float, count: int) -> Callable:
    least = threshold - MARGIN * (threshold * (1 - threshold) / count) ** 0.5

    def links(n, payload):
        r = np.stack([np.frombuffer(p.as_buffer(), np.uint16) for p in payload])
        agree = np.zeros((len(r), len(r)), np.int16)
        for column in r.T:
            agree += column[:, None] == column[None, :]
        likely = agree >= (least - 0.02) * count
        if likely.sum() > len(r):
            x, y = np.nonzero(likely)
            likely[x, y] = estimated(agree[x, y], count, n[x].astype(float), n[y].astype(float)) >= least
        np.fill_diagonal(likely, False)
        return likely

    return links


def _verified(num: int, den: int, words: int) -> Callable:
    def links(n, payload):
        sets = shingle_sets(payload.to_pylist(), words)
        size = np.array([len(s) for s in sets], np.int64)
        if len(sets) == 2:
            both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
            both[1] = both[0][::-1]
        else:
            owner = np.repeat(np.arange(len(sets)), size)
            order = np.argsort(np.concatenate(sets), kind="stable")
            value, owner = np.concatenate(sets)[order], owner[order]
            starts = np.concatenate([[True], value[1:] != value[:-1]])
            group = np.cumsum(starts) - 1
            shared = np.bincount(group)[group] > 1
            group, owner = group[shared], owner[shared]
            group = np.unique(group, return_inverse=True)[1]
            both = np.zeros((len(sets), len(sets)), np.float32)
            for low in range(0, int(group.max()) + 1 if len(group) else 0, 4096):
                a, b = np.searchsorted(group, [low, low + 4096])
                m = np.zeros((len(sets), 4096), np.float32)
                m[owner[a:b], group[a:b] - low] = 1
                both += m @ m.T
            both = both.astype(np.int64)
        linked = den * both >= num * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(linked, False)
        return linked

    return links


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, key, text_hash, alone) of every row: groups of documents whose shingle sets are alike.

    Two documents link if den * |intersection| >= num * |union| of their sets of ``words``-word shingles. Steps:
    equal sets become one class; classes that share a band of registers and whose estimated similarity is
    near the threshold or above are candidates; connected candidates are compared on their whole sets, and
    links that hold make the components. Large buckets and candidate groups are cut into blocks that meet
    in pairs; only a spanning star of what a pair of blocks links leaves a task, never all pairs. Sets are made anew of
    the texts where they are compared, as texts are smaller; only texts of candidates are shuffled for it.

    key and text_hash are hashes of (doc_id, text) and of the text; alone: the row is the only one with its set and has no links.

    Empty and null texts have no shingles and link with nothing; texts of fewer words are one shingle. A null
    doc_id counts as no id: it never names a component that has another. Rows with one doc_id are each a
    document. Very long texts are hashed whole. Empty tables give empty tables; other columns are ignored."""
    count = bands * rows
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumns({"key": F.xxhash64("doc_id", "text"), "text_hash": F.xxhash64("text")})

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = shingle_sets(texts(b), words)
            have = [bool(len(s)) for s in sets]
            made = iter(registers([s for s in sets if len(s)], count))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([blake2b(s.tobytes(), digest_size=16).digest() if h else None for s, h in zip(sets, have)], pa.binary()),
                    pa.array([next(made).tobytes() if h else None for h in have], pa.binary()),
                    b.column(2),
                    b.column(3),
                ],
                ["doc_id", "n", "cls", "registers", "key", "text_hash"],
            )

    sketched = checkpointed(source.mapInArrow(lean(sketch), "doc_id bigint, n bigint, cls binary, registers binary, key bigint, text_hash bigint"))
    one = F.max(F.struct("key", "text_hash"))
    classes = sketched.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), one.alias("one"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = checkpointed(classes.select("cls", "rep", "rows", "one.key", "one.text_hash", "n", "registers").withColumn("c", F.monotonically_increasing_id()))

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            r = np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(1)]).astype(np.uint64).reshape(-1, bands, rows)
            key = np.zeros(r.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
            for k in range(rows):
                key = mixed(key + r[:, :, k], 200 + k)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), bands))], ["band", "c"])

    banded = classes.select("c", "registers").mapInArrow(lean(band), "band bigint, c bigint")
    candidates = _in_blocks(banded, "band", BLOCK, classes.select("c", "n", "registers"), ["c"])
    blobs = connected_components(_linked(candidates, "band", "registers", _likely(num / den, count)))

    # One row of each candidate class is read for its text; equal rows are one before the shuffle.
    members = checkpointed(blobs.join(classes, F.col("node") == F.col("c")).select("c", F.col("component").alias("blob"), "n", "key", "text_hash"))
    candidate = maybe_among(members.select("key"))
    whole = source.where(candidate("key")).groupBy("key", "text_hash").agg(F.first("text").alias("text"))
    verified = _linked(_in_blocks(members, "blob", VERIFY_BLOCK, whole, ["key", "text_hash"], VERIFY_SHINGLES), "blob", "text", _verified(num, den, words))
    groups = connected_components(verified).join(classes.select("c", "rep", "cls"), F.col("node") == F.col("c"))
    smallest = groups.groupBy("component").agg(F.min("rep").alias("first"))
    grouped = groups.join(smallest, "component").select("cls", "first", F.lit(True).alias("linked"))
    of_class = classes.select("cls", "rep", "rows").join(grouped, "cls", "left")
    of_class = of_class.select("cls", F.coalesce("first", "rep").alias("component_id"), (F.col("linked").isNull() & (F.col("rows") == 1)).alias("alone"))
    out = sketched.select("doc_id", "n", "cls", "key", "text_hash").join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "key", "text_hash", F.coalesce("alone", F.lit(False)).alias("alone"))


def without_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one document of each group of near duplicates: the one with the smallest doc_id. All columns stay.

    Of rows with one doc_id and one text, one stays: the one whose other columns are the first as JSON. Rows that
    are alone stay where they are; only rows with company are shuffled."""
    found = checkpointed(near_duplicates(docs, **parameters).where("not alone").select("key", "text_hash", "kept").distinct())
    company = maybe_among(found.select("key"))
    key, text_hash, row = (unused(docs.columns, n) for n in ("key", "text_hash", "row"))
    rows = docs.withColumns({key: F.xxhash64(F.col("doc_id").cast("bigint"), "text"), text_hash: F.xxhash64("text")})
    own = [F.col(f"`{c}`") for c in docs.columns]
    other = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    first = F.min_by(F.struct(*own), F.to_json(F.struct(*other)) if other else F.lit(""))
    due = rows.where(company(key)).groupBy(key, text_hash).agg(first.alias(row))
    # The test lets a few through that are alone: they are in no group, and stay.
    gone = found.where("not kept").select(F.col("key").alias(key), F.col("text_hash").alias(text_hash))
    stay = due.join(gone, [key, text_hash], "left_anti").select(*[F.col(f"`{row}`.`{c}`").alias(c) for c in docs.columns])
    return rows.where(~company(key)).select(*own).unionByName(stay)


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents: three words, similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85).drop("key", "text_hash", "alone")


OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 3 THEN list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
near AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, near.b FROM r JOIN near ON near.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
