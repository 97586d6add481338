"""What the operators of this subpackage share.

Python code of the package is pickled by value, so executors need not have the
package on their path.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

#: Bytes of text that a Python step works on at a time.
SLICE_BYTES = 1 << 20
#: Bits of a bitmap of keys that goes to all tasks, however many keys there are; bits of one of its parts.
BITMAP, PART = 1 << 26, 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share (``spark.checkpoint.dir``).

    Only a local-mode session without one gets a temporary folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if configured := sc.getConf().get("spark.checkpoint.dir"):
            sc.setCheckpointDir(configured)
        elif sc.master.startswith("local[") or sc.master == "local":
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="pagelode-checkpoint-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, without its lineage.

    checkpoint() runs the last stage of a plan twice, to count rows and to write them; so the rows are kept on the
    executors' disks between the two. If an executor is lost meanwhile, its rows are made anew."""
    shared_folder(df.sparkSession)
    held = df.persist(StorageLevel.DISK_ONLY)
    out = held.checkpoint()
    held.unpersist()
    return out


def lean(step: Callable) -> Callable:
    """step, a function from batches to batches, after which a worker gives its free memory back.

    Workers are used again and wait between tasks; what one step held would add to what the next needs beside it. Steps make
    no cycles of objects, so the collector, which would walk through all that they remember, rests meanwhile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from step(batches)
        finally:
            gc.enable()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def unused(columns, name: str) -> str:
    """name, with as many underscores before it as columns need to have no such name, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the bitmap for each 64-bit key."""
    k = keys.view(np.uint64)
    return k % np.uint64(BITMAP), (k * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(BITMAP)


def maybe_among(keys: DataFrame) -> Callable:
    """A test of 64-bit keys, as a column: true for all keys of the one column of ``keys``, and by chance for a few others.

    The keys stay distributed: tasks set two bits of each in parts of a bitmap of BITMAP bits (8 MB), parts are united, and the
    bitmap is broadcast. Its size does not grow with the keys; with very many of them more others pass, so it
    serves to leave rows out of a shuffle, not to decide."""

    def parts(bits: np.ndarray) -> Iterator[tuple[int, bytes]]:
        for k, part in enumerate(bits.reshape(-1, PART // 8)):
            if part.any():
                yield k, zlib.compress(part.tobytes(), 1)

    def packed(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["part", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, any_keys = np.zeros(BITMAP // 8, np.uint8), False
        for b in batches:
            any_keys = any_keys or b.num_rows > 0
            for at in _bits(b.column(0).to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        if any_keys:
            yield packed(list(parts(bits)))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(x), np.uint8)
                made[k] = made[k] | part if k in made else part
        if made:
            yield packed([(k, zlib.compress(x.tobytes(), 1)) for k, x in made.items()])

    whole = bytearray(BITMAP // 8)
    for k, x in keys.mapInArrow(lean(mark), "part int, bits binary").repartition("part").mapInArrow(lean(unite), "part int, bits binary").collect():
        whole[k * PART // 8 : (k + 1) * PART // 8] = zlib.decompress(x)
    shared = keys.sparkSession.sparkContext.broadcast(bytes(whole))

    @F.pandas_udf("boolean")
    def among(k: pd.Series) -> pd.Series:
        bits = np.frombuffer(shared.value, np.uint8)
        a, b = ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 for at in _bits(k.to_numpy(np.int64)))
        return pd.Series((a & b).astype(bool))

    return among


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``most`` bytes of text; a single text may be larger."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = batch.column(at)
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = total = 0
        for k, n in enumerate(lengths):
            if total and total + n > most:
                yield batch.slice(begin, k - begin)
                begin, total = k, 0
            total += int(n)
        if begin < batch.num_rows:
            yield batch.slice(begin)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def lower_ascii(column):
    """Only A-Z are lower-cased."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes of UTF-8, A-Z lower-cased.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased, as UTF-8. Bytes split at this very white space."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of counts with the largest n, at most ``most``: all from a certain n up.

    The bound comes from a histogram of at most some 1,300 bars (exact to 256, then a 16th of a power of 2), so no
    task sends its own ``most`` rows to the driver, and equal counts are kept or left together."""
    bar = F.when(F.col(n) < 256, F.col(n)).otherwise(F.floor(F.log2(n) * 16) + 128).cast("bigint")
    room, least = most, 0
    for r in sorted(counts.groupBy(bar.alias("bar")).count().collect(), key=lambda r: -r["bar"]):
        room -= r["count"]
        if room < 0:
            least = r["bar"] + 1
            break
    return counts.where(bar >= least)
