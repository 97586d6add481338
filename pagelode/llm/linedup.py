"""Substring dedup by hashing of lines and of pieces within lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, lean, maybe_among, sliced, table, texts, unused
from .hashes import Words, mixed, odd

#: Words in which a line has at least one cut.
WINDOW = 16
#: Least words of a run of repeated units that is removed.
LEAST_WORDS = 16

_FIRST = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("times", pa.int32())])
_UNITS = pa.schema([("row", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("unit", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("n", pa.int32()), ("whole", pa.bool_()), ("again", pa.bool_())])


def units(texts: list[str], window: int = WINDOW):
    """Of texts: which text, start, stop (offsets in it), words and two digests of each unit, as arrays.

    A unit is a line, or a piece of one: a line of over ``window`` words is cut where the hash of a word pair is
    the smallest of a window of pairs. A cut depends on the words around it alone, so a passage has
    the same inner cuts wherever it stands, and two cuts are at most ``window`` words apart. Words are
    compared with A-Z lower-cased and white space collapsed; units without words are left out."""
    return _cut(texts, window)[:6]


def _cut(texts: list[str], window: int):
    """What units gives, and whether each unit is a whole line."""
    w = Words(texts)
    raw, begin, end, word, text = w.raw, w.begin, w.end, w.hash, w.text
    if not len(begin):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2 + (np.empty(0, bool),)
    # Lines begin at the first word after a line break; texts are apart by one.
    line = np.searchsorted(np.flatnonzero(raw == 10), begin)
    first = np.concatenate([[True], line[1:] != line[:-1]])
    n = len(word)
    cut = first.copy()
    if n > window:
        pair = np.concatenate([[np.uint64(0)], mixed(word[:-1] + word[1:] * np.uint64(3), 7)])
        pair[first] = np.uint64(2**64 - 1)  # pairs do not cross lines
        inside = np.flatnonzero(line[: n - window + 1] == line[window - 1 :])
        views = np.lib.stride_tricks.sliding_window_view(pair, window)
        cut[views[inside].argmin(1) + inside] = True
    where = np.flatnonzero(cut)
    size = np.diff(np.append(where, n))
    whole = first[where] & np.append(first[where[1:]], True)
    inside = np.arange(n) - np.repeat(where, size)
    weight = odd(int(size.max()), 11)
    d1 = mixed(np.add.reduceat(word * weight[inside], where), 13)
    d2 = mixed(np.add.reduceat(mixed(word, 17) * weight[inside], where), 23)
    start, stop = begin[where], end[np.append(where[1:], n) - 1]
    text, base = text[where], w.base
    if not w.ascii:  # bytes to code points
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        start, stop, base = chars[start], chars[stop], chars[np.minimum(base, len(raw))]
    return text, start - base[text], stop - base[text], size, d1, d2, whole


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _distinct(text: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of units in order: those whose digests their text did not have before, and of these, those that it has again."""
    order = np.lexsort((np.arange(len(text)), d2, d1, text))
    t, x, y = text[order], d1[order], d2[order]
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    more = np.zeros(len(t), bool)
    more[:-1] = ~first[1:]
    new, again = np.zeros(len(t), bool), np.zeros(len(t), bool)
    new[order], again[order] = first, first & more
    return new, again


def _firsts(rows: DataFrame, window: int) -> DataFrame:
    """(d1, d2, doc, row, times): the different units of each text; times is 2 if the text has it again, else 1."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            text, _, _, _, d1, d2, _ = _cut(texts(b), window)
            new, again = _distinct(text, d1, d2)
            at = pa.array(text[new])
            yield pa.RecordBatch.from_arrays([pa.array(d1[new].view(np.int64)), pa.array(d2[new].view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(again[new].astype(np.int32) + 1)], schema=_FIRST)

    return rows.mapInArrow(lean(make), _ddl(_FIRST))


def _units(rows: DataFrame, window: int) -> DataFrame:
    """Every unit of each row, with its number, offsets, words, whether it is a whole line, and whether its text had it before."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            text, start, stop, size, d1, d2, whole = _cut(texts(b), window)
            number = np.arange(len(text)) - np.searchsorted(text, text)
            narrow = [pa.array(x.astype(np.int32)) for x in (number, start, stop, size)]
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(text)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), *narrow, pa.array(whole), pa.array(~_distinct(text, d1, d2)[0])], schema=_UNITS)

    return rows.mapInArrow(lean(make), _ddl(_UNITS))


def _row_of():
    """What tells rows apart: a hash of doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), "text")


def repeated_spans(docs: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS, whole_lines: bool = False) -> DataFrame:
    """(doc_id, spans): the passages that stand elsewhere before, as array<struct<start,stop,words>> of code points.

    Digests of all units are grouped over all documents; the occurrence that is first by doc_id and place is
    kept, the others are repeats. Neighbouring repeats of one document make a passage, which is listed if it has
    at least ``least_words`` words; with ``whole_lines``, repeated whole lines are listed at any length. Which digests repeat is
    found first, with a minimum summed before the shuffle; a frequent one's occurrences are then split over tasks by the
    adaptive join. A null doc_id ranks first. Rows with one doc_id and different texts are documents of their own, in a fixed
    order; rows equal in both are one. Documents without such passages have no row here."""
    found = _spans(docs, window, least_words, whole_lines)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _row_of().alias("row")).distinct()
    return rows.join(found, "row").select("doc_id", "spans")


def _spans(docs: DataFrame, window: int, least_words: int, whole_lines: bool) -> DataFrame:
    """(row, spans) of repeated_spans, by _row_of()."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc"), _row_of().alias("row"), "text")
    first = _firsts(rows, window).groupBy("d1", "d2").agg(F.min(F.struct("doc", "row")).alias("first"), F.sum("times").alias("times"))
    first = checkpointed(first.where("times > 1").select("d1", "d2", F.col("first.row").alias("holder")))
    own = _units(rows, window).join(first, ["d1", "d2"]).where("row <> holder or again").select("row", "unit", "start", "stop", "n", "whole").dropDuplicates(["row", "unit"])
    # Runs of neighbouring repeats, within one document.
    by = W.partitionBy("row").orderBy("unit")
    run = own.withColumn("g", F.col("unit") - F.row_number().over(by))
    if whole_lines:
        # Of a run with fewer words its whole lines stay, which are runs anew.
        long = F.sum("n").over(W.partitionBy("row", "g")) >= least_words
        kept = run.withColumn("long", long).where("long or whole")
        run = kept.withColumn("g", F.col("unit") - F.row_number().over(by))
        least_words = 1
    runs = run.groupBy("row", "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("words")).where(F.col("words") >= least_words)
    return runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "words"))).alias("spans"))


def without_spans(text, spans):
    """text with the spans' code points taken out."""
    start = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["stop"]))
    stop = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    return F.array_join(F.transform(F.arrays_zip(start.alias("a"), stop.alias("b")), lambda p: F.substring(text, p["a"] + 1, p["b"] - p["a"])), "")


def dedup_passages(docs: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS, whole_lines: bool = False) -> DataFrame:
    """docs with spans (empty without repeats) and kept_text, the text without its repeated passages.

    A null text stays null; offsets in spans are those of the text as it was. All rows and other columns stay. Rows without
    repeats stay where they are; only the others are shuffled to meet their spans."""
    spans = checkpointed(_spans(docs, window, least_words, whole_lines))
    cut = maybe_among(spans.select("row"))
    none = F.array().cast("array<struct<start:int,stop:int,words:bigint>>")
    docs = docs.drop("spans", "kept_text")
    row = unused(docs.columns, "row")
    rows = docs.withColumn(row, _row_of())
    joined = rows.where(cut(row)).join(spans.withColumnRenamed("row", row), row, "left")
    kept = F.when(F.col("spans").isNull(), F.col("text")).otherwise(without_spans(F.col("text"), F.col("spans")))
    met = joined.withColumn("kept_text", kept).withColumn("spans", F.coalesce("spans", none))
    return rows.where(~cut(row)).withColumns({"spans": none, "kept_text": F.col("text")}).unionByName(met).drop(row)


def op6_linedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the offsets of the passages that an earlier document (or place) has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = docs.select("doc_id", _row_of().alias("row")).join(_spans(docs, WINDOW, LEAST_WORDS, True), "row", "left")
    zero = F.lit(0).cast("bigint")
    removed = F.aggregate("spans", zero, lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", F.when(F.col("spans").isNull(), zero).otherwise(F.size("spans").cast("bigint")).alias("n_repeats"), F.coalesce(removed, zero).alias("removed_chars"), "spans")
