"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, unused

#: Weights that sources get in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target and a document's share are at most this many times their size.
MOST = 3
#: Documents that one node of the reduction tree rounds, on average.
FAN_IN = 256


def _numbered(totals: DataFrame) -> DataFrame:
    """totals with place: the number of each source from 0 in order of code points, null last.

    Sources are dealt out by ranges and numbered in each; only how many each range has meets in one task."""
    at = F.monotonically_increasing_id()  # the range's number and, in 33 bits, the place in it
    dealt = totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("at", at)
    dealt = checkpointed(dealt.withColumn("range", F.shiftright("at", 33)))
    before = F.sum("n_range").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    ranges = dealt.groupBy("range").agg(F.count("*").alias("n_range")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    return dealt.join(ranges, "range").withColumn("place", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("range", "before", "at")


def _targets(totals: DataFrame, weights, most: int) -> DataFrame:
    """totals (source, source_size, ...) with weight and target: all sizes shared by weight, each source at most ``most`` times its size.

    Shares are the common level times the weight. A source whose limit lies under its share is full, and what full sources cannot
    take raises the level of the rest, until no more are full. A round is one pre-aggregated sum over the sources, of which one row
    comes to the driver; each round but the last finds another full source, and limits that lie close to each other fill up together."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    cap = (F.lit(most) * F.col("source_size")).cast("double")
    ranked = checkpointed(_numbered(totals).withColumn("weight", weight).withColumn("cap", cap).drop("place"))
    everything, weighed = ranked.agg(F.coalesce(F.sum("source_size").cast("double"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, full = (everything / weighed if weighed else 0.0), 0
    while True:
        is_full = F.col("cap") < F.lit(level) * F.col("weight")
        n, taken, left = ranked.agg(F.count_if(is_full), F.coalesce(F.sum(F.when(is_full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0))).first()
        if n == full:
            return ranked.withColumn("target", F.when(is_full, F.col("cap")).otherwise(F.lit(level) * F.col("weight"))).drop("weight", "cap")
        level, full = (everything - taken) / left if left else level, n


def _settle(units, seed: int):
    """Pivotal steps over an array of units (row, size, mass), in order: struct(left, done).

    Each step holds a left-over unit against the next one, and moves words from one to the other until
    one of them has all or none of its words. The direction is drawn so that expected words stay as they
    are; the sum never changes. done: the row and words of each settled unit; left: the one still open."""
    unit = "struct<row:string,size:double,mass:double>"
    done = "array<struct<row:string,mass:double>>"
    zero = F.struct(F.lit(None).cast(unit).alias("left"), F.array().cast(done).alias("done"))

    def step(acc, u):
        a, b = acc["left"], u
        up = F.least(a["size"] - a["mass"], b["mass"])  # words that a can gain from b
        down = F.least(a["mass"], b["size"] - b["mass"])  # words that a can give to b
        draw = (F.xxhash64(a["row"], b["row"], F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / F.lit(float(1 << 52))
        gains = draw * (up + down) < down
        a_now = F.when(gains, a["mass"] + up).otherwise(a["mass"] - down)
        b_now = F.when(gains, b["mass"] - up).otherwise(b["mass"] + down)
        # Which of the two is settled follows from the limit that was met, not from a comparison of sums.
        a_full = gains & (a["size"] - a["mass"] <= b["mass"])
        a_none = ~gains & (a["mass"] <= b["size"] - b["mass"])
        b_mass = F.when(gains, F.lit(0.0)).otherwise(b["size"])
        a_settled = a_full | a_none
        settled = F.when(a_settled, F.struct(a["row"].alias("row"), F.when(a_full, a["size"]).otherwise(F.lit(0.0)).alias("mass"))).otherwise(F.struct(b["row"].alias("row"), b_mass.alias("mass")))
        left = F.when(a_settled, F.struct(b["row"].alias("row"), b["size"].alias("size"), b_now.alias("mass"))).otherwise(F.struct(a["row"].alias("row"), a["size"].alias("size"), a_now.alias("mass")))
        return F.when(a.isNull(), F.struct(u.cast(unit).alias("left"), acc["done"].alias("done"))).otherwise(F.struct(left.cast(unit).alias("left"), F.concat(acc["done"], F.array(settled).cast(done)).alias("done")))

    return F.aggregate(units, zero, step)


def mix_plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST, fan_in: int = FAN_IN, seed: int = 17) -> DataFrame:
    """One row per different (doc_id, source, text): row, doc_id, source, rows, size, source_size, target, taken, extra.

    Every row of a source has the same expected copies f = target / source_size. It gets floor(f) whole copies;
    the fraction is rounded by pivotal sampling, in words: within a source, two rows at a time move
    words until one of them has all or none. Rows go to nodes of about ``fan_in`` rows by a hash; each node leaves
    one open row, and these meet at the next level of the tree, so no task gathers a source. The one row that
    stays open at a source's root is cut: its first words bring the source to its target, within one word.

    Null texts and texts without words have size 0 and take 0. A null source is a source of its own, the last.
    ``rows`` counts repeated rows; they are rounded as one, and each takes ``taken`` words, ``extra`` of them one word more. Equal or
    null doc_ids with different texts are separate. Reruns agree: draws are hashes of the rows. Empty tables give empty tables."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    units = checkpointed(docs.select(_row_of(seed).alias("row"), "doc_id", "source", size.alias("size")).groupBy("row", "doc_id", "source", "size").agg(F.count("*").alias("rows")))
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    by_source = _targets(totals, weights, most).withColumnRenamed("source", "s")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(copies), F.lit(most)).cast("long")
    each = (
        units.join(by_source, F.col("source").eqNullSafe(F.col("s")))
        .withColumns({"whole": whole, "all": (F.col("size") * F.col("rows")).cast("double")})
        .withColumn("mass", F.col("all") * (copies - F.col("whole")))
    )
    open_rows = each.where("mass > 0 and mass < `all`").select(F.col("s").alias("source"), "n", "row", F.col("all").alias("size"), "mass")
    done, level = None, 0
    while True:
        node = F.pmod(F.xxhash64("row", F.lit(level)), F.greatest(F.lit(1), F.ceil(F.col("n") / fan_in)).cast("long"))
        nodes = open_rows.groupBy("source", "n", node.alias("node")).agg(F.sort_array(F.collect_list(F.struct("size", "row", "mass"))).alias("u"))
        units_of = F.transform("u", lambda x: F.struct(x["row"].alias("row"), x["size"].alias("size"), x["mass"].alias("mass")))
        state = checkpointed(nodes.select("source", "n", _settle(units_of, seed + level).alias("s")))
        settled = state.select(F.explode("s.done").alias("d")).select("d.row", F.col("d.mass").alias("got"))
        done = settled if done is None else done.unionByName(settled)
        top = state.agg(F.max("n")).first()[0]
        open_rows = state.where("s.left is not null").select("source", F.ceil(F.col("n") / fan_in).cast("long").alias("n"), "s.left.row", "s.left.size", "s.left.mass")
        level += 1
        if top is None or top <= fan_in:
            break
    done = done.unionByName(open_rows.select("row", F.round("mass").alias("got")))
    got = F.floor(F.coalesce(F.col("got"), F.lit(0.0))).cast("long")
    rounded = each.join(done, "row", "left").withColumn("got", got).withColumn("extra", F.col("got") % F.col("rows"))
    taken = F.col("size") * F.col("whole") + F.floor((F.col("got") - F.col("extra")) / F.col("rows")).cast("long")
    return rounded.select("row", "doc_id", "source", "rows", "size", "source_size", "target", taken.alias("taken"), "extra")


def _row_of(seed: int):
    """What tells rows of a mix apart: 128 bits of doc_id, source and text."""
    return F.concat(F.hex(F.xxhash64("doc_id", "source", "text")), F.hex(F.xxhash64("text", F.lit(seed), "source", "doc_id")))


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST, fan_in: int = FAN_IN, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target and taken of mix_plan for every row; columns of these names are replaced.

    Repeated rows all take the same, so a source may lie under its target by a word for each repetition of the one row that is cut."""
    docs = docs.drop("size", "source_size", "target", "taken")
    row = unused(docs.columns, "row")
    plan = mix_plan(docs, weights, most, fan_in, seed).select(F.col("row").alias(row), "size", "source_size", "target", "taken")
    return docs.withColumn(row, _row_of(seed)).join(plan, row).drop(row)


def mixture(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of the mix, with the columns of docs: whole copies, and for the row that is cut, its first words.

    Rows of which nothing is taken, among them rows without words, are left out."""
    made, names = ("size", "source_size", "target", "taken"), list(docs.columns)
    aside = {c: unused(names, f"own_{c}") for c in names if c.lower() in made}
    mixed = mix_sources(docs.withColumnsRenamed(aside), **parameters)
    words = unused(mixed.columns, "words")
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    copies = F.array_repeat(F.lit(0).cast("long"), whole.cast("int"))
    part = F.col("taken") - whole * F.col("size")
    cuts = mixed.withColumn(words, F.explode(F.concat(copies, F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))))
    # Split after each word, so that the white space before a word stays with it.
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col(words) == 0, F.col("text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col(words).cast("int")), ""))
    out = cuts.withColumn("text", text).drop(*made, words)
    return out.withColumnsRenamed({to: c for c, to in aside.items()}).select(*[F.col(f"`{c}`") for c in names])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with its source's size and target and the words that the mix takes of it."""
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    taken = F.col("taken") + F.when(F.col("copy") <= F.col("extra"), 1).otherwise(0)
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
