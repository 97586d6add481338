"""Spelling: candidates within two edits that the dictionary has, corrections and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Words that are broadcast to the dictionary, at most.
FEW = 64


def edits1(word: Column) -> Column:
    """All strings one deletion, transposition, replacement or insertion away."""
    letters = F.array(*[F.lit(c) for c in LETTERS])
    n = F.length(word)
    none = F.array().cast("array<string>")
    at = lambda low: F.when(n >= low, F.sequence(F.lit(1), n - (low - 1))).otherwise(F.array().cast("array<int>"))
    left = lambda i: F.substring(word, F.lit(1), i - 1)
    right = lambda i: F.substring(word, i, n)
    deletes = F.transform(at(1), lambda i: F.concat(left(i), right(i + 1)))
    swaps = F.transform(at(2), lambda i: F.concat(left(i), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), right(i + 2)))
    replaces = F.flatten(F.transform(at(1), lambda i: F.transform(letters, lambda c: F.concat(left(i), c, right(i + 1)))))
    inserts = F.flatten(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.transform(letters, lambda c: F.concat(left(i), c, right(i)))))
    return F.array_distinct(F.concat(F.coalesce(deletes, none), F.coalesce(swaps, none), F.coalesce(replaces, none), inserts))


def dictionary(df: DataFrame) -> DataFrame:
    """(term, freq, p) of an index's (term, df)."""
    total = df.agg(F.sum("df").alias("_total"))
    return df.crossJoin(F.broadcast(total)).select("term", F.col("df").alias("freq"), F.when(F.col("_total") > 0, F.col("df") / F.col("_total")).otherwise(F.lit(0.0)).alias("p"))


def deletions(word: Column) -> Column:
    """The word, and all strings that are left of it when one or two of its characters go."""
    n = F.length(word)
    less = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
    one = F.array_distinct(less(word))
    return F.when(n > 0, F.array_distinct(F.concat(F.array(word), one, F.flatten(F.transform(one, less))))).otherwise(F.array(word))


def swaps(word: Column) -> Column:
    """All strings in which two neighbouring characters of the word have changed places."""
    n = F.length(word)
    swap = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), F.substring(word, i + 2, n))
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), swap)).otherwise(F.array().cast("array<string>"))


def edits(word: Column, term: Column) -> Column:
    """0, 1 or 2: how many edits of edits1 lead from word to term; null if more.

    Two edits are two of Levenshtein's, or a swap on either side and one of those, or a swap on either side. Edits put in letters a to z
    alone, so a term with others is looked for among the edits themselves."""
    near = lambda a, b, k: F.levenshtein(a, b) <= k
    one = near(word, term, 1) | F.array_contains(swaps(word), term)
    two = near(word, term, 2) | F.exists(swaps(word), lambda w: near(w, term, 1)) | F.exists(swaps(term), lambda t: near(word, t, 1)) | F.arrays_overlap(swaps(word), swaps(term))
    plain = term.rlike("^[a-z]*$")
    one_other = F.array_contains(edits1(word), term)
    two_other = F.exists(edits1(word), lambda w: F.array_contains(edits1(w), term))
    return F.when(word == term, 0).when(plain & one | ~plain & one_other, 1).when(plain & F.coalesce(two, F.lit(False)) | ~plain & two_other, 2)


def neighbourhood(known: DataFrame) -> DataFrame:
    """(key, term, freq, p): each known term by its deletions. It can be stored with an index, bucketed by key."""
    return known.select(F.explode(deletions(F.col("term"))).alias("key"), "term", "freq", "p")


def candidates(words: DataFrame, known: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(word, term, freq, p, edits): known terms at the least distance of 0, 1 or 2 edits that has any.

    Words are taken once each. A few words, at most FEW, are broadcast and compared with each term of about their length. More words,
    or terms with a stored neighbourhood, meet in a join: a word and a term at most two edits apart are equal when some two
    characters or fewer of each are gone, so they meet by such deletions, and the few pairs that do are compared."""
    asked = words.select(F.lower("word").alias("word")).where("word is not null").distinct()
    if stored is None and asked.limit(FEW + 1).count() <= FEW:
        # A swap is two of Levenshtein's edits and leaves the characters, in order, as they are.
        ordered = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
        terms = known.select("term", "freq", "p", ordered("term").alias("_t"))
        swapped = (F.levenshtein(F.col("_w"), F.col("_t"), 2) >= 0) & (F.levenshtein(F.col("word"), F.col("term"), 4) >= 0)
        alike = (F.abs(F.length("word") - F.length("term")) <= 2) & ((F.levenshtein(F.col("word"), F.col("term"), 2) >= 0) | swapped)
        met = terms.join(F.broadcast(asked.withColumn("_w", ordered("word"))), alike).drop("_t", "_w")
    else:
        keyed = asked.withColumn("key", F.explode(deletions(F.col("word"))))
        met = keyed.join(stored if stored is not None else neighbourhood(known), "key").groupBy("word", "term").agg(F.first("freq").alias("freq"), F.first("p").alias("p"))
    least = F.min("edits").over(W.partitionBy("word"))
    return met.withColumn("edits", edits(F.col("word"), F.col("term"))).withColumn("least", least).where("edits = least").select("word", "term", "freq", "p", "edits")


def correct(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, corrected): the likeliest candidate, ties by term; the word itself without one."""
    best = candidates(words, known).groupBy("word").agg(F.min(F.struct((-F.col("p")).alias("m"), "term")).alias("b")).select("word", F.col("b.term").alias("corrected"))
    asked = words.select(F.lower("word").alias("word")).where("word is not null").distinct()
    return asked.join(best, "word", "left").select("word", F.coalesce("corrected", "word").alias("corrected"))


def suggest(words: DataFrame, known: DataFrame, n: int = 5) -> DataFrame:
    """(word, term, p, rank): the n likeliest candidates of each word."""
    rank = F.row_number().over(W.partitionBy("word").orderBy(F.desc("p"), "term"))
    return candidates(words, known).withColumn("rank", rank).where(F.col("rank") <= n).select("word", "term", "p", "rank")


def query_words(query: Column) -> Column:
    """The words of a query that are checked: runs of letters, three or more."""
    return F.filter(F.regexp_extract_all(query, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[A-Za-z]{3,}$"))


def correct_queries(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, query, corrected, corrections): each misspelt word replaced where it first occurs, in order."""
    spelt = queries.select("query_id", "query", F.posexplode_outer(query_words(F.col("query"))).alias("pos", "original"))
    fixed = correct(spelt.select(F.col("original").alias("word")), known)
    rows = spelt.withColumn("word", F.lower("original")).join(fixed, "word", "left")
    change = F.when(F.col("corrected") != F.col("word"), F.struct("pos", "original", "corrected"))
    found = rows.groupBy("query_id", "query").agg(F.sort_array(F.collect_list(change)).alias("c"))

    def replaced(text, c):
        place = F.call_function("locate", c["original"], text)
        return F.when(place > 0, F.concat(F.substring(text, F.lit(1), place - 1), c["corrected"], F.substring(text, place + F.length(c["original"]), F.length(text)))).otherwise(text)

    return found.select("query_id", "query", F.aggregate("c", F.col("query"), replaced).alias("corrected"), F.transform("c", lambda x: F.struct(x["original"].alias("original"), x["corrected"].alias("corrected"))).alias("corrections"))
