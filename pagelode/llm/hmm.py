"""Hidden Markov language model: Baum-Welch over all training texts, exact likelihoods of whole texts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, frequent, lean, sliced, table, texts, words
from .langid import held_out

#: Latent states; rounds of Baum-Welch; tokens that have an emission of their own; longest token that stands for itself, in bytes.
STATES, ROUNDS, HEAD, PLAIN_BYTES = 4, 3, 1 << 18, 48
#: Classes that all other tokens fall in, by a hash; added to every count; tokens of a training segment.
CLASSES, SMOOTH, SEGMENT = 64, 0.1, 128
#: Different tokens that a task counts before it hands them on; bytes of text whose recursions go side by side.
COUNTED, AT_ONCE = 400_000, 4 << 20


def _tokens(text: str) -> list[bytes]:
    """The words of a text; a long one as two spaces, which no word has, and a digest of 128 bits."""
    found = words(text)
    if max(map(len, found), default=0) > PLAIN_BYTES:
        found = [w if len(w) <= PLAIN_BYTES else b"  " + blake2b(w, digest_size=16).digest() for w in found]
    return found


def _class_of(token: bytes) -> int:
    """The class of a token without an emission of its own: its length, first and last byte, mixed."""
    return (len(token) * 31 + token[-1] * 7 + token[0]) % CLASSES


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) over whole texts, counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["token", "c"])

        for b in sliced(batches, most=AT_ONCE):
            for t in texts(b):
                seen.update(_tokens(t))
            if len(seen) > COUNTED:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(lean(count), "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


class Model:
    """Symbols: the head's tokens, then the classes, then the end of a text.

    start (K), move (K, K), emit (symbols, K); a class's tokens share its emission in proportion to their
    smoothed counts, so text probabilities need the rest's counts, which are joined, not broadcast."""

    def __init__(self, head: list[tuple[bytes, int]], rest: dict[int, int], texts: int, tokens: int, distinct: int, states: int, seed: int = 3):
        self.number = {t: k for k, (t, _) in enumerate(head)}
        self.counts = np.array([c for _, c in head], np.int64)
        self.end = len(head) + CLASSES
        self.texts, self.tokens, self.distinct = texts, tokens, distinct
        seen = np.concatenate([self.counts, [rest.get(k, 0) for k in range(CLASSES)], [texts]]).astype(np.float64) + SMOOTH
        draw = np.random.default_rng(seed)
        emit = seen[:, None] * draw.exponential(1.0, (len(seen), states))
        self.emit = (emit / emit.sum(0)).astype(np.float32)
        move = draw.uniform(0.5, 1.5, (states, states)) + 12 * np.eye(states)  # states that last find languages and styles
        self.move = (move / move.sum(1, keepdims=True)).astype(np.float32)
        self.start = self.share = np.full(states, 1 / states, np.float32)

    def shared(self, spark, *names: str):
        """A function that gives a model of these attributes, on executors.

        Attributes are plain values and arrays: they are broadcast, as executors need not have this class."""
        state = spark.sparkContext.broadcast({n: getattr(self, n) for n in names})

        def model() -> Model:
            made = Model.__new__(Model)
            made.__dict__.update(state.value)
            return made

        return model

    def symbols(self, tokens: list[bytes]) -> np.ndarray:
        """The symbols of a text, with its end."""
        first = self.end - CLASSES
        out = list(map(self.number.get, tokens))
        if None in out:
            out = [first + _class_of(t) if n is None else n for n, t in zip(out, tokens)]
        return np.array([*out, self.end], np.int32)

    def log10_likelihoods(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Of whole sequences, by the forward recursion, scaled at each step; many sequences go side by side."""
        order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
        lengths = np.array([len(sequences[k]) for k in order])
        flat = np.concatenate([sequences[k] for k in order])
        at = np.cumsum(lengths) - lengths
        alive = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")  # how many have a token at each step
        total = np.zeros(len(order))
        move, emit = self.move.astype(np.float64), self.emit.astype(np.float64)
        a = self.start.astype(np.float64) * emit[flat[at]]
        s = a.sum(1)
        a /= s[:, None]
        pending = s
        for t in range(1, int(lengths[0])):
            n = alive[t]
            if n < len(a):
                total[n : len(a)] += np.log10(pending[n:])
                a, pending = a[:n], pending[:n]
            a = (a @ move) * emit[flat[at[:n] + t]]
            s = a.sum(1)
            a /= s[:, None]
            pending = pending * s
            if t % 16 == 0:
                total[:n] += np.log10(pending)
                pending = np.ones(n)
        total[: len(a)] += np.log10(pending)
        out = np.empty(len(order))
        out[order] = total
        return out

    def expected(self, segments: np.ndarray, first: np.ndarray, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected moves (K, K) and starts of segments (rows, SEGMENT) of symbols, -1 after their end; adds to emissions."""
        rows, steps = segments.shape
        k = len(self.start)
        live = segments >= 0
        b = self.emit[np.maximum(segments, 0)]
        b[~live] = 1
        alpha = np.empty((steps, rows, k), np.float32)
        scale = np.empty((steps, rows, 1), np.float32)
        share = self.share
        alpha[0] = np.where(first[:, None], self.start, share) * b[:, 0]
        for t in range(steps):
            if t:
                alpha[t] = np.where(live[:, t, None], (alpha[t - 1] @ self.move) * b[:, t], alpha[t - 1])
            scale[t] = alpha[t].sum(1, keepdims=True)
            alpha[t] /= scale[t]
        moves = np.zeros((k, k))
        beta = np.ones((rows, k), np.float32)
        gamma = np.empty((steps, rows, k), np.float32)
        for t in range(steps - 1, -1, -1):
            gamma[t] = alpha[t] * beta
            gamma[t] /= gamma[t].sum(1, keepdims=True)
            if t:
                on = live[:, t, None]
                ahead = np.where(on, b[:, t] * beta / scale[t], 0)
                moves += (alpha[t - 1].T @ ahead) * self.move
                beta = np.where(on, ahead @ self.move.T, beta)
        where = segments.T[live.T]
        for j in range(k):
            emissions[:, j] += np.bincount(where, gamma[:, :, j][live.T], len(emissions))
        return moves, gamma[0][first].sum(0)


def _segments(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences cut in segments: a matrix with -1 after ends, and which segments begin a text."""
    counts = [-(-len(s) // SEGMENT) for s in sequences]
    out = np.full((sum(counts), SEGMENT), -1, np.int32)
    first = np.zeros(len(out), bool)
    at = 0
    for s, n in zip(sequences, counts):
        out[at : at + n].reshape(-1)[: len(s)] = s
        first[at] = True
        at += n
    return out, first


def train(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model of all rows of docs (text), and the (token, c) table, which stays distributed.

    The ``head`` most frequent tokens have emissions of their own; the rest fall in classes. Each
    round of Baum-Welch reads all training texts, cut in segments of bounded length; tasks sum their expected counts per
    symbol, and the driver gets those sums: one row for each symbol, a bounded number."""
    counts = checkpointed(count_tokens(docs))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_texts = docs.count()
    chosen = frequent(counts, "c", head).toArrow()
    top = sorted(zip(chosen.column("token").to_pylist(), chosen.column("c").to_pylist()), key=lambda x: (-x[1], x[0]))
    length, byte = F.octet_length("token"), lambda at: F.conv(F.hex(F.substring("token", at, 1)), 16, 10).cast("int")
    classes = counts.withColumn("k", (length * 31 + byte(-1) * 7 + byte(1)) % CLASSES).groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    rest, kinds = {r["k"]: r["c"] for r in classes}, {r["k"]: r["n"] for r in classes}
    for t, c in top:
        rest[_class_of(t)] -= c
        kinds[_class_of(t)] -= 1
    # Ends are counted as tokens: one for each text.
    model = Model(top, rest, n_texts, int(total[0]) + n_texts, int(total[1]) + bool(n_texts), states)
    # A class's smoothed total: its counts, and SMOOTH for each of its tokens and for one that was never seen.
    model.class_totals = [rest.get(k, 0) + SMOOTH * (kinds.get(k, 0) + 1) for k in range(CLASSES)]
    if not n_texts:
        return model, counts
    coded = checkpointed(_coded(docs, model))
    for _ in range(rounds):
        _improve(coded, model)
    return model, counts


def _coded(docs: DataFrame, model: Model) -> DataFrame:
    """Every text's symbols, so that rounds do not split texts anew."""
    shared = model.shared(docs.sparkSession, "number", "end")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, squeeze = shared(), pa.Codec("zstd", compression_level=1)
        for b in sliced(batches, most=AT_ONCE):
            coded = [model.symbols(_tokens(t)) for t in texts(b)]
            flat = np.concatenate(coded)
            yield pa.RecordBatch.from_arrays([pa.array([np.array([len(c) for c in coded], np.int64).tobytes()], pa.binary()), pa.array([len(flat)], pa.int64()), pa.array([squeeze.compress(flat.tobytes(), asbytes=True)], pa.binary())], ["lengths", "total", "symbols"])

    return docs.select("text").mapInArrow(lean(code), "lengths binary, total bigint, symbols binary")


def _improve(coded: DataFrame, model: Model) -> None:
    """One round of Baum-Welch."""
    shared = model.shared(coded.sparkSession, "emit", "move", "start", "share")
    k, symbols = len(model.start), model.end + 1
    columns = [f"s{j}" for j in range(k)]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        emissions, moves, starts, any_rows = np.zeros((symbols, k)), np.zeros((k, k)), np.zeros(k), False
        squeeze = pa.Codec("zstd")
        for lengths, total, data in ((x[0], x[1], x[2]) for b in batches for x in zip(*(c.to_pylist() for c in b.columns))):
            flat = np.frombuffer(squeeze.decompress(data, 4 * total), np.int32)
            segments, first = _segments(np.split(flat, np.cumsum(np.frombuffer(lengths, np.int64))[:-1]))
            for at in range(0, len(segments), 4096):
                m, s = model.expected(segments[at : at + 4096], first[at : at + 4096], emissions)
                moves += m
                starts += s
                any_rows = True
        if any_rows:
            # Symbols first, then a row for each state's moves, then the starts.
            whole = np.concatenate([emissions, moves, starts[None]])
            kept = np.flatnonzero(whole.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32))] + [pa.array(whole[kept, j]) for j in range(k)], ["symbol", *columns])

    sums = coded.mapInArrow(lean(expect), "symbol int, " + ", ".join(f"{c} double" for c in columns)).groupBy("symbol").agg(*[F.sum(c).alias(c) for c in columns])
    got = np.zeros((symbols + k + 1, k))
    summed = sums.toArrow()
    for j, c in enumerate(columns):
        got[summed.column("symbol").to_numpy(), j] = summed.column(c).to_numpy()
    emit = got[:symbols] + SMOOTH
    model.emit = (emit / emit.sum(0)).astype(np.float32)
    move = got[symbols : symbols + k] + 1
    model.move = (move / move.sum(1, keepdims=True)).astype(np.float32)
    start = got[symbols + k] + 1
    model.start = (start / start.sum()).astype(np.float32)
    share = got[:symbols].sum(0) + 1
    model.share = (share / share.sum()).astype(np.float32)


def score_documents(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    score is the model's log10 probability of the text: the forward recursion over its symbols, and for each token
    of a class its share of the class. base_score is the smoothed unigram score. Counts of the head's tokens go
    with the model; other tokens meet their counts in a join, summed per text and token first.

    A null or empty text is its end alone. Tokens that training never saw have a count of 0 everywhere. Very
    long texts and tokens are scored whole. Repeated rows and ids are scored row by row; other columns are
    ignored; an empty table gives an empty table; without training texts all counts are 0."""
    shared = model.shared(docs.sparkSession, "number", "counts", "end", "texts", "emit", "move", "start")
    n, base = model.tokens, math.log10
    under = n + SMOOTH * (model.distinct + 1)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("_row", F.monotonically_increasing_id())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        end_log = base((model.texts + SMOOTH) / under)
        log = np.concatenate([np.log10((model.counts + SMOOTH) / under), [0.0] * CLASSES, [end_log]])
        for b in sliced(batches, most=AT_ONCE):
            split = [_tokens(t) for t in texts(b)]
            coded = [model.symbols(w) for w in split]
            likely = model.log10_likelihoods(coded) if coded else np.empty(0)
            first = model.end - CLASSES
            base_score = [float(log[s].sum()) for s in coded]
            n_head = [int((s < first).sum()) + (model.texts > 0) for s in coded]
            rest_rows, rest_tokens, rest_n = [], [], []
            for k, (w, s) in enumerate(zip(split, coded)):
                if len(w) + 1 > n_head[k]:
                    for t, m in Counter(w[i] for i in np.flatnonzero(s[:-1] >= first)).items():
                        rest_rows.append(k)
                        rest_tokens.append(t)
                        rest_n.append(m)
            ids = b.column(2)
            m, r = b.num_rows, len(rest_rows)
            # A text's own row has a key that no token has (it holds one space) and that spreads.
            keys = [b" %d" % x for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([ids, ids.take(pa.array(rest_rows, pa.int64()))]),
                    pa.array([*keys, *rest_tokens], pa.binary()),
                    pa.array([*[None] * m, *[_class_of(t) for t in rest_tokens]], pa.int32()),
                    pa.concat_arrays([b.column(0), pa.nulls(r, pa.int64())]),
                    pa.array([*[len(s) for s in coded], *[None] * r], pa.int64()),
                    pa.array([*n_head, *rest_n], pa.int64()),
                    pa.array([*base_score, *[0.0] * r], pa.float64()),
                    pa.array([*likely, *[0.0] * r], pa.float64()),
                ],
                ["_row", "token", "k", "doc_id", "n_tokens", "n", "base_score", "score"],
            )

    scored = rows.mapInArrow(lean(score), "_row bigint, token binary, k int, doc_id bigint, n_tokens bigint, n bigint, base_score double, score double")
    joined = scored.join(counts, "token", "left")
    c, own = F.coalesce("c", F.lit(0)), F.col("k").isNull()
    share = F.log10((c + SMOOTH) / F.element_at(F.lit(model.class_totals), F.col("k") + 1))
    out = joined.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(own | (c > 0), F.col("n")).otherwise(F.lit(0))).alias("n_known"),
        F.sum(F.when(own, F.col("base_score")).otherwise(F.col("n") * F.log10((c + SMOOTH) / F.lit(under)))).alias("base_score"),
        F.sum(F.when(own, F.col("score")).otherwise(F.col("n") * share)).alias("score"),
    )
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def op10_hmm(spark, sf_dir: str) -> DataFrame:
    """Every document scored by the model of nine tenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = train(docs.where(~held_out(10)))
    scored = score_documents(docs, model, counts)
    return scored.select("doc_id", held_out(10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
