"""Language identification in two steps: the family, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, sliced, table

#: Buckets that n-grams of bytes are hashed to.
FEATURES = 1 << 13
#: Labelled documents that the classifiers learn from, at most, in all; but so many of each language, however many there are.
SAMPLE, OF_EACH = 1600, 20
UNDETERMINED = "und"
#: Families of ISO 639 codes; a language that is in none is in "other".
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "be", "mk", "bs"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "indic": ("hi", "bn", "ur", "mr", "pa", "gu", "ne"),
    "cjk": ("zh", "ja", "ko"),
}

#: Bytes with A-Z lower-cased, and all of ASCII but letters made a space.
_LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def family(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language.lower().split("-")[0] in members), "other")


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed two- and three-byte grams of the texts, and which text each is of, in order."""
    coded = [b" " + t.encode("utf-8", "surrogatepass") + b"  " for t in texts]
    sizes = np.array([len(c) for c in coded])
    x = _LETTERS[np.frombuffer(b"".join(coded), np.uint8)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    x = np.concatenate([x, np.full(2, 32, np.uint8)]).astype(np.uint32)
    a, b, c = x[:-2], x[1:-1], x[2:]
    three = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(33 - FEATURES.bit_length())
    # Three blanks in a row say nothing; they also stand where texts meet.
    told = (a != 32) | ((b != 32) & (c != 32)) | ((b != 32) & (a == 32))
    return three[told].astype(np.int64), owner[told]


class Sparse:
    """Rows of (feature, value), each with a bias of 1 as its last feature."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.size = np.array([len(i) + 1 for i, _ in rows])
        self.begin = np.cumsum(self.size) - self.size
        self.feature = np.concatenate([np.append(i, FEATURES) for i, _ in rows]).astype(np.int32)
        self.value = np.concatenate([np.append(v, 1) for _, v in rows]).astype(np.float32)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.value * w[self.feature], self.begin)

    def turned(self, v: np.ndarray) -> np.ndarray:
        """The product of the transposed rows with v."""
        return np.bincount(self.feature, self.value * np.repeat(v, self.size), FEATURES + 1).astype(np.float32)


class Linear:
    """A linear SVM with squared hinge loss, by Nesterov's accelerated descent over the whole sample."""

    @staticmethod
    def fit(x: Sparse, y: np.ndarray, c: float = 10.0, steps: int = 120) -> np.ndarray:
        """Weights, the last one a bias; y is +1 or -1."""
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
        top = np.ones(FEATURES + 1, np.float32)
        for _ in range(12):  # the largest eigenvalue bounds the step
            top = x.turned(weight * x.dot(top))
            norm = float(np.linalg.norm(top)) or 1.0
            top /= norm
        rate = 1.0 / (1.0 + 2.2 * c * norm)
        w, before = np.zeros(FEATURES + 1, np.float32), np.zeros(FEATURES + 1, np.float32)
        for k in range(steps):
            at = w + (k / (k + 3)) * (w - before)
            slack = np.maximum(0, 1 - y * x.dot(at))
            before, w = w, at - rate * (at - 2 * c * x.turned(weight * y * slack))
        return w


class Model:
    """Languages by family; one row of weights per family and per pair of languages within one.

    ``state`` is what a model consists of, in plain lists and arrays: it is broadcast, as executors need not have this class."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.state = languages, weights, bias
        self.languages, self.weights, self.bias = languages, weights, bias
        self.families, self.members, self.pairs = self.tasks(languages)

    @staticmethod
    def tasks(languages: list[str]) -> tuple[list[str], dict[str, list[str]], list[tuple[str, str]]]:
        families = sorted({family(x) for x in languages})
        members = {f: [x for x in languages if family(x) == f] for f in families}
        return families, members, [(a, b) for f in families for a, b in combinations(members[f], 2)]

    @classmethod
    def fit(cls, counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str]) -> Model:
        """The model of texts given as (features, how often each), and their labels."""
        languages = sorted(set(labels))
        families, _, pairs = cls.tasks(languages)
        shares = [(i, n / max(1, n.sum())) for i, n in counts]
        mean = np.bincount(np.concatenate([i for i, _ in shares]), np.concatenate([v for _, v in shares]), FEATURES) / len(shares)
        scale = 1 / np.sqrt(mean + 1e-6)
        rows = [(i, v * scale[i]) for i, v in shares]
        label, of_family = np.array(labels), np.array([family(x) for x in labels])
        found, whole = [], Sparse(rows)
        for f in families if len(families) > 1 else []:
            found.append(Linear.fit(whole, np.where(of_family == f, 1, -1).astype(np.float32)))
        for a, b in pairs:
            mine = np.flatnonzero((label == a) | (label == b))
            found.append(Linear.fit(Sparse([rows[k] for k in mine]), np.where(label[mine] == a, 1, -1).astype(np.float32)))
        w = np.stack(found) if found else np.zeros((0, FEATURES + 1), np.float32)
        return cls(languages, (w[:, :-1] * scale).astype(np.float32), w[:, -1].copy())

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of texts that have letters."""
        gram, owner = _grams(texts)
        margin = np.zeros((len(texts), len(self.weights)))
        size = np.bincount(owner, minlength=len(texts))
        for k, weights in enumerate(self.weights):
            margin[:, k] = np.bincount(owner, weights[gram], len(texts)) / np.maximum(size, 1) + self.bias[k]
        n = len(self.families) if len(self.families) > 1 else 0
        if n:
            e = np.exp(np.clip(3 * margin[:, :n], -50, 50))
            chance = e / e.sum(1, keepdims=True)
            chosen = chance.argmax(1)
            score = chance.max(1)
        else:
            chosen, score = np.zeros(len(texts), int), np.ones(len(texts))
        said = []
        for k, f in enumerate(chosen):
            members = self.members[self.families[f]]
            if len(members) == 1:
                said.append(members[0])
                continue
            votes, surest = dict.fromkeys(members, 0), dict.fromkeys(members, 1.0)
            for j, (a, b) in enumerate(self.pairs):
                if a in votes:
                    p = 1 / (1 + np.exp(-np.clip(3 * margin[k, n + j], -50, 50)))
                    votes[a if p >= 0.5 else b] += 1
                    surest[a], surest[b] = min(surest[a], p), min(surest[b], 1 - p)
            best = max(members, key=lambda x: (votes[x], surest[x]))
            said.append(best)
            score[k] *= surest[best]
        return said, score


def _features(texts: list[str]) -> np.ndarray:
    gram, owner = _grams(texts)
    return np.bincount(owner * FEATURES + gram, minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES)


def learn(labelled: DataFrame, sample: int = SAMPLE, of_each: int = OF_EACH) -> Model | None:
    """A model of the labelled rows (text, lang), or None if no labelled text has letters.

    It learns every language that occurs, from at most ``sample`` rows, as many of each language, or ``of_each`` of each where that is more: those
    whose hashes are the smallest. How many different texts a language has bounds the hashes that can be among them, so
    few more rows than the sample's travel, whatever the share of a language; they come to the driver as counts of features."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    different = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    if not different:
        return None
    each = max(of_each, sample // len(different))
    bound = F.lit(None).cast("bigint")
    for k, r in enumerate(different):
        share = min(1.0, 1.15 * (each + 4 * each**0.5) / max(1, r["n"]))
        last = F.lit(min(2**63 - 1, int(2**64 * share) - 2**63))
        bound = F.when(F.col("lang") == r["lang"], last) if k == 0 else bound.when(F.col("lang") == r["lang"], last)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = _features(part.column(1).to_pylist())
                kept = made.sum(1) > 0
                which = [np.flatnonzero(m).astype(np.int16) for m in made[kept]]
                much = [m[i].astype(np.int32) for m, i in zip(made[kept], which)]
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(kept)) for k in (0, 2)] + [pa.array([i.tobytes() for i in which], pa.binary()), pa.array([c.tobytes() for c in much], pa.binary())], ["lang", "h", "which", "much"])

    due = rows.where(F.col("h") <= bound).dropDuplicates(["h", "lang"]).select("lang", "text", "h")
    found = due.mapInArrow(lean(count), "lang string, h bigint, which binary, much binary").collect()
    room: dict[str, int] = {}
    counts, labels = [], []
    for r in sorted(found, key=lambda r: (r["h"], r["lang"])):
        room[r["lang"]] = room.get(r["lang"], each) - 1
        if room[r["lang"]] >= 0:
            counts.append((np.frombuffer(r["which"], np.int16), np.frombuffer(r["much"], np.int32)))
            labels.append(r["lang"])
    return Model.fit(counts, labels) if labels else None


def _shared(docs: DataFrame, model: Model | None):
    """A function that gives the model, on executors."""
    state = docs.sparkSession.sparkContext.broadcast(model and model.state)
    return lambda: state.value and Model(*state.value)


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns with lang_pred and score (0 to 1) of every whole text.

    Null and empty texts and texts without a letter are ``und`` with score 0, as is everything without a model.
    Rows are independent of each other: repeated rows and ids, ties and other columns do no harm. An empty table gives an empty one."""
    kept = docs.select(*keep).schema
    shared = _shared(docs, model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for b in sliced(batches, "_text"):
            said, score = [UNDETERMINED] * b.num_rows, np.zeros(b.num_rows)
            text = b.column(len(keep)).to_pylist()
            able = [k for k, t in enumerate(text) if model and t and any(map(str.isalpha, t))]
            if able:
                languages, scores = model.predict([text[k] for k in able])
                score[able] = scores
                for k, language in zip(able, languages):
                    said[k] = language
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(keep))] + [pa.array(said), pa.array(score)], [*keep, "lang_pred", "score"])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(lean(predict), ddl)


def accepted(docs: DataFrame, model: Model | None, least: float = 0.2) -> DataFrame:
    """docs without the rows whose language cannot be told: ``und``, or a score under ``least``. All columns stay.

    Without a model (no labelled text has letters) there is nothing to tell by, and rows with letters stay."""
    shared = _shared(docs, model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for b in sliced(batches):
            text = b.column(at).to_pylist()
            able = [k for k, t in enumerate(text) if t and any(map(str.isalpha, t))]
            if model and able:
                _, scores = model.predict([text[k] for k in able])
                able = [k for k, s in zip(able, scores) if s >= least]
            yield b.take(pa.array(able, pa.int64()))

    return docs.mapInArrow(lean(keep), docs.schema)


def held_out(folds: int):
    """Whether a row is held out: its doc_id's CRC-32, of the id as text, is divisible by folds. No id: it is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))


def op9_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(5)).select("text", "lang"))
    return identify(docs, model).select("doc_id", held_out(5).alias("held_out"), "lang_pred", "score")
