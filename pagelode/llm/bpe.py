"""BPE encoding through a minimal acyclic transducer of frequent words, with exact merging of the rest."""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, frequent, lean, sliced, table, texts

#: Most frequent chunks of the corpus whose words the lexicon holds.
LEXICON_CHUNKS = 1 << 16
#: Longest word, in bytes, that the lexicon holds.
LEXICON_WORD = 64
#: Chunks that a task remembers the ids of; the half that it has not met since are forgotten when these are many.
REMEMBERED = 200_000
#: Different chunks that a task counts before it hands them on.
COUNTED = 300_000
#: Characters of these chunks, at most, before a text.
REMEMBERED_CHARS = 1 << 24
#: Longest word, in bytes, that is merged side by side with others.
SHORT = 64

_COUNTS = pa.schema([("chunk", pa.string()), ("n", pa.int64())])


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Lexicon:
    """A minimal acyclic automaton from words to their number in sorted order, in one buffer.

    A state's arcs are sorted by byte; an arc has its byte, target and how many words come before those
    behind it, so that the sum along a path is the word's number. Equal suffixes share states. Behind the
    automaton stand each number's output: ids and token texts."""

    @staticmethod
    def build(outputs: dict[bytes, list[int]]) -> bytes:
        """The buffer of words with ids: words are added in sorted order and finished suffixes are shared at once."""
        register: dict[tuple, int] = {}
        arcs_of: list[list[tuple[int, int]]] = []  # per state (byte, target)
        final: list[bool] = []

        def state() -> int:
            arcs_of.append([])
            final.append(False)
            return len(final) - 1

        root = state()
        path, before = [root], b""

        def close(down_to: int) -> None:
            for depth in range(len(path) - 1, down_to, -1):
                child, parent = path[depth], path[depth - 1]
                same = register.setdefault((final[child], tuple(arcs_of[child])), child)
                if same != child:
                    byte, _ = arcs_of[parent][-1]
                    arcs_of[parent][-1] = (byte, same)
                path.pop()

        order = sorted(outputs)
        for word in order:
            common = len(os.path.commonprefix([before, word]))
            close(common)
            for byte in word[common:]:
                child = state()
                arcs_of[path[-1]].append((byte, child))
                path.append(child)
            final[path[-1]] = True
            before = word
        close(0)
        kept = sorted({root, *register.values()})
        number = {s: k for k, s in enumerate(kept)}
        words: dict[int, int] = {}
        stack = [root]
        while stack:  # words behind each state, children first
            s = stack[-1]
            todo = [t for _, t in arcs_of[s] if t not in words]
            if todo:
                stack.extend(todo)
            else:
                words[s] = final[s] + sum(words[t] for _, t in arcs_of[s])
                stack.pop()
        first = np.zeros(len(kept) + 1, np.int32)
        byte, target, skip = [], [], []
        for s in kept:
            passed = int(final[s])
            for b, t in arcs_of[s]:
                byte.append(b)
                target.append(number[t])
                skip.append(passed)
                passed += words[t]
            first[number[s] + 1] = len(byte)
        ids = [outputs[w] for w in order]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.array([i for x in ids for i in x], np.int32)
        ends = np.array([final[s] for s in kept], np.uint8)
        arrays = [first, np.array(byte, np.int32), np.array(target, np.int32), np.array(skip, np.int32), starts, flat, ends]
        head = np.array([number[root], *[len(a) for a in arrays]], np.int32)
        return head.tobytes() + b"".join(a.tobytes() for a in arrays)

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int32, 8)
        self.root, at, arrays = int(head[0]), 32, []
        for n in head[1:7]:
            arrays.append(np.frombuffer(buffer, np.int32, int(n), at))
            at += 4 * int(n)
        self.first, byte, self.target, self.skip, self.starts, self.ids = arrays
        self.final = np.frombuffer(buffer, np.uint8, int(head[7]), at)
        # Arcs are sorted by state and byte, so one search finds an arc.
        self.arc = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first)) * 256 + byte

    @classmethod
    def mapped(cls, buffer: bytes) -> Lexicon:
        """Over a memory map of a file of this process, which goes with the process."""
        with tempfile.TemporaryFile() as f:
            f.write(buffer)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, words: list[bytes]) -> list[list[int] | None]:
        """Each word's ids, or None; the words walk side by side."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        at = np.cumsum(sizes) - sizes
        state, number = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        walking = np.arange(len(words))
        for k in range(int(sizes.max(initial=0)) if len(self.arc) else 0):
            walking = walking[sizes[walking] > k]
            due = state[walking] * 256 + flat[at[walking] + k]
            arc = np.minimum(np.searchsorted(self.arc, due), len(self.arc) - 1)
            there = self.arc[arc] == due
            state[walking[~there]] = -1
            walking, arc = walking[there], arc[there]
            number[walking] += self.skip[arc]
            state[walking] = self.target[arc]
        known = (state >= 0) & (self.final[np.maximum(state, 0)] > 0) if len(self.final) else np.zeros(len(words), bool)
        return [self.ids[self.starts[n] : self.starts[n + 1]].tolist() if k else None for k, n in zip(known, number)]


class Bpe:
    """Encodes as the tokenizer file says: added tokens, normal form, words, lexicon or merges."""

    #: In a text without other characters than these, str.lower and ``_WORDS`` do what the file's steps do.
    _PLAIN = re.compile(r"[\x1c-\x1fİ̀-\U0010ffff]")
    _OTHER_NUMBERS = "²³¹¼½¾"
    _WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_{_OTHER_NUMBERS}]+|[\d{_OTHER_NUMBERS}]|(?:[^\w\t-\r \x85\xa0]|_)+")

    def __init__(self, data: str, lexicon: bytes | None = None):
        self.data, self.steps = data, None
        parsed = json.loads(data)
        model = parsed["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        # A pair of ids is one integer; its rank says which merge it is, and that its new id.
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.wide = len(self.vocab) + 1
        self.ranks = {self.vocab[a] * self.wide + self.vocab[b]: k for k, (a, b) in reversed(list(enumerate(merges)))}
        self.merged = [self.vocab[a + b] for a, b in merges]
        self.pair = np.array(sorted(self.ranks), np.int64)
        self.pair_rank = np.array([self.ranks[p] for p in self.pair.tolist()], np.int32)
        self.added = {x["content"]: x["id"] for x in parsed["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.ones = {i: (str(i), t, 1) for i, t in self.token.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.lexicon = Lexicon.mapped(lexicon) if lexicon else None
        self.inner = [self.vocab[c] for c in self.letters]
        self.last = [self.vocab[c + self.end] for c in self.letters]
        self.chunks: dict[str, tuple[str, str, int]] = {}
        self.earlier: dict[str, tuple[str, str, int]] = {}
        self.words: dict[bytes, tuple[str, str, int]] = {}
        self.held = 0

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The words' ids by their merges, lowest rank first and leftmost among equals."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        while order and len(words[order[-1]]) > SHORT:
            k = order.pop()
            out[k] = self._merge_long(words[k])
        for at in range(0, len(order), 8192):
            some = order[at : at + 8192]
            for k, ids in zip(some, self._merge_short([words[k] for k in some])):
                out[k] = ids
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs of ids; none, where there is no such merge, or no right part (-1)."""
        key = left.astype(np.int64) * self.wide + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (right >= 0), self.pair_rank[at], len(self.merged)).astype(np.int32)

    def _merge_short(self, words: list[bytes]) -> list[list[int]]:
        """Words of like length side by side, one merge of each at a time."""
        sizes = np.array([len(w) for w in words])
        wide = int(sizes.max())
        parts = np.full((len(words), wide + 1), -1, np.int32)
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(len(words)), sizes)
        parts[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.array(self.inner, np.int32)[flat]
        parts[np.arange(len(words)), sizes - 1] = np.array(self.last, np.int32)[flat[np.cumsum(sizes) - 1]]
        merged, none = np.array([*self.merged, -1], np.int32), len(self.merged)
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        active, column = np.arange(len(words)), np.arange(wide)
        while len(active):
            at = ranks[active].argmin(1)
            least = ranks[active, at]
            going = least < none
            active, at, least = active[going], at[going], least[going]
            if not len(active):
                break
            # What stands right of the merged pair moves one place to the left.
            moved = column[None, :] + (column[None, :] > at[:, None])
            own = parts[active]
            own[:, :-1] = np.take_along_axis(own, moved, 1)
            own[:, -1] = -1
            line = np.arange(len(active))
            own[line, at] = merged[least]
            parts[active] = own
            rank = np.concatenate([ranks[active], np.full((len(active), 1), none, np.int32)], 1)
            rank = np.take_along_axis(rank, moved, 1)
            rank[line, at] = self._ranks(own[line, at], own[line, at + 1])
            back = at > 0
            rank[line[back], at[back] - 1] = self._ranks(own[line[back], at[back] - 1], own[line[back], at[back]])
            ranks[active] = rank
        return [[p for p in r if p >= 0] for r in parts.tolist()]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for one word, through a heap, in n log n steps."""
        parts = [self.inner[b] for b in word]
        parts[-1] = self.last[word[-1]]
        rank, wide, n = self.ranks.get, self.wide, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := rank(parts[k] * wide + parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j >= n or parts[j] != b:
                continue
            parts[k], parts[j] = self.merged[r], -1
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if (r := rank(parts[k] * wide + parts[j])) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[j]))
            if (i := before[k]) >= 0 and (r := rank(parts[i] * wide + parts[k])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        return [p for p in parts if p >= 0]

    def learned(self, words: list[bytes]) -> dict[bytes, tuple[str, str, int]]:
        """What the words are: by the lexicon if it has them, else by merging."""
        ids = self.lexicon.get(words) if self.lexicon else [None] * len(words)
        rest = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(rest, self.merge([words[k] for k in rest])):
            ids[k] = x
        return {w: self.known(x) for w, x in zip(words, ids)}

    def joined(self, words: list[bytes]) -> tuple[str, str, int]:
        """Of words that are remembered."""
        found = [self.words[w] for w in words]
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found])

    def plain_words(self, chunk: str) -> list[bytes]:
        """Of a lower-cased chunk of a plain text; letters alone are one word."""
        return [chunk.encode()] if chunk.isalpha() else [w.encode() for w in self._WORDS.findall(chunk)]

    def other_words(self, text: str) -> list[bytes]:
        """Of any text, by the file's own steps, which are made when they are first needed."""
        if not self.steps:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_str(self.data)
            self.steps = whole.normalizer, whole.pre_tokenizer
        normalizer, pre = self.steps
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in pre.pre_tokenize_str(normalizer.normalize_str(text))]

    def known(self, ids: list[int]) -> tuple[str, str, int]:
        if len(ids) == 1:
            return self.ones[ids[0]]
        one = [self.ones[i] for i in ids]
        return " ".join([x[0] for x in one]), " ".join([x[1] for x in one]), len(ids)

    def encode(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """(decimal ids, token texts, how many) of each text, both joined by one space."""
        pieces: list[list] = []  # of each text: known parts, lists of chunks, lists of words
        chunks, words = set(), set()
        for text in texts:
            own: list = []
            for k, piece in enumerate(self.split_added.split(text) if self.split_added else [text]):
                if k % 2:
                    own.append(self.known([self.added[piece]]))
                elif not piece:
                    continue
                elif self._PLAIN.search(piece):
                    own.append(("words", w := self.other_words(piece)))
                    words.update(w)
                else:
                    own.append(("chunks", c := piece.lower().split()))
                    chunks.update(c)
            pieces.append(own)
        if 2 * len(self.chunks) > REMEMBERED or self.held > REMEMBERED_CHARS:
            self.earlier, self.chunks, self.held = self.chunks, {}, 0
        if len(self.words) > REMEMBERED:
            self.words.clear()
        have, earlier = self.chunks, self.earlier
        new = chunks.difference(have)
        have.update((c, earlier[c]) for c in new if c in earlier)
        new.difference_update(have)
        # Most chunks are one word, which is remembered as a chunk alone.
        single = [c for c in new if c.isalpha()]
        several = {c: self.plain_words(c) for c in new.difference(single)}
        for w in several.values():
            words.update(w)
        alone = [c.encode() for c in single]
        got = self.learned([w for w in words.union(alone) if w not in self.words])
        self.words.update((w, got[w]) for w in words if w in got)
        for c, w in zip(single, alone):
            have[c] = got.get(w) or self.words[w]
        for c, ws in several.items():
            have[c] = self.joined(ws)
        self.held += sum(map(len, new))
        out = []
        for own in pieces:
            found: list[tuple[str, str, int]] = []
            for x in own:
                if x[0] == "chunks":
                    found += map(have.__getitem__, x[1])
                elif x[0] == "words":
                    found.append(self.joined(x[1]))
                else:
                    found.append(x)
            ids, tokens, n = zip(*found) if found else ((), (), ())
            if 0 in n:
                ids, tokens = ([x for x, k in zip(part, n) if k] for part in (ids, tokens))
            out.append((" ".join(ids), " ".join(tokens), sum(n)))
        return out


def frequent_chunks(docs: DataFrame, most: int = LEXICON_CHUNKS) -> list[str]:
    """The corpus's most frequent lower-cased chunks between white space, at most ``most`` short ones.

    Every text is counted whole; counts are summed in each task before they are shuffled. What a task has met once among
    hundreds of thousands of chunks is not handed on: it is not frequent there. Which words the lexicon holds changes how fast others
    are found, and no result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            again = [c for c, n in seen.items() if n > 1] or list(seen)
            return pa.RecordBatch.from_arrays([pa.array(again, pa.string()), pa.array([seen[c] for c in again], pa.int64())], schema=_COUNTS)

        for b in sliced(batches):
            for t in texts(b):
                seen.update(t.lower().split())
            if len(seen) > COUNTED:
                yield out()
                seen.clear()
        if seen:
            yield out()

    counts = docs.select("text").mapInArrow(lean(count), "chunk string, n bigint").where(F.length("chunk") <= LEXICON_WORD).groupBy("chunk").agg(F.sum("n").alias("n"))
    return [r[0] for r in frequent(checkpointed(counts), "n", most).select("chunk").collect()]


def lexicon_of(chunks: Iterable[str], data: str) -> bytes:
    """The lexicon of the chunks' words, with the ids that merging gives."""
    bpe = Bpe(data)
    words = {w for c in chunks for w in (bpe.plain_words(c) if not bpe._PLAIN.search(c) else bpe.other_words(c)) if len(w) <= LEXICON_WORD}
    order = sorted(words)
    return Lexicon.build(dict(zip(order, bpe.merge(order))))


def vocabulary(name: str = "word_bpe_49k.json", path: str | None = None) -> str:
    """The tokenizer file's content; its place is a parameter."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, data: str | None = None, lexicon: bytes | None = None, keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """keep's columns with n_tokens and outputs: ids (array), decoded, ids_sha256, decoded_sha256, for every whole text.

    As the tokenizers library's encode without special tokens and decode without skipping any. A null or
    empty text has no tokens and decodes to an empty text. Very long texts and words are encoded whole; words take
    time in proportion to n log n. Rows are independent, so repeated rows and ids, and other columns, do no
    harm; an empty table gives an empty table. The lexicon (of this corpus's frequent words, unless given) is
    of bounded size and goes to the executors as a broadcast variable; each worker maps it from a file of its own."""
    spark = docs.sparkSession
    data = data or vocabulary()
    if lexicon is None:
        lexicon = lexicon_of(frequent_chunks(docs), data)
    shared = spark.sparkContext.broadcast((data, lexicon))
    kept = docs.select(*keep).schema
    types = {"ids": "array<int>"}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        bpe = Bpe(*shared.value)
        for b in sliced(batches, "_text"):
            got = bpe.encode(texts(b, "_text"))
            columns = [b.column(k) for k in range(len(keep))] + [pa.array([x[2] for x in got], pa.int64())]
            for name in outputs:
                k = int(name.startswith("decoded"))
                if name.endswith("_sha256"):
                    columns.append(pa.array([sha256(x[k].encode()).hexdigest() for x in got]))
                elif k:
                    columns.append(pa.array([x[1] for x in got]))
                else:
                    columns.append(pa.array([np.array(x[0].split(), np.int32) for x in got], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", *outputs])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_tokens bigint"] + [f"{n} {types.get(n, 'string')}" for n in outputs])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(lean(encode), ddl)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and digests of its ids and of what they decode to."""
    return encode_documents(table(spark, sf_dir, "documents"), outputs=("ids_sha256", "decoded_sha256"))
