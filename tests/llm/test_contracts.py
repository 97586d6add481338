"""Cases that once went wrong or that no other test holds: clashing ids and columns, exact scores, executors without the package."""

import itertools
import math
import os
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from pagelode.llm import embdedup, hmm, langid, licenses, linedup, minhash, mixing, topk
from pagelode.llm.common import maybe_among, unused, words

ROOT = Path(__file__).resolve().parents[2]
PASSAGE = " ".join(f"common{k}" for k in range(60))


def test_shared_ids_lose_no_unique_text(spark):
    own = [" ".join(f"own{n}x{k}" for k in range(50)) for n in range(3)]
    rows = [(7, f"{own[0]} {PASSAGE}"), (7, f"{own[1]}\n{PASSAGE}"), (8, f"{PASSAGE}\n{own[2]}"), (None, own[0]), (8, f"{PASSAGE}\n{own[2]}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["kept_text"].strip()) for r in linedup.dedup_passages(docs, whole_lines=True).collect())
    texts = [t for _, t in got.elements()]
    for o in own[1:]:
        assert sum(o in t for t in texts) >= 1
    assert got[None, own[0]] == 1  # the null id ranks first and keeps what it has
    assert sum(t.count("common30") for t in texts) <= 3 and any(PASSAGE in t for t in texts)


def test_repeats_are_told_by_their_words_alone(spark, duck):
    """Each removed span is made of pieces that the texts before it, or the text before it, have."""
    docs = spark.createDataFrame(duck.execute("SELECT doc_id, text FROM documents").fetchdf())
    spans = {r["doc_id"]: r["spans"] for r in linedup.repeated_spans(docs, whole_lines=True).collect()}
    pairs: set = set()
    for doc_id, text in duck.execute("SELECT doc_id, text FROM documents ORDER BY 1").fetchall():
        cuts = spans.get(doc_id, [])
        for s in cuts:
            own = words(text[s["start"] : s["stop"]])
            before = words(text[: s["start"]])
            seen = pairs | set(zip(before, before[1:])) | {(w, b"") for w in before} | set(zip(own, own[1:]))
            assert len(own) == s["words"]
            # Nearly all neighbouring words stood together before; cuts may join units that did not.
            again = sum(p in pairs or p in seen for p in zip(own, own[1:]))
            assert again >= 0.8 * (len(own) - 1)
        w = words(text)
        pairs |= set(zip(w, w[1:]))


@pytest.mark.parametrize("length", [51, 60, 90])
def test_long_passages_are_found_wherever_they_stand(spark, length):
    rows, at = [], np.random.default_rng(length)
    for k in range(24):
        filler = [f"f{k}x{n}" for n in range(80)]
        cut = int(at.integers(0, 80))
        passage = [f"p{k // 2}x{n}" for n in range(length)]
        rows.append((k, " ".join(filler[:cut] + passage + filler[cut:])))
    got = {r["doc_id"]: sum(s["words"] for s in r["spans"]) for r in linedup.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got) == set(range(1, 24, 2))
    assert all(length - 2 * linedup.WINDOW <= n <= length for n in got.values())


CLASHING = "doc_id bigint, text string, source string, lang string, row string, _row string, _doc int, key int, text_hash int, words int, _words int, size int, taken int, target int, own_size int, spans int, kept_text int, _hash int, n int, cls int, doc int, holder int, due int, copy int, extra int"


def test_clashing_columns(spark):
    rows = [(k, f"{PASSAGE} tail{k}" if k < 4 else f"alone{k} " * 9, "ab"[k % 2], "en", f"r{k}", f"q{k}", *range(19)) for k in range(9)]
    docs = spark.createDataFrame(rows, CLASHING)
    for name, out in (("near", minhash.without_near_duplicates(docs)), ("mixture", mixing.mixture(docs))):
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert tuple(r)[2:] == rows[r["doc_id"]][2:], name
    assert {r["doc_id"] for r in minhash.without_near_duplicates(docs).collect()} == {0, 4, 5, 6, 7, 8}
    out = linedup.dedup_passages(docs)
    assert set(out.columns) == set(docs.columns) and out.count() == 9
    assert {r["doc_id"]: r["row"] for r in out.collect()} == {r[0]: r[4] for r in rows}
    assert mixing.mix_sources(docs).count() == 9
    assert unused(["row", "_Row", "x"], "row") == "__row"


def test_one_row_of_equal_ids_and_texts_in_a_fixed_order(spark):
    rows = [(5, "one two three four five six", c) for c in "dbca"] + [(6, "alone in here", "z"), (6, "alone in here", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for n in (1, 3):
        assert sorted(map(tuple, minhash.without_near_duplicates(docs.repartition(n)).collect())) == [(5, rows[0][1], "a"), (6, "alone in here", "y")]


def test_null_ids_meet_by_text(spark):
    """Many rows and many classes without an id: each text meets its own class alone."""
    base = [" ".join(f"w{c}x{k}" for k in range(30)) for c in range(30)]
    rows = [(None, b) for b in base] + [(None, b + " end") for b in base] + [(9, base[0] + " end")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=3, num=85).collect()
    assert len(got) == 61 and Counter(r["component_id"] for r in got) == {None: 58, 9: 3}


def test_maybe_among(spark):
    keys = spark.range(0, 3000, 3).selectExpr("xxhash64(id) AS k")
    test = maybe_among(keys)
    some = spark.range(6000).selectExpr("id", "xxhash64(id) AS k").where(test("k")).select("id")
    ids = {r[0] for r in some.collect()}
    assert set(range(0, 3000, 3)) <= ids and len(ids) < 1010
    nothing = maybe_among(keys.limit(0))
    assert spark.range(9).selectExpr("xxhash64(id) AS k").where(nothing("k")).count() == 0


def test_repeated_rows_of_a_mix_lose_no_word(spark, tmp_path):
    rows = [(1, "w " * 10, "a")] * 7 + [(2, "w w w", "b")] * 5 + [(k, "w " * k, "c") for k in range(3, 30)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op5_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    sums = defaultdict(int)
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        sums[r["target"]] += r["taken"]
    assert all(abs(t - n) <= 1 for t, n in sums.items())


def test_many_sources(spark):
    """Targets by the contract's own process, over more sources than a range has."""
    rng = np.random.default_rng(3)
    sizes = {f"s{k:03}": int(rng.integers(1, 4000) if k % 3 else rng.integers(1, 9)) for k in range(200)} | {None: 50}
    docs = spark.createDataFrame([(k, "w " * n, s) for k, (s, n) in enumerate(sizes.items())], "doc_id bigint, text string, source string")
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, still, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-6:
        level = left / sum(weight[s] for s in still)
        left = 0.0
        for s in list(still):
            target[s] += level * weight[s]
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                still.discard(s)
    got = {r["source"]: r["target"] for r in mixing.mix_plan(docs).collect()}
    assert got == {s: pytest.approx(t, rel=1e-9) for s, t in target.items()}


def test_scores_near_the_end_of_longs(spark):
    rows = [(0, [2.0**25, 2.0**25]), (1, [2.0**24 * 1.5, 2.0**24]), (2, [2.0**24 * 1.5, 2.0**24 + 1 / 64]), (3, [2.0**24, 2.0**24]), (4, [2.0**40, 0.0]), (5, [2.0**41, 0.0]), (6, [-(2.0**60), 0.0]), (7, [-(2.0**24), -(2.0**24)])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = {k: [math.floor(64 * x) for x in v] for k, v in rows}
    score = {k: sum(a * b for a, b in zip(whole[0], v)) for k, v in whole.items() if k}
    assert sum(2**60 < s < 2**63 for s in score.values()) >= 3
    held = {k: min(max(s, -(2**63)), 2**63 - 1) for k, s in score.items()}
    got = topk.top_k(frame, frame.where("vec_id = 0"), 7).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == sorted(held.items(), key=lambda x: (-x[1], x[0]))


def test_few_blocks_and_ties_at_the_cutoff(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 4) / 64]) for k in range(700)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(9)
    held, topk.ROWS, at, topk.AT_ONCE = topk.ROWS, 16, topk.AT_ONCE, 5
    try:
        got = topk.top_k(frame, frame.where("vec_id % 20 = 0"), 6).collect()
    finally:
        topk.ROWS, topk.AT_ONCE = held, at
    whole = {k: np.floor(64 * np.array(v)).astype(int) for k, v in rows}
    want = {(q, n + 1, k, -s) for q in range(0, 700, 20) for n, (s, k) in enumerate(sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q)[:6])}
    assert {tuple(r) for r in got} == want


def test_signs_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    apart = embdedup.signs_apart(0.95)
    a = rng.standard_normal((20000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    planes = rng.standard_normal((32, embdedup.SIGNS))
    assert (((a @ planes > 0) != (b @ planes > 0)).sum(1) <= apart).mean() > 0.9998


def test_large_groups_of_vectors(spark):
    """A group in many blocks, and as many copies of one vector, against brute force."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    rows = [centre + 0.12 * rng.standard_normal(16) for _ in range(200)] + [rng.standard_normal(16) for _ in range(100)] + [np.ones(16)] * 100
    frame = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    held, embdedup.BLOCK = embdedup.BLOCK, 16
    try:
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embdedup.near_vectors(frame).collect()}
    finally:
        embdedup.BLOCK = held
    m = np.stack(rows)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = m @ m.T >= 0.95
    np.fill_diagonal(linked, False)
    low = np.arange(len(rows))
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], len(rows)).min(1))
        if (new == low).all():
            break
        low = new
    assert got == {k: (int(linked[k].sum()), int(low[k]), k == low[k]) for k in range(len(rows))}


def test_many_languages_and_a_dominant_one(spark):
    """Every label is learnt, more than 64 of them, though one has most rows."""
    rows = [(f"xx{k}", " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + n % 7)}q" for n in range(j, j + 20))) for k in range(70) for j in range(4)]
    rows += [("en", f"the words of this {n} are the same as the others of the lot {n % 13}") for n in range(900)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = langid.learn(docs, sample=400, of_each=4)
    assert len(model.languages) == 71
    got = langid.identify(docs, model, keep=("lang",)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.97 * len(got)


def test_score_by_brute_force(spark):
    """The forward recursion over symbols, and each class token's share of its class; long and frequent tokens too."""
    long = "z" * 90
    rows = [(k, t) for k, t in enumerate([f"{long} a b", f"a a {long} c", "b d e f g h", f"{long} {long}", "", None, "A B"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model, counts = hmm.train(docs, rounds=2, head=2, states=2)
    assert any(t.startswith(b"  ") for t in model.number)  # the long token is among the frequent ones
    c = Counter(t for _, x in rows for t in hmm._tokens(x or ""))
    got = {r["doc_id"]: r for r in hmm.score_documents(docs, model, counts).collect()}
    for doc_id, text in rows:
        tokens = hmm._tokens(text or "")
        s = model.symbols(tokens)
        total = sum(model.start[p[0]] * model.emit[s[0], p[0]] * math.prod(float(model.move[x, y] * model.emit[o, y]) for x, y, o in zip(p, p[1:], s[1:])) for p in itertools.product(range(2), repeat=len(s)))
        share = sum(math.log10((c[t] + 0.1) / model.class_totals[hmm._class_of(t)]) for t in tokens if t not in model.number)
        assert got[doc_id]["score"] == pytest.approx(math.log10(total) + share, rel=1e-4)
        assert got[doc_id]["n_tokens"] == len(words(text or "")) + 1


def test_very_many_licence_findings():
    text = "released under the MIT license " * 20000
    got = licenses.Scanner().scan(text)
    assert got[:5] == (100000, 20000, 3, 99998, "mit") and len(got[7]) == 20000


def test_executors_without_the_package(tmp_path):
    """Workers get code and models by value: the driver alone has the package on its path."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "ck")!r}).getOrCreate()
from pagelode.llm import hmm, langid, linedup, minhash, topk, embdedup, bpe, licenses
docs = spark.createDataFrame([(k, t, l) for k, (t, l) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 4)], "doc_id bigint, text string, lang string")
assert langid.identify(docs, langid.learn(docs)).count() == 8
assert langid.accepted(docs, langid.learn(docs)).count() == 8
assert hmm.score_documents(docs, *hmm.train(docs, rounds=1, states=2)).count() == 8
assert minhash.without_near_duplicates(docs).count() == 2
assert linedup.dedup_passages(docs, whole_lines=True).count() == 8
assert licenses.scan_licenses(docs).count() == 8
assert bpe.encode_documents(docs).count() == 8
vectors = spark.createDataFrame([(k, [1.0 * k, 2.0]) for k in range(5)], "vec_id bigint, embedding array<double>")
assert topk.top_k(vectors, vectors, 2).count() == 10 and embdedup.near_vectors(vectors).count() == 5
print("all done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all done" in done.stdout, done.stderr[-3000:]
