"""Small fixtures for near duplicates, mixing, vectors, components and the pipeline, against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from pagelode.llm import embdedup, graph, linedup, minhash, mixing, topk
from pagelode.llm.hashes import shingle_sets


def _components(ids, linked):
    """The smallest id reachable from each place."""
    low, changed = list(ids), True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(7, 7), (900, 0)] * 2
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in graph.connected_components(frame).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {n: k for k, n in enumerate(nodes)}
    low = _components(nodes, [(at[a], at[b]) for a, b in edges if a != b])
    assert got == dict(zip(nodes, low))
    assert graph.connected_components(frame.limit(0)).count() == 0


# Near duplicates


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**64, 4000, np.uint64)
        cut = int(4000 * share)
        rest = (4000 - cut) // 2
        a, b = np.sort(both[: cut + rest]), np.sort(np.concatenate([both[:cut], both[cut + rest :]]))
        r = minhash.registers([a, b], 2000)
        got = minhash.estimated(np.array([(r[0] == r[1]).sum()]), 2000, np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert got == pytest.approx(share, abs=0.05)


def test_expected_collisions_match_chance():
    rng = np.random.default_rng(1)
    r = minhash.registers([rng.integers(0, 2**64, n, np.uint64) for n in (300, 500)], 200_000)
    want = minhash.expected_collisions(np.array([300.0]), np.array([500.0]))[0]
    assert (r[0] == r[1]).mean() == pytest.approx(want, abs=4e-4)


def _sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def _groups(ids, sets, num):
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return _components(ids, linked)


@pytest.mark.parametrize("words, num", [(3, 85), (5, 80)])
def test_near_duplicates_by_brute_force(spark, words, num):
    rng = random.Random(words)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 8, 30, 120]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += ["", "  ", "One", "one", "ONE two", "y" * 5000, "Größe und mehr", texts[0].upper().replace(" ", "\n\t")]
    # A large group of near copies, over several blocks.
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts += [" ".join(base[:k] + ["new"] + base[k:] + [f"tail{k}"]) for k in range(90)]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    sets = _sets(texts, words)
    want = _groups(ids, sets, num)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], "doc_id bigint, text string, cls string, n int")
    block, minhash.BLOCK, verify, minhash.VERIFY_BLOCK = minhash.BLOCK, 16, minhash.VERIFY_BLOCK, 16
    try:
        got = {r["doc_id"]: r for r in minhash.near_duplicates(frame, words=words, num=num).collect()}
    finally:
        minhash.BLOCK, minhash.VERIFY_BLOCK = block, verify
    assert len(got) == len(ids)
    for i, s, w in zip(ids, sets, want):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), w, i == w)


def test_near_duplicates_edges(spark):
    rows = [(1, None), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (4, "other text here"), (2, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minhash.near_duplicates(docs, words=3).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 1, True), (None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (4, 1, 4, True), (2, 0, 2, True), (None, 0, None, True)], key=str)
    kept = minhash.without_near_duplicates(docs, words=3)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, None), (4, "a b c d"), (4, "other text here"), (2, ""), (None, None)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_shingles_of_a_batch_equal_those_of_each_text():
    texts = ["a b c d", "", "one", "x y", "Ä ö ü ß é", "a b c d"]
    for k in (1, 3, 5):
        for whole, t in zip(shingle_sets(texts, k), texts):
            assert np.array_equal(whole, shingle_sets([t], k)[0])
            assert len(whole) == len(_sets([t], k)[0])


# Mixing


def _targets(sizes, weights=(5, 2, 1), most=3):
    """Sources' targets by repeated sharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {s: 0.0 for s in names}, set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def _mix_rows():
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.choice([1, 2, 5, 40])), rng.choice(["a", "a", "a", "b", "ü", None]), k) for k in range(600)]
    return [*rows, (1000, None, "a", 0), (1001, " \n", "empty", 0), (None, "one two", "b", 0), (5, "w w", "z", 0), (5, "w w", "z", 0), (1002, "w " * 5000, "big", 0)]


def test_mixing(spark):
    rows = _mix_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    got = mixing.mix_sources(docs, fan_in=16).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = (r["target"], r["source_size"])
    for s, want in _targets(sizes).items():
        assert targets[s] == (pytest.approx(want), sizes[s])
        assert abs(taken[s] - want) <= 2
    again = mixing.mix_sources(docs.repartition(7), fan_in=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    # At most one document a source is cut.
    cut = [r["source"] for r in got if r["size"] and r["taken"] % r["size"]]
    assert len([s for s in cut if s != "z"]) == len({s for s in cut if s != "z"})
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_is_unbiased(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 7), "a" if k % 3 else "b") for k in range(60)], "doc_id bigint, text string, source string")
    plan = mixing.mix_plan(docs, fan_in=8, seed=1).select("doc_id", "size", "source_size", "target", "taken")
    total = {r["doc_id"]: [r["taken"], r["size"] * r["target"] / r["source_size"], r["size"]] for r in plan.collect()}
    for seed in range(2, 14):
        for r in mixing.mix_plan(docs, fan_in=8, seed=seed).collect():
            total[r["doc_id"]][0] += r["taken"]
    deviation = [(t / 13 - want) / size for t, want, size in total.values()]
    assert abs(np.mean(deviation)) < 0.1 and np.abs(deviation).max() < 0.6


def test_mixture_rows(spark):
    rows = _mix_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["source"]] += len(r["text"].split())
    plan = defaultdict(int)
    for r in mixing.mix_sources(docs).collect():
        plan[r["source"]] += r["taken"]
    assert dict(words) == {s: n for s, n in plan.items() if n}


# Vectors


def _vectors():
    rng = np.random.default_rng(2)
    rows = [rng.standard_normal(8) for _ in range(150)]
    rows += [r + 0.02 * rng.standard_normal(8) for r in rows[:20]] + [rows[0]] * 30 + [3 * rows[1]]
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(rows)]
    bad = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None]), (904, [float("inf")] * 8), (905, []), (906, [1e300, 2.0]), (None, [1.0] * 8), (920, None)]
    return rows + bad


def test_top_k_by_brute_force(spark):
    rows = [r for r in _vectors() if r[0] != 906]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, score int")
    block, topk.ROWS, queries, topk.QUERIES = topk.ROWS, 32, topk.QUERIES, 4
    try:
        got = topk.top_k(frame, frame.where("vec_id % 20 = 0"), 7).collect()
    finally:
        topk.ROWS, topk.QUERIES = block, queries
    fine = [(k, [int(np.floor(64 * x)) for x in v]) for k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, a in fine:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), k) for k, b in fine if k != q)
            want |= {(q, n + 1, k, -s) for n, (s, k) in enumerate(scored[:7])}
    assert {tuple(r) for r in got} == want
    few = frame.where("vec_id in (0, 3, 901)")
    assert topk.top_k(few, few.where("vec_id = 0"), 20).count() == 2
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_huge_components(spark):
    frame = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 2.0]), (2, [-1e15, 2.0]), (3, [5.0, 1e300])], "vec_id bigint, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in topk.top_k(frame, frame.where("vec_id = 0"), 3).orderBy("rank").collect()]
    assert [v for _, v in got][-1] == 2 and len(got) == 3


def test_near_vectors_by_brute_force(spark):
    rows = [*_vectors(), (0, _vectors()[0][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, n int")
    block, embdedup.BLOCK = embdedup.BLOCK, 8
    try:
        got = sorted(embdedup.near_vectors(frame).collect(), key=str)
    finally:
        embdedup.BLOCK = block
    fine = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = []
    for x in fine:
        for y in fine:
            if y < x:
                a, b = (np.array([*rows[k][1], *[0.0] * 8][:8]) / np.abs(rows[k][1]).max() for k in (x, y))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                    linked.append((x, y))
    ids = [r[0] if r[0] is not None else 10**9 for r in rows]
    low = _components(ids, linked)
    degree = [0] * len(rows)
    for x, y in linked:
        degree[x] += 1
        degree[y] += 1
    want = sorted(((i, degree[k], c if c != 10**9 else None, i == (c if c != 10**9 else None)) for k, ((i, _), c) in enumerate(zip(rows, low))), key=str)
    assert sorted([tuple(r) for r in got], key=str) == want
    assert embdedup.near_vectors(frame.limit(0)).count() == 0


def test_tables_keep_recall():
    for n in (100, 10**5, 10**9):
        bits, tables = embdedup.tables_for(n, 0.95)
        same = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - same) ** tables <= embdedup.MISS


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    passage = " ".join(f"passage{k}" for k in range(60))
    extra = spark.createDataFrame([(10**6, "1234 5678", "en", "src0", 9), (10**6 + 1, None, "en", None, 0), (10**6 + 2, f"The and of {passage} with that", "en", "src1", 0), (10**6 + 3, f"this is {passage}", "en", "src1", 0)], docs.schema)
    at = docs.unionByName(extra)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, "/root/testdata/sf0.001")
        if name != "tokens":
            assert at.columns == docs.columns
        seen[name] = at = at.cache()
    ids = lambda f: {r[0] for r in f.select("doc_id").collect()}
    assert ids(seen["language"]) == ids(docs) | {10**6 + 2, 10**6 + 3}
    groups = minhash.near_duplicates(seen["language"]).where("kept")
    assert ids(seen["near_duplicates"]) == ids(groups)
    texts = {r["doc_id"]: r["text"] for r in seen["substrings"].collect()}
    assert passage in texts[10**6 + 2] and passage not in texts.get(10**6 + 3, "")
    assert linedup.repeated_spans(seen["substrings"]).count() <= linedup.repeated_spans(seen["near_duplicates"]).count()
    assert ids(seen["mix"]) <= ids(seen["substrings"])
    rows = seen["tokens"].collect()
    assert len(rows) == seen["mix"].count() and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == seen["tokens"].columns
