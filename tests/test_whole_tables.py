"""Queries that read whole tables, against brute force."""

import re

import pytest

from pagelode.plans import registry


def test_term_positions_of_all_documents(spark, tmp_path):
    rows = [(1, "One two one", 11), (2, "long_word x " * 400, 4800), (3, "no size, no", None), (4, None, 0), (5, "", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for doc_id, text, _ in rows:
        for k, word in enumerate(re.findall(r"\w+", (text or "").lower())):
            want.setdefault((doc_id, word), []).append(str(k))
    got = registry.QUERIES["term_positions"](spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    assert {(r["doc_id"], r["term"]): r["positions"].split(",") for r in got} == want


def test_pagerank_graph_of_all_lines(spark, tmp_path):
    rows = [(1, 7, 3, 1), (1, 8, 3, 2), (2000, 8, 4, 1), (2001, 9, 4, 1), (60000, 9, 3, 2)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = [(f"s{s}", f"p{p}") for _, p, s, _ in rows] + [(f"p{p}", f"s{s}") for _, p, s, n in rows if n == 1]
    nodes = sorted({x for e in edges for x in e})
    out = {v: [b for a, b in edges if a == v] for v in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(10):
        lost = sum(rank[v] for v in nodes if not out[v])
        rank = {v: (0.15 + 0.85 * lost) / len(nodes) + 0.85 * sum(rank[a] / len(out[a]) for a, b in edges if b == v) for v in nodes}
    got = {r["doc_id"]: r["rank"] for r in registry.QUERIES["pagerank_graph"](spark, str(tmp_path)).collect()}
    assert got == {v: pytest.approx(x, abs=1e-9) for v, x in rank.items()}
