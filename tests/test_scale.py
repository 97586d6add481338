"""What holds however large the tables are: ties, work in rows, and steps that read their input once."""

import re

import pytest
from pyspark.sql import functions as F

from pagelode.operators import graph, pagerank, search
from pagelode.operators import index as ix
from pagelode.operators.index import Index


def test_equal_documents_tie_in_any_order(spark):
    """Floating sums of the same parts differ by their order; ranks of such documents would not be by doc_id."""
    parts = [0.1, 0.2, 0.3, 7.7, 1e-9, 11.3, 0.7, 1 / 3]
    rows = [(f"t{t}", f"d{k}", parts[(t * step + k) % 8], 0.0) for k in range(8) for step in (1 + 2 * (k % 4),) for t in range(8)]
    impacts = spark.createDataFrame(rows, "term string, doc_id string, part double, pagerank double")
    asked = spark.createDataFrame([(1, [f"t{t}" for t in range(8)])], "query_id int, terms array<string>")
    got = search.results_of_many(Index(impacts, impacts, impacts, impacts), asked, 8).collect()
    assert len({r["bm25"] for r in got}) == 1 and abs(got[0]["bm25"] - sum(parts)) < 1e-12
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == [f"d{k}" for k in range(8)]


def _moved(frame) -> list[str]:
    """Keys of a plan's exchanges."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", frame._jdf.queryExecution().executedPlan().toString())


def test_postings_are_made_within_rows(spark):
    """No token is shuffled: positions, postings and counts of a page or text need no exchange at all."""
    rows = [("a", "http://x/one", "One title", "words and words of one page", []), ("b", "http://x/two", None, None, None), ("c", "", "", "", [])]
    pages = spark.createDataFrame(rows, "doc_id string, url string, title string, text string, headings array<struct<tag:string,text:string>>")
    plain = ix.postings(ix.tokens(ix.fields_of_pages(pages)))
    mine = Index.of_pages(pages)
    assert _moved(plain) and not _moved(mine.postings) and not _moved(ix.counts_of_pages(pages)) and not _moved(mine.docs)
    show = lambda f, *c: sorted(map(str, f.select(*c).collect()))
    columns = ("term", "doc_id", "freq", "positions", "fields")
    assert show(mine.postings, *columns) == show(plain, *columns)
    assert show(mine.df, "term", "df") == show(ix.document_frequencies(plain), "term", "df")
    assert show(ix.counts_of_pages(pages), "doc_id", "term", "n") == show(ix.tokens(ix.fields_of_pages(pages)).groupBy("doc_id", "term").agg(F.count("*").alias("n")), "doc_id", "term", "n")
    assert show(mine.docs, "doc_id", "length") == show(ix.lengths(ix.fields_of_pages(pages)), "doc_id", "length")


def test_texts_are_counted_within_rows(spark):
    texts = [(1, "One running two runs one"), (2, ""), (3, None), (4, "two"), (None, "alone")]
    once = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert not _moved(graph.term_positions(once)) and len(_moved(ix.document_frequencies_of_texts(once))) == 1
    for rows in (texts, [*texts, (1, "two one"), (None, "alone again")]):
        frame = spark.createDataFrame(rows, "doc_id bigint, text string")
        want = ix.document_frequencies(ix.frequencies(ix.tokens(ix.fields_of_texts(frame))))
        assert sorted(map(tuple, ix.document_frequencies_of_texts(frame).collect())) == sorted(map(tuple, want.collect()))
        places = {}
        for doc_id, text in rows:
            for k, word in enumerate((text or "").lower().split()):
                places.setdefault((doc_id, word), []).append(k)
        assert {(r["doc_id"], r["term"]): r["positions"] for r in graph.term_positions(frame).collect()} == {k: sorted(v) for k, v in places.items()}


def test_ranks_read_their_edges_once(spark):
    """Edges may be parsed from pages: they are read once, and ranks with a fixed number of steps are those of brute force."""
    read = spark.sparkContext.accumulator(0)
    edges = [("a", "b"), ("a", "b"), ("a", "x"), ("b", "a"), ("b", "y"), *[("a", f"z{k}") for k in range(9)]]

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    frame = spark.createDataFrame(edges, "src string, dst string").mapInPandas(counted, "src string, dst string")
    nodes = sorted({v for e in edges for v in e})
    out = {v: [b for a, b in edges if a == v] for v in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(3):
        lost = sum(rank[v] for v in nodes if not out[v])
        rank = {v: (0.15 + 0.85 * lost) / len(nodes) + 0.85 * sum(rank[a] / len(out[a]) for a, b in edges if b == v) for v in nodes}
    got = {r["doc_id"]: r["rank"] for r in pagerank.pagerank(frame, iterations=3).collect()}
    assert got == {v: pytest.approx(x, abs=1e-12) for v, x in rank.items()}
    assert read.value == len(edges)
