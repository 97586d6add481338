"""Index, ranking, link analysis, search, frontier and sources on small tables."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from pagelode.config import Config, Scope
from pagelode.operators import frontier, pagerank, ranking, search, spell
from pagelode.operators.index import Index, index_stats
from pagelode.sources import pages as src
from pagelode.sources import robots
from pagelode.streaming import frontier as stream

HTML = "<html><head><title>{0}</title></head><body><p>{1}</p>{2}</body></html>"


def _link(*to):
    return "".join(f'<a href="{t}">{t}</a>' for t in to)


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (1, "http://a.example.org/", HTML.format("Routing", "routers route packets", _link("/b", "/c", "/b"))),
        (2, "http://a.example.org/b", HTML.format("Bridges", "packets cross bridges and routers", _link("/"))),
        (3, "http://a.example.org/c", HTML.format("Empty", "", _link("/b", "http://other.example.com/"))),
        (4, "http://a.example.org/c#part", HTML.format("Later", "the later copy wins", "")),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


@pytest.fixture(scope="module")
def index(raw):
    i = Index.of_pages(src.parsed(raw))
    return Index(i.postings.cache(), i.docs.cache(), i.df.cache())


def test_unique_pages(raw):
    assert sorted(r["page_id"] for r in src.unique_pages(raw).collect()) == [1, 2, 4]


def test_links(raw):
    assert sorted((r["to_url"], r["anchor_text"]) for r in src.links(raw).collect()) == sorted([("http://a.example.org/b", "/b"), ("http://a.example.org/c", "/c"), ("http://a.example.org/", "/")])


def test_title_counts_twice(index):
    row = index.postings.where("term = 'bridg' or term = 'bridges' or term = 'bridge'").collect()
    assert [(r["freq"], r["fields"]) for r in row] == [(9.0, ["body", "headings", "title"])]
    stats = index_stats(index.postings, index.docs).first()
    assert stats["total_docs"] == 3 and stats["total_postings"] == index.df.agg(F.sum("df")).first()[0]


def test_bm25_by_hand(index):
    n, avgdl = index.docs.agg(F.count("*"), F.avg("length")).first()
    got = {r["doc_id"]: r["bm25"] for r in ranking.bm25(index, ["packet", "nothing"]).collect()}
    rows = index.postings.where("term = 'packet'").join(index.docs, "doc_id").collect()
    idf = math.log((n - len(rows) + 0.5) / (len(rows) + 0.5) + 1)
    assert got == {r["doc_id"]: pytest.approx(idf * r["freq"] * 2.5 / (r["freq"] + 1.5 * (0.25 + 0.75 * r["length"] / avgdl))) for r in rows}
    assert ranking.match_count(index, ["packet", "nothing"]).first()[0] == 0
    assert ranking.match_count(index, ["packet", "router"]).first()[0] >= 0


def test_explain_adds_up(index):
    doc = ranking.bm25(index, ["packet", "rout"]).orderBy(F.desc("bm25")).first()
    rows = ranking.explain(index, doc["doc_id"], ["packet", "rout", "zzz"]).collect()
    assert len(rows) == 3 and sum(r["contribution"] for r in rows) == pytest.approx(doc["bm25"], abs=2e-4)
    assert [r["df"] for r in rows if r["term"] == "zzz"] == [None]


def test_search_facade(index):
    answer = search.search(index, "packets", limit=1)
    assert len(answer["results"]) == 1 and answer["total"] == 2 and answer["page"] == 1
    assert search.search(None, "x")["error"] and search.search(index, "  ")["results"] == []
    pages = [r["doc_id"] for o in (0, 1) for r in search.search(index, "packets", limit=1, offset=o)["results"]]
    assert len(set(pages)) == 2
    fixed = search.search(index, "pakcet")
    assert fixed["corrections"] == [("pakcet", "packet")] and fixed["total"] == 2


def test_search_plan_takes_a_page(index):
    plan = ranking.ranked(index, ["packet"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "Arrow" not in plan


def test_incremental_index(raw, index):
    pages = src.parsed(raw)
    part = Index.of_pages(pages.where("title <> 'Routing'"))
    grown = part.with_pages(pages.where("title = 'Routing'"))
    rows = lambda i: sorted(map(str, i.postings.select("term", "doc_id", "freq", "positions", "fields").collect()))
    assert rows(grown) == rows(index)


def test_index_round_trip(spark, index):
    index.save(spark, buckets=2)
    loaded = Index.load(spark)
    assert loaded.postings.count() == index.postings.count()
    assert Index.load(spark, "default") is not None


def _power(edges, nodes, d=0.85, steps=200):
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(steps):
        lost = sum(r for n, r in rank.items() if not out[n])
        new = dict.fromkeys(nodes, (1 - d) / len(nodes) + d * lost / len(nodes))
        for n, targets in out.items():
            for t in targets:
                new[t] += d * rank[n] / len(targets)
        rank = new
    return rank


def test_pagerank(spark):
    edges = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "a"), ("c", "c"), ("d", "e")]
    frame = spark.createDataFrame([*edges, ("a", None)], "src string, dst string")
    nodes = spark.createDataFrame([("f",), (None,)], "doc_id string")
    got = {r["doc_id"]: r["rank"] for r in pagerank.pagerank(frame, nodes).collect()}
    want = _power(edges, list("abcdef"))
    assert sum(got.values()) == pytest.approx(1) and got == {n: pytest.approx(r, abs=1e-5) for n, r in want.items()}
    assert pagerank.pagerank(frame.limit(0)).count() == 0


def test_spelling(spark):
    known = spell.dictionary(spark.createDataFrame([("packet", 3), ("pocket", 3), ("router", 1), ("ab1", 1)], "term string, df bigint"))
    words = spark.createDataFrame([("pcket",), ("ROUTER",), ("ruotre",), ("zzzzzz",), (None,)], "word string")
    assert {r["word"]: r["corrected"] for r in spell.correct(words, known).collect()} == {"pcket": "packet", "router": "router", "ruotre": "router", "zzzzzz": "zzzzzz"}
    assert [r["term"] for r in spell.suggest(words.where("word = 'pcket'"), known).orderBy("rank").collect()] == ["packet", "pocket"]
    asked = spark.createDataFrame([(1, "pcket, pcket of Ruotre")], "query_id int, query string")
    assert spell.correct_queries(asked, known).first()["corrected"] == "packet, packet of router"


NOW = datetime.datetime(2024, 1, 1)


def _empty_queue(spark):
    return spark.createDataFrame([], "url string, doc_id string, domain string, depth int, priority int, status string, retries int, last_attempt_at timestamp, created_at timestamp, next_attempt_at timestamp")


def test_frontier(spark):
    found = spark.createDataFrame([(f"http://h{k % 2}.example.org/{k}", k % 3) for k in range(10)] + [("http://elsewhere.com/", 0), ("nonsense", 0)], "url string, depth int")
    queue = frontier.enqueue(_empty_queue(spark), found, F.lit(NOW))
    assert queue.count() == 10 and frontier.enqueue(queue, found, F.lit(NOW)).count() == 10
    chosen = frontier.round_of(queue, F.lit(NOW)).cache()
    assert {r["domain"]: r["n"] for r in chosen.groupBy("domain").agg(F.count("*").alias("n")).collect()} == {"h0.example.org": 3, "h1.example.org": 3}
    going = frontier.started(queue, chosen, F.lit(NOW))
    assert frontier.round_of(going, F.lit(NOW)).count() == 0
    outcomes = chosen.select("url", F.lit(False).alias("ok"), F.lit(True).alias("retry"))
    after = frontier.finished(going, outcomes, F.lit(NOW))
    row = after.where("retries = 1").first()
    assert row["status"] == "pending" and row["next_attempt_at"] == NOW + datetime.timedelta(seconds=300)
    assert {r["status"]: r["n"] for r in frontier.status_counts(after).collect()} == {"pending": 10}


def test_crawl_rounds(spark):
    site = {"http://a.example.org/": ("/x", "/y"), "http://a.example.org/x": ("/z",), "http://a.example.org/y": (), "http://a.example.org/z": ("/",)}
    table = spark.createDataFrame([(u, HTML.format(u, "t", _link(*to))) for u, to in site.items()], "url string, html string")

    def fetched(chosen):
        return chosen.select("url", "depth").join(table, "url").withColumns({"status_code": F.lit(200), "content_type": F.lit("text/html")})

    queue = frontier.enqueue(_empty_queue(spark), spark.createDataFrame([("http://a.example.org/", 0)], "url string, depth int"), F.lit(NOW), priority=1)
    queue, seen = stream.crawl(queue, fetched, lambda k: F.lit(NOW + datetime.timedelta(seconds=10 * k)), 5)
    assert {r["url"] for r in seen.collect()} == set(site)
    assert {r["status"] for r in queue.collect()} == {"completed"}


def test_upserts(spark):
    old = spark.createDataFrame([("u1", "old", NOW, 0.5, True)], "url string, title string, created_at timestamp, pagerank double, is_indexed boolean").withColumn("updated_at", F.col("created_at"))
    new = spark.createDataFrame([("u1", "new"), ("u2", "other")], "url string, title string")
    later = NOW + datetime.timedelta(days=1)
    got = {r["url"]: r for r in src.upsert_pages(old, new, F.lit(later)).collect()}
    assert (got["u1"]["title"], got["u1"]["created_at"], got["u1"]["pagerank"], got["u1"]["is_indexed"]) == ("new", NOW, 0.0, False)
    assert got["u2"]["created_at"] == later
    links = spark.createDataFrame([("a", "u"), ("a", "u"), ("a", "v")], "from_doc_id string, to_url string")
    assert src.add_links(links.limit(1), links).count() == 2


def test_robots(spark):
    rules = spark.createDataFrame([("a.example.org", "User-agent: *\nDisallow: /no\nCrawl-delay: 4")], "domain string, rules string")
    rows = spark.createDataFrame([("http://a.example.org/no/x",), ("http://a.example.org/yes",), ("http://b.example.org/no",)], "url string")
    assert sorted(r[0] for r in robots.allowed(rows, rules).collect()) == ["http://a.example.org/yes", "http://b.example.org/no"]
    assert robots.crawl_delays(rules).first()["delay_seconds"] == 4.0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(f"http://a.example.org/{k % 4}", NOW) for k in range(8)], "url string, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    fresh = stream.unseen(read, Config(scope=Scope()))
    spaced = stream.polite(fresh.withColumn("domain", F.lit("a.example.org")))
    run = spaced.writeStream.format("memory").queryName("visits").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    at = sorted(r["at"] for r in spark.table("visits").collect())
    assert len(at) == 4 and all((b - a).total_seconds() == pytest.approx(1 / 3, abs=1e-3) for a, b in zip(at, at[1:]))


def test_polite_with_a_watermark(spark, tmp_path):
    later = NOW + datetime.timedelta(days=1)
    for k, ts in enumerate((NOW, later, later)):
        spark.createDataFrame([(f"http://a.example.org/{k}{n}", "a.example.org", ts) for n in range(3)], "url string, domain string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("url string, domain string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream.polite(read, watermark="1 minute").writeStream.format("memory").queryName("spaced").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    at = sorted(r["at"] for r in spark.table("spaced").collect())
    assert len(at) == 9 and min((b - a).total_seconds() for a, b in zip(at, at[1:])) == pytest.approx(1 / 3, abs=1e-3)


def test_outcomes_stream(spark, tmp_path):
    found = spark.createDataFrame([("http://a.example.org/", 0), ("http://a.example.org/b", 0)], "url string, depth int")
    frontier.enqueue(_empty_queue(spark), found, F.lit(NOW)).write.parquet(str(tmp_path / "queue/version=0"))
    outcomes = spark.createDataFrame([("http://a.example.org/", True, False, NOW)], "url string, ok boolean, retry boolean, ts timestamp")
    outcomes.write.parquet(str(tmp_path / "out"))
    read = spark.readStream.schema(outcomes.schema).parquet(str(tmp_path / "out"))
    run = stream.apply_outcomes(read, str(tmp_path / "queue"), lambda: F.lit(NOW)).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["url"]: r["status"] for r in spark.read.parquet(str(tmp_path / "queue/version=1")).collect()}
    assert got == {"http://a.example.org/": "completed", "http://a.example.org/b": "pending"}


@pytest.mark.parametrize("few", [64, 0])
def test_edits_by_brute_force(spark, monkeypatch, few):
    """Candidates are what one or two rounds of all edits give, terms with digits too."""
    monkeypatch.setattr(spell, "FEW", few)
    import random

    rng = random.Random(5)

    def ring(w):
        parts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        return {a + b[1:] for a, b in parts if b} | {a + b[1] + b[0] + b[2:] for a, b in parts if len(b) > 1} | {a + c + b[1:] for a, b in parts if b for c in spell.LETTERS} | {a + c + b for a, b in parts for c in spell.LETTERS}

    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(90)} | {"ab1", "1ab", "abc1", "a1bc", "ca", "abc", "acb"})
    words = ["ca", "abca", "1abc", "b", "cccccc", "a1b", "bacba", "xyzzyx"]
    known = spell.dictionary(spark.createDataFrame([(t, 1) for t in terms], "term string, df bigint"))
    got = {}
    for r in spell.candidates(spark.createDataFrame([(w,) for w in words], "word string"), known).collect():
        got.setdefault(r["word"], set()).add((r["term"], r["edits"]))
    for w in words:
        one = ring(w)
        two = set().union(*map(ring, one))
        tiers = [{t for t in terms if t == w}, one & set(terms), two & set(terms)]
        level = next((k for k, tier in enumerate(tiers) if tier), None)
        assert got.get(w, set()) == ({(t, level) for t in tiers[level]} if level is not None else set()), w
