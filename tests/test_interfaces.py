"""The engine's ways in: HTTP, the web source, the log, the command line, crawling with robots and limits."""

import datetime
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from pagelode import cli, web
from pagelode.config import DEFAULT
from pagelode.logs import logger
from pagelode.operators import frontier, ranking
from pagelode.operators.index import Index
from pagelode.sources import pages as src
from pagelode.sources import robots
from pagelode.sources.web import WebSource
from pagelode.streaming import frontier as stream

NOW = datetime.datetime(2024, 1, 1)
HTML = "<html><head><title>{0}</title></head><body><p>{1}</p>{2}</body></html>"
QUEUE = "url string, doc_id string, domain string, depth int, priority int, status string, retries int, last_attempt_at timestamp, created_at timestamp, next_attempt_at timestamp"


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(k, f"http://a.example.org/{k}", HTML.format(f"Page {k} <b>", f"routers number{k} route packets", f'<a href="/{k + 1}">next</a>')) for k in range(30)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").cache()


@pytest.fixture(scope="module")
def app(raw):
    pages = src.parsed(raw).withColumn("pagerank", F.lit(0.5)).cache()
    i = Index.of_pages(pages)
    return web.create_app(Index(i.postings.cache(), i.docs.cache(), i.df.cache()), pages, src.links(raw).cache())


def _get(app, path, query=""):
    told = {}
    body = b"".join(app({"PATH_INFO": path, "QUERY_STRING": query}, lambda status, headers: told.update(status=status, **dict(headers))))
    assert int(told["Content-Length"]) == len(body)
    return told["status"], body.decode()


def test_pages_and_json(app):
    assert _get(app, "/")[0] == "200 OK" and "PageRank" in _get(app, "/about")[1]
    answer = json.loads(_get(app, "/api/search", "q=packets&limit=7&offset=7")[1])
    assert answer["total"] == 30 and answer["page"] == 2 and len(answer["results"]) == 7
    status, page = _get(app, "/search", "q=packets")
    assert status == "200 OK" and page.count("<h3>") == 20 and "Page 1 &lt;b&gt;" in page and '&page=2' in page
    assert json.loads(_get(app, "/api/stats")[1])["pages"] == 30 and "<table>" in _get(app, "/stats")[1]
    doc = answer["results"][0]["doc_id"]
    told = json.loads(_get(app, "/api/explain", f"q=packets&doc_id={doc}")[1])
    assert told["doc_id"] == doc and told["total"] > 0 and len(told["terms"]) == 1
    assert json.loads(_get(app, "/api/explain", "q=the&doc_id=x")[1]) is None
    assert json.loads(_get(app, "/api/explain", "q=packets&doc_id=x")[1])["total"] == 0
    assert _get(app, "/nothing")[0].startswith("404")
    empty = web.create_app(None)
    assert json.loads(_get(empty, "/api/search", "q=x")[1])["error"] and _get(empty, "/api/stats")[0].startswith("503")
    assert len(json.loads(_get(app, "/api/search", "q=packets&limit=many")[1])["results"]) == 20


def test_page_numbers_as_a_column(spark):
    rows = [(total, limit, offset) for total in (0, 1, 20, 21, 399, 900) for limit in (1, 20, 100) for offset in (0, 20, 399)]
    frame = spark.createDataFrame(rows, "total bigint, `limit` int, offset int").withColumn("pages", ranking.page_numbers(F.col("total"), F.col("limit"), F.col("offset")))
    for r in frame.collect():
        assert r["pages"] == ranking.page_window(r["total"], r["limit"], r["offset"])
    assert [r[0] for r in spark.createDataFrame([(None,), (0,), (7,), (500,)], "n int").select(ranking.clamped(F.col("n"))).collect()] == [DEFAULT.default_limit, DEFAULT.default_limit, 7, DEFAULT.max_limit]


class _Site(BaseHTTPRequestHandler):
    def do_GET(self):
        code, kind, body = {"/": (200, "text/html; charset=utf-8", "<p>größe</p>"), "/image": (200, "image/png", "x"), "/large": (200, "text/html", "x" * 5000)}.get(self.path, (404, "text/html", "gone"))
        self.send_response(code)
        self.send_header("Content-Type", kind)
        self.send_header("ETag", "one")
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


def test_web_source(spark):
    server = HTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(WebSource)
    asked = [f"{base}/", f"{base}/image", f"{base}/large", f"{base}/missing", "http://127.0.0.1:1/", "nonsense"]
    got = {r["url"]: r for r in spark.read.format("pagelode_web").option("urls", " ".join(asked)).option("max_bytes", 1000).option("partitions", 3).load().collect()}
    server.shutdown()
    assert set(got) == set(asked)
    assert (got[asked[0]]["status_code"], got[asked[0]]["html"], got[asked[0]]["etag"]) == (200, "<p>größe</p>", "one")
    assert [(got[u]["status_code"], got[u]["html"]) for u in asked[1:]] == [(200, None), (200, None), (404, None), (0, None), (0, None)]
    frame = spark.createDataFrame([tuple(r) for r in got.values()], "page_id bigint, url string, status_code int, content_type string, etag string, last_modified string, html string")
    assert [r["url"] for r in src.acceptable(frame).collect()] == [asked[0]]


def _crawl(spark, raw, **parameters):
    table = raw.select("url", "html")
    seeds = spark.createDataFrame([("http://a.example.org/0", 0), ("http://a.example.org/20", 0)], "url string, depth int")
    queue = frontier.enqueue(spark.createDataFrame([], QUEUE), seeds, F.lit(NOW), priority=1)
    fetched = lambda chosen: chosen.select("url", "depth").join(table, "url").withColumns({"status_code": F.lit(200), "content_type": F.lit("text/html")})
    told = []
    queue, seen = stream.crawl(queue, fetched, lambda k: F.lit(NOW + datetime.timedelta(seconds=10 * k)), 4, told=told.append, **parameters)
    return {r["url"].rpartition("/")[2]: r["status"] for r in queue.collect()}, {r["url"].rpartition("/")[2] for r in seen.collect()} if seen is not None else set(), told


def test_crawl_asks_robots(spark, raw):
    rules = spark.createDataFrame([("a.example.org", "User-agent: *\nDisallow: /2")], "domain string, rules string")
    queue, seen, told = _crawl(spark, raw, robots=rules)
    assert seen == {"0", "1"} and queue["20"] == queue["2"] == "failed"
    assert told[-1]["failures"] == 2 and told[-1]["pages"] == 2 and told[-1]["bytes"] > 0


def test_crawl_stops(spark, raw):
    _, seen, told = _crawl(spark, raw, max_pages=3)
    assert len(seen) == 3 and told[-1]["pages"] == 3
    assert _crawl(spark, raw, max_seconds=0.0)[2] == []


def test_stale_rules(spark):
    rules = spark.createDataFrame([("a", "", NOW), ("b", "", NOW - datetime.timedelta(days=2))], "domain string, rules string, fetched_at timestamp")
    domains = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "domain string")
    assert sorted(r[0] for r in robots.stale(domains, rules, F.lit(NOW + datetime.timedelta(hours=1))).collect()) == ["b", "c"]


def test_log(tmp_path):
    log = logger("pagelode.test", str(tmp_path / "log"), max_bytes=300, backups=2)
    for k in range(20):
        log.info("line %d of the log", k)
    assert logger("pagelode.test") is log and len(log.handlers) == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["log", "log.1", "log.2"]


def test_command_line(spark, raw, tmp_path, capsys):
    out = str(tmp_path / "data")
    raw.coalesce(1).write.parquet(str(tmp_path / "raw.parquet"))
    for step in (["init", "http://a.example.org/0"], ["parse", str(tmp_path / "raw.parquet")], ["pagerank"], ["index"], ["index"]):
        cli.main(["--out", out, *step])
    assert spark.read.parquet(f"{out}/index_status.parquet").first().asDict()["version"] == 2
    capsys.readouterr()
    cli.main(["--out", out, "search", "packets", "--limit", "3"])
    answer = json.loads(capsys.readouterr().out)
    assert answer["total"] == 30 and len(answer["results"]) == 3
    cli.main(["--out", out, "explain", answer["results"][0]["doc_id"], "packets"])
    assert json.loads(capsys.readouterr().out)["total"] > 0
    cli.main(["--out", out, "stats"])
    assert json.loads(capsys.readouterr().out)["total_links"] == 30
