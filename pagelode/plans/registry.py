"""Named queries over the driver's tables; the SQL of the same rows is in oracles."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.config import DEFAULT, Config, Scope
from pagelode.functions import formats, html, text, urls
from pagelode.functions import query as q
from pagelode.operators import frontier, graph, pagerank, ranking, search, spell
from pagelode.operators import index as ix
from pagelode.operators.index import Index
from pagelode.sources import pages as src
from pagelode.sources import robots
from pagelode.streaming import frontier as stream

from . import oracles

QUERIES: dict = {}
ORACLES: dict[str, str] = oracles.ORACLES

#: Terms of the sample queries, and words for the speller.
TERMS = ["thre", "thth"]
WORDS = ["thxt", "retoin", "thth", "zzzzqq", "onre", "ersz"]
SCOPE = Scope(suffixes=(".example.org", ".example.net"))


def query(f):
    QUERIES[f.__name__] = f
    return f


def _raw(spark, d) -> DataFrame:
    return src.table(spark, d, "pages")


def _pages(spark, d) -> DataFrame:
    return src.parsed(_raw(spark, d))


def _links(spark, d) -> DataFrame:
    return src.links(_raw(spark, d))


def _index(spark, d, ranks: DataFrame | None = None) -> Index:
    return Index.of_pages(_pages(spark, d), ranks=ranks)


def _ranks(spark, d, iterations: int = 20) -> DataFrame:
    edges = _links(spark, d).select(F.col("from_doc_id").alias("src"), F.col("to_doc_id").alias("dst"))
    return pagerank.pagerank(edges, _pages(spark, d).select("doc_id"), iterations=iterations)


def _ranked_index(spark, d) -> Index:
    return _index(spark, d, _ranks(spark, d))


# URLs


@query
def url_normalize(spark: SparkSession, d: str):
    return _raw(spark, d).select("page_id", urls.normalize(F.col("url")).alias("url"))


@query
def url_docid(spark, d):
    return _raw(spark, d).select("page_id", urls.doc_id(F.col("url")).alias("doc_id"))


@query
def url_domain(spark, d):
    u = F.col("url")
    return _raw(spark, d).select("page_id", urls.domain(u).alias("domain"), urls.host(u).alias("host"), urls.is_valid(u).alias("valid"))


@query
def url_depth(spark, d):
    u = F.col("url")
    return _raw(spark, d).select("page_id", urls.depth(u, u).alias("depth"), urls.depth(u, F.lit("http://nowhere.example.com/")).alias("other"))


@query
def url_scope(spark, d):
    u = F.concat_ws("", F.when(F.col("page_id") % 5 == 0, F.lit("http://172.21.0.")).otherwise(F.col("url")), F.when(F.col("page_id") % 5 == 0, (F.col("page_id") % 300).cast("string")))
    return _raw(spark, d).select("page_id", urls.in_scope(u, SCOPE).alias("in_scope"))


# HTML


@query
def html_title(spark, d):
    return _raw(spark, d).select("page_id", html.title(F.col("html")).alias("title"), html.meta(F.col("html"), "description").alias("description"))


@query
def html_text(spark, d):
    return _raw(spark, d).select("page_id", html.visible_text(F.col("html")).alias("text"))


@query
def html_headings(spark, d):
    return _raw(spark, d).select("page_id", F.posexplode(html.headings(F.col("html"))).alias("pos", "h")).select("page_id", "pos", "h.tag", "h.text")


@query
def html_links(spark, d):
    return _links(spark, d)


@query
def content_hash(spark, d):
    body = html.visible_text(F.col("html"))
    return _raw(spark, d).select("page_id", html.content_hash(body).alias("content_hash"), F.length(body).cast("bigint").alias("text_length"), F.octet_length("html").cast("bigint").alias("content_length"))


@query
def page_filters(spark, d):
    sized = _raw(spark, d).withColumns({"status_code": F.when(F.col("page_id") % 7 == 0, 404).otherwise(200), "content_type": F.when(F.col("page_id") % 3 == 0, "image/png").otherwise("text/html; charset=utf-8")})
    return src.acceptable(sized).select("page_id")


# Tokens


@query
def tokenize_terms(spark, d):
    return ix.tokens(ix.fields_of_texts(src.table(spark, d, "documents"))).groupBy("term").agg(F.count("*").alias("n"))


@query
def stem_vocab(spark, d):
    words = src.table(spark, d, "documents").select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", text.stem(F.col("word")).alias("stem"))


@query
def doc_keywords(spark, d):
    return graph.keywords(src.table(spark, d, "documents"), 5).select("doc_id", "word", "freq", F.col("rank").cast("bigint").alias("rank"))


@query
def term_positions(spark, d):
    return graph.term_positions(src.table(spark, d, "documents")).select("doc_id", "term", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query
def term_counts(spark, d):
    return ix.counts_of_pages(_pages(spark, d)).select("doc_id", "term", (F.col("n") * F.lit(5.0)).alias("weighted"))


# Index


@query
def postings_weighted(spark, d):
    posted = ix.postings_of_pages(_pages(spark, d))
    return posted.select("term", "doc_id", "freq", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"), F.array_join("fields", ",").alias("fields"))


@query
def doc_lengths(spark, d):
    return ix.lengths_of_pages(_pages(spark, d)).select("doc_id", "length")


@query
def doc_frequency(spark, d):
    return ix.document_frequencies_of_pages(_pages(spark, d))


@query
def index_stats(spark, d):
    i = _index(spark, d)
    return ix.index_stats(i.postings, i.docs, i.df).withColumns({c: F.round(c, 6) for c in ("avg_doc_length", "avg_terms_per_doc")})


@query
def corpus_stats(spark, d):
    documents = src.table(spark, d, "documents")
    return ix.index_stats(None, ix.lengths(ix.fields_of_texts(documents)), ix.document_frequencies_of_texts(documents)).withColumns({c: F.round(c, 6) for c in ("avg_doc_length", "avg_terms_per_doc")})


@query
def idf(spark, d):
    return ranking.idfs(_index(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_scores(spark, d):
    return ranking.bm25(_index(spark, d), TERMS).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query
def bm25_subset(spark, d):
    i = _index(spark, d)
    return ranking.bm25_of(i, i.docs, TERMS).select("doc_id", F.round("bm25", 6).alias("bm25"))


# Links


@query
def out_degree(spark, d):
    return graph.out_degrees(_links(spark, d))


@query
def in_links(spark, d):
    return graph.in_degrees(_links(spark, d))


@query
def link_stats(spark, d):
    return graph.link_stats(_links(spark, d))


@query
def dangling_nodes(spark, d):
    return graph.dangling(_links(spark, d))


@query
def pagerank_20it(spark, d):
    return _ranks(spark, d).select("doc_id", F.round("rank", 10).alias("rank"))


@query
def pagerank_graph(spark, d):
    lines = src.table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("s"), F.concat(F.lit("p"), F.col("l_partkey")).alias("p"), "l_linenumber")
    edges = lines.select(F.col("s").alias("src"), F.col("p").alias("dst")).union(lines.where("l_linenumber = 1").select("p", "s"))
    return pagerank.pagerank(edges, iterations=10).select("doc_id", F.round("rank", 10).alias("rank"))


@query
def pagerank_top(spark, d):
    return pagerank.titled(_ranks(spark, d).withColumn("rank", F.round("rank", 10)), _pages(spark, d), 10)


@query
def pagerank_summary(spark, d):
    return pagerank.summary(_ranks(spark, d)).select("nodes", *[F.round(c, 10).alias(c) for c in ("max_rank", "min_rank", "mean_rank")])


# Ranking


def _shown(frame):
    return frame.select("doc_id", F.round("bm25", 6).alias("bm25"), F.round("pagerank", 8).alias("pagerank"), F.round("final", 6).alias("final"))


@query
def rank_relevance(spark, d):
    return _shown(ranking.fused(_ranked_index(spark, d), TERMS, "relevance"))


@query
def rank_authority(spark, d):
    return _shown(ranking.fused(_ranked_index(spark, d), TERMS, "authority"))


@query
def rank_hybrid(spark, d):
    return _shown(ranking.fused(_ranked_index(spark, d), TERMS, "hybrid"))


@query
def rank_page2(spark, d):
    return _shown(ranking.ranked(_ranked_index(spark, d), TERMS, "relevance", limit=5, offset=5))


@query
def and_match_count(spark, d):
    return ranking.match_count(_index(spark, d), TERMS)


@query
def explain_terms(spark, d):
    i = _index(spark, d)
    return ranking.contributions(i, TERMS).select("doc_id", "term", "freq", "df", F.round("idf", 4).alias("idf"), "length", F.round("avgdl", 1).alias("avgdl"), F.round("part", 4).alias("part"))


@query
def snippets(spark, d):
    shown = F.concat(F.col("title"), F.lit(" "), F.col("text"), F.lit(" "), F.col("url"))
    return _pages(spark, d).select("doc_id", ranking.snippet(shown, TERMS).alias("snippet"))


@query
def search_many(spark, d):
    asked = src.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), q.terms(F.col("text")).alias("terms"))
    return search.results_of_many(_index(spark, d), asked, 3).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"), F.col("rank").cast("bigint").alias("rank"))


@query
def search_(spark, d):
    return search.results(_index(spark, d), TERMS, "relevance", 20)


QUERIES["search"] = QUERIES.pop("search_")


# Queries


def _asked(spark, d):
    probe = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('site:a.example.org "exact words" '), F.col("text"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("download filetype:pdf "), F.col("text"))).otherwise(F.col("text"))
    return src.table(spark, d, "conversations").select("conv_id", "turn", probe.alias("q"))


@query
def query_parse(spark, d):
    c = F.col("q")
    return _asked(spark, d).select("conv_id", "turn", F.array_join(q.terms(c), " ").alias("terms"), F.array_join(q.phrases(c), "|").alias("phrases"), q.filter_value(c, "site").alias("site"), q.filter_value(c, "filetype").alias("filetype"), q.is_valid(c).alias("is_valid"))


@query
def query_expand(spark, d):
    return src.table(spark, d, "benchmark").select("item_id", F.array_join(q.expand(q.terms(F.col("text"))), " ").alias("terms"))


@query
def query_intent(spark, d):
    return _asked(spark, d).select("conv_id", "turn", q.intent(F.col("q")).alias("intent"))


def _spelling(spark, d):
    known = spell.dictionary(ix.document_frequencies_of_texts(src.table(spark, d, "documents")))
    return spark.createDataFrame([(w,) for w in WORDS], "word string"), known


@query
def spell_candidates(spark, d):
    return spell.candidates(*_spelling(spark, d)).select("word", "term", "freq", F.col("edits").cast("bigint").alias("edits"))


@query
def spell_correct(spark, d):
    return spell.correct(*_spelling(spark, d))


@query
def spell_suggest(spark, d):
    return spell.suggest(*_spelling(spark, d)).select("word", "term", F.round("p", 9).alias("p"), F.col("rank").cast("bigint").alias("rank"))


@query
def spell_queries(spark, d):
    _, known = _spelling(spark, d)
    asked = spark.createDataFrame([(1, "Thxt of retoin, thxt"), (2, "an zzzzqq"), (3, ""), (4, "ONRE onre")], "query_id int, query string")
    return spell.correct_queries(asked, known).select("query_id", "query", "corrected", F.size("corrections").cast("bigint").alias("n"))


# Frontier

NOW = "timestamp '2024-01-01 00:05:00'"


def _queue(spark, d):
    base = F.expr("timestamp '2024-01-01 00:00:00'")
    n = F.length("url")
    visited = src.unique_pages(_raw(spark, d)).select("url").withColumns({"depth": F.lit(0), "priority": F.lit(DEFAULT.seed_priority), "status": F.lit("completed"), "retries": F.lit(0)})
    found = _links(spark, d).select(F.col("to_url").alias("url")).distinct().withColumns({"depth": F.lit(1), "priority": F.lit(DEFAULT.link_priority), "status": F.when(n % 7 == 0, "crawling").when(n % 11 == 0, "failed").otherwise("pending"), "retries": n % 3})
    rows = visited.unionByName(found)
    created = F.timestamp_micros(F.unix_micros(base) + n.cast("bigint") * 1_000_000)
    return rows.withColumns({"domain": urls.domain(F.col("url")), "created_at": created, "last_attempt_at": F.when(F.col("status") == "crawling", created), "next_attempt_at": F.timestamp_micros(F.unix_micros(created) + (F.col("retries") * 150).cast("bigint") * 1_000_000)})


@query
def frontier_next(spark, d):
    return frontier.next_urls(_queue(spark, d), F.expr(NOW), 25).select("url", "priority", "depth", F.unix_seconds("created_at").alias("created"))


@query
def frontier_per_host(spark, d):
    return frontier.round_of(_queue(spark, d), F.expr(NOW)).select("domain", "url", F.col("place").cast("bigint").alias("place"))


@query
def queue_status(spark, d):
    return frontier.status_counts(_queue(spark, d))


@query
def retry_schedule(spark, d):
    return _queue(spark, d).where("status = 'crawling'").select("url", F.unix_seconds(frontier.retry_at(F.expr(NOW), F.col("retries"))).alias("next_attempt"))


@query
def frontier_new_links(spark, d):
    queue = _queue(spark, d).withColumn("doc_id", urls.doc_id(F.col("url")))
    found = _raw(spark, d).select(F.concat("url", F.lit("/more")).alias("url"), F.lit(1).alias("depth"))
    grown = frontier.enqueue(queue, found, F.expr(NOW))
    return grown.join(queue.select("url"), "url", "left_anti").select("url", "domain", "depth", "priority")


# Engine


@query
def engine_stats(spark, d):
    i = _index(spark, d)
    stats = ix.index_stats(i.postings, i.docs, i.df).select("total_docs", "vocabulary_size", "total_postings")
    return graph.engine_stats(stats, _pages(spark, d), _links(spark, d)).select("total_docs", "vocabulary_size", "total_postings", "pages", "total_links", "linking_pages", "linked_documents")


@query
def top_pages(spark, d):
    ranked = pagerank.stored(_pages(spark, d).withColumn("pagerank", F.lit(0.0)), _ranks(spark, d))
    return graph.top_pages(ranked.withColumn("pagerank", F.round("pagerank", 10)), 20).select("doc_id", "url", "title", "pagerank")


@query
def upsert(spark, d):
    pages = _pages(spark, d)
    old = pages.where("doc_id < 'c'").withColumns({"created_at": F.expr("timestamp '2023-01-01 00:00:00'"), "updated_at": F.expr("timestamp '2023-01-01 00:00:00'"), "pagerank": F.lit(0.5), "is_indexed": F.lit(True)})
    return src.upsert_pages(old, pages.where("doc_id > '6'"), F.expr(NOW)).select("doc_id", "url", F.unix_seconds("created_at").alias("created"), F.unix_seconds("updated_at").alias("updated"), "pagerank", "is_indexed")


# Stored tables


def _first_url(spark, d) -> str:
    """The url of page 0, by which single pages are looked up."""
    return _raw(spark, d).where("page_id = 0").select(urls.normalize(F.col("url"))).first()[0]


def _first_id(spark, d) -> str:
    return _raw(spark, d).where("page_id = 0").select(urls.doc_id(F.col("url"))).first()[0]


def _database(d: str) -> str:
    return f"pagelode_{zlib.crc32(d.encode()):08x}"


def _saved(spark, d, ranks: DataFrame | None = None) -> Index:
    """The index of the pages of d, written as bucketed tables and loaded again."""
    database = _database(d) + ("_ranked" if ranks is not None else "")
    _index(spark, d, ranks).save(spark, database)
    return Index.load(spark, database)


@query
def pages_conformed(spark, d):
    return src.conformed(_pages(spark, d).withColumn("status_code", F.lit("200")), src.PAGES).select("doc_id", "title", "status_code", "pagerank", "content_length")


@query
def pages_paged(spark, d):
    return src.paged(_pages(spark, d), limit=10, offset=5).select("doc_id", "url")


@query
def page_lookup(spark, d):
    return src.page(_pages(spark, d), url=_first_url(spark, d)).select("doc_id", "url", "title")


@query
def page_links_out(spark, d):
    return src.outgoing(_links(spark, d), _first_id(spark, d))


@query
def page_links_in(spark, d):
    found = _links(spark, d)
    target = found.agg(F.min("to_doc_id")).first()[0]
    return src.incoming(found, target or "")


@query
def links_added(spark, d):
    found = _links(spark, d)
    return src.add_links(found.where("from_doc_id < '8'"), found).select("from_doc_id", "to_url")


@query
def url_known(spark, d):
    return src.url_exists(_first_url(spark, d), _queue(spark, d), _pages(spark, d))


@query
def mark_indexed(spark, d):
    pages = _pages(spark, d).withColumns({"is_indexed": F.lit(False), "updated_at": F.expr("timestamp '2023-01-01 00:00:00'")})
    return src.mark_indexed(pages, pages.where("doc_id < '8'"), F.expr(NOW)).select("doc_id", "is_indexed", F.unix_seconds("updated_at").alias("updated"))


@query
def size_limit(spark, d):
    sized = _raw(spark, d).withColumns({"status_code": F.lit(200), "content_type": F.lit("text/html")})
    return src.acceptable(sized, Config(max_page_bytes=2000)).select("page_id")


@query
def ranked_pages(spark, d):
    longest = _pages(spark, d).select("doc_id", "content_length").orderBy(F.desc("content_length"), "doc_id").limit(10)
    return src.ranked_rows(longest, F.desc("content_length"), "doc_id").withColumn("rank", F.col("rank").cast("bigint"))


@query
def index_saved(spark, d):
    i = _saved(spark, d)
    return i.postings.select("term", "doc_id", "freq", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"), F.array_join("fields", ",").alias("fields"))


@query
def index_incremental(spark, d):
    pages = _pages(spark, d)
    grown = Index.of_pages(pages.where("doc_id < 'a'")).with_pages(pages.where("doc_id >= '8'"))
    return grown.postings.select("term", "doc_id", "freq")


@query
def index_state(spark, d):
    i = _index(spark, d)
    return graph.index_status(spark, i.docs.count(), i.df.count(), version=3).drop("last_indexed_at")


@query
def search_saved(spark, d):
    return search.results(_saved(spark, d), TERMS, "relevance", 20)


@query
def search_many_saved(spark, d):
    asked = src.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), q.terms(F.col("text")).alias("terms"))
    return search.results_of_many(_saved(spark, d), asked, 3).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"), F.round("final", 6).alias("final"), F.col("rank").cast("bigint").alias("rank"))


@query
def search_full(spark, d):
    """The whole way of a query: spelling, parsing, hybrid ranking by a saved index with authority, total, second page."""
    answer = search.search(_saved(spark, d, _ranks(spark, d)), "Thre thth", limit=5, offset=5, mode="hybrid")
    rows = [(answer["total"], answer["page"], answer["corrected"], r["doc_id"], r["final"], r["bm25"], r["pagerank"]) for r in answer["results"]]
    return spark.createDataFrame(rows, "total bigint, page int, corrected string, doc_id string, final double, bm25 double, pagerank double")


@query
def explain(spark, d):
    return ranking.explain(_ranked_index(spark, d), _first_id(spark, d), [*TERMS, "zzzz"])


@query
def result_details(spark, d):
    return ranking.result_details(_index(spark, d), _first_id(spark, d), TERMS).withColumn("bm25", F.round("bm25", 6))


# Small functions


@query
def cjk_terms(spark, d):
    mixed = F.concat(F.col("n_name"), F.lit(" 网络爬虫 的 中文分词器, "), F.substring(F.lit("搜索引擎技术研究"), F.lit(1), (F.col("n_nationkey") % 9).cast("int")), F.lit(" running"))
    return src.table(spark, d, "nation").select("n_nationkey", F.array_join(text.tokenize(mixed), " ").alias("terms"))


@query
def same_domain(spark, d):
    u = F.col("url")
    return _raw(spark, d).select("page_id", urls.same_domain(u, F.concat(F.lit("HTTPS://"), F.upper(urls.domain(u)), F.lit(":8080/x"))).alias("own"), urls.same_domain(u, F.lit("http://elsewhere.com/")).alias("other"))


@query
def dotted_links(spark, d):
    u, href = F.col("url"), F.concat(F.lit("../x/./y/../z"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, "/..").when(F.col("page_id") % 3 == 1, "/.").otherwise("?q=../a"))
    return _raw(spark, d).select("page_id", urls.resolve_dots(u, href).alias("target"))


@query
def robots_allowed(spark, d):
    rules = _raw(spark, d).select(urls.domain(F.col("url")).alias("domain")).distinct().withColumn("rules", F.when(F.length("domain") % 2 == 0, "User-agent: *\nDisallow: /en\nCrawl-delay: 4"))
    return robots.allowed(_raw(spark, d).select("page_id", "url"), rules).select("page_id")


@query
def crawl_delays(spark, d):
    rules = _raw(spark, d).select(urls.domain(F.col("url")).alias("domain")).distinct().withColumn("rules", F.when(F.length("domain") % 2 == 0, "User-agent: *\nDisallow: /en\nCrawl-delay: 4"))
    return robots.crawl_delays(rules)


@query
def crawl_counters(spark, d):
    pages = _raw(spark, d).withColumns({"status_code": F.when(F.col("page_id") % 7 == 0, 404).otherwise(200), "content_type": F.lit("text/html")})
    return stream.counters(pages, src.acceptable(pages))


@query
def page_windows(spark, d):
    asked = src.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 900).alias("total"), (F.col("o_orderkey") % 130).alias("wanted"), (F.col("o_custkey") % 300).alias("offset"))
    limited = asked.withColumn("limit", ranking.clamped(F.col("wanted")))
    return limited.select("o_orderkey", F.col("limit").cast("bigint").alias("limit"), F.array_join(F.transform(ranking.page_numbers(F.col("total"), F.col("limit"), F.col("offset")), lambda x: x.cast("string")), ",").alias("pages"))


@query
def shown_numbers(spark, d):
    ratio = F.col("l_partkey").cast("double") / 7
    return src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", formats.fixed(ratio, 4).alias("four"), formats.fixed(ratio, 6).alias("six"), formats.fixed(ratio, 1).alias("one"), formats.varint_size(F.col("l_orderkey").cast("bigint") * F.col("l_partkey") * F.col("l_suppkey")).cast("bigint").alias("bytes"))


@query
def json_maps(spark, d):
    kept = _pages(spark, d).select("doc_id", formats.as_json(F.col("url"), F.col("title"), F.col("content_length")).alias("info"))
    return kept.select("doc_id", formats.of_json(F.col("info"), "url string, title string, content_length bigint").alias("i")).select("doc_id", "i.*")
