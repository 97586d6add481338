"""The pages and links tables: building them from raw pages, and upserts that keep their keys unique."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.config import DEFAULT, Config
from pagelode.functions import html, urls

PAGES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("doc_id", "url", "domain", "title", "text")]
    + [T.StructField("headings", T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())])))]
    + [T.StructField(n, T.StringType()) for n in ("meta_description", "content_hash")]
    + [T.StructField("content_length", T.LongType()), T.StructField("content_type", T.StringType()), T.StructField("status_code", T.IntegerType()), T.StructField("depth", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("last_modified", "etag")]
    + [T.StructField("is_indexed", T.BooleanType()), T.StructField("pagerank", T.DoubleType())]
    + [T.StructField(n, T.TimestampType()) for n in ("last_crawled_at", "created_at", "updated_at")]
)
LINKS = T.StructType([T.StructField(n, T.StringType()) for n in ("from_doc_id", "to_url", "to_doc_id", "anchor_text")])


def spread(frame: DataFrame) -> DataFrame:
    """A table whose scan has fewer tasks than there are cores, dealt out over the cores, as parsing costs far more than moving; any larger table as it is."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame._jdf.queryExecution().toRdd().getNumPartitions() < cores else frame


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def acceptable(responses: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Responses that are pages: status under 400, HTML or plain text, of bounded size."""
    kind = F.coalesce(F.col("content_type"), F.lit(""))
    return responses.where((F.col("status_code") < 400) & (kind.contains("text/html") | kind.contains("text/plain")) & (F.octet_length("html") <= config.max_page_bytes))


def unique_pages(raw: DataFrame) -> DataFrame:
    """(page_id, url, html) with doc_id and normalized url; of one doc_id the largest page_id stays."""
    keyed = raw.withColumn("url", urls.normalize(F.col("url"))).withColumn("doc_id", urls.doc_id_of_normalized(F.col("url")))
    # A maximum of a struct is combined before the shuffle; ids alone move, then the row that has it is kept.
    last = keyed.groupBy("doc_id").agg(F.max("page_id").alias("page_id"))
    return keyed.join(last, ["doc_id", "page_id"])


def parsed(raw: DataFrame, lenient: bool = False) -> DataFrame:
    """The pages table of raw (page_id, url, html); lenient takes the text by a tolerant parser, in Python."""
    page = F.col("html")
    text = html.visible_text_lenient(page) if lenient else html.visible_text(page)
    return unique_pages(raw).select(
        "doc_id",
        "url",
        urls.domain(F.col("url")).alias("domain"),
        html.title(page).alias("title"),
        text.alias("text"),
        html.headings(page).alias("headings"),
        html.meta(page, "description").alias("meta_description"),
        html.content_hash(text).alias("content_hash"),
        F.octet_length(page).cast("long").alias("content_length"),
    )


def links(raw: DataFrame, config: Config = DEFAULT, general: bool = True) -> DataFrame:
    """(from_doc_id, to_url, to_doc_id, anchor_text): followed links, the first of each target per page.

    Every href is resolved; without general, those with dot segments are left out."""
    found = unique_pages(raw).select("doc_id", "url", F.posexplode(html.anchors(F.col("html"))).alias("pos", "a"))
    kept = found.where((F.col("a.href") != "") & ~F.col("a.href").rlike(html.SKIPPED_HREF))
    target = urls.resolve(F.col("url"), F.col("a.href"))
    if general:
        # With a host of its own an href keeps its path as it is, as in the reference.
        dotted = F.when(F.col("a.href").startswith("//"), F.concat(urls.scheme(F.col("url")), F.lit(":"), F.col("a.href"))).otherwise(urls.resolve_dots(F.col("url"), F.col("a.href")))
        target = F.coalesce(target, dotted)
    aimed = kept.select("doc_id", "pos", F.col("a.anchor").alias("anchor"), target.alias("target")).select("doc_id", "pos", "anchor", urls.normalize(F.col("target")).alias("to_url")).where(urls.is_valid(F.col("to_url")))
    first = aimed.groupBy("doc_id", "to_url").agg(F.min_by("anchor", "pos").alias("anchor_text"))
    return first.select(F.col("doc_id").alias("from_doc_id"), "to_url", urls.doc_id_of_normalized(F.col("to_url")).alias("to_doc_id"), F.substring("anchor_text", 1, config.max_anchor).alias("anchor_text"))


def upsert_pages(old: DataFrame, new: DataFrame, now) -> DataFrame:
    """old with new by url: created_at stays, pagerank and is_indexed start anew. Of rows of one url in new, one is taken."""
    new = new.dropDuplicates(["url"])
    created = old.select("url", F.col("created_at").alias("_created"))
    fresh = new.drop("created_at", "updated_at", "pagerank", "is_indexed").join(created, "url", "left")
    fresh = fresh.withColumns({"created_at": F.coalesce("_created", now), "updated_at": now, "pagerank": F.lit(0.0), "is_indexed": F.lit(False)}).drop("_created")
    return old.join(new.select("url"), "url", "left_anti").unionByName(fresh, allowMissingColumns=True)


def add_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and what new has beyond it, by (from_doc_id, to_url)."""
    keys = ["from_doc_id", "to_url"]
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def mark_indexed(pages: DataFrame, doc_ids: DataFrame, now) -> DataFrame:
    """pages with is_indexed set for doc_ids (doc_id), and their updated_at."""
    marked = pages.join(doc_ids.select("doc_id", F.lit(True).alias("_done")).distinct(), "doc_id", "left")
    return marked.withColumns({"is_indexed": F.coalesce("_done", "is_indexed"), "updated_at": F.when(F.col("_done"), now).otherwise(F.col("updated_at"))}).drop("_done").select(*pages.columns)


def conformed(frame: DataFrame, schema: T.StructType = PAGES) -> DataFrame:
    """frame with the schema's columns, in its order and types: missing ones null, others left out. Old tables are read through it."""
    have = {c.lower(): c for c in frame.columns}
    return frame.select(*[(F.col(f"`{have[f.name]}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def page(pages: DataFrame, url: str | None = None, doc_id: str | None = None) -> DataFrame:
    """The page of a url, else of a doc_id; nothing without either."""
    test = F.col("url") == url if url else F.col("doc_id") == doc_id if doc_id else F.lit(False)
    return pages.where(test).limit(1)


def outgoing(links_: DataFrame, doc_id: str) -> DataFrame:
    return links_.where(F.col("from_doc_id") == doc_id)


def incoming(links_: DataFrame, doc_id: str) -> DataFrame:
    return links_.where(F.col("to_doc_id") == doc_id)


def url_exists(url: str, queue: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: whether the queue or the pages have the url."""
    return queue.select("url").union(pages.select("url")).where(F.col("url") == url).agg((F.count("*") > 0).alias("exists"))


def paged(pages: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Pages in order of doc_id."""
    out = pages.orderBy("doc_id").offset(offset)
    return out if limit is None else out.limit(limit)


def ranked_rows(frame: DataFrame, *order) -> DataFrame:
    """A page of results with rank numbers from 1; the frame is limited already, as a window over all of it is one task."""
    return frame.withColumn("rank", F.row_number().over(W.orderBy(*order)))
