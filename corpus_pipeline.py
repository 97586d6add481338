"""A corpus made ready for training: five operators of pagelode.llm, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm.bpe import encode_documents
from pagelode.llm.common import shared_folder
from pagelode.llm.langid import accepted, learn
from pagelode.llm.linedup import dedup_passages
from pagelode.llm.minhash import without_near_duplicates
from pagelode.llm.mixing import mixture


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the classifiers learn from the labelled ones."""
    return accepted(docs, learn(docs.select("text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return without_near_duplicates(docs, words=5, num=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those left without words go."""
    out = dedup_passages(docs, whole_lines=True)
    cut = F.size("spans") > 0
    out = out.where(~cut | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(changed).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix takes of them."""
    return mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's token ids, and the digest of what they decode to."""
    return encode_documents(docs, keep=("doc_id", "lang", "source"), outputs=("ids", "decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mix", mix), ("tokens", tokens)]

#: Learnt classifiers, components and random draws: not SQL.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet in the shared folder and read again.

    A stage's table goes once the next one is written; the last one's stays, as the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            _drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
