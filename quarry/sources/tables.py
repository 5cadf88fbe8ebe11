"""Readers for the Parquet tables and the views that map them onto the
corpus data model (files, index vectors, queries).

The mappings are pure projections, so column pruning and filter pushdown
reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import path_extension

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixture rule that gives each document a file path inside its source
# repository: directories that exercise the ignore rule (and look-alikes),
# and file suffixes that exercise the extension rule.
def derived_path(doc_id="doc_id", source="source"):
    i = F.col(doc_id)
    folder = (
        F.when(i % 5 == 0, "src").when(i % 5 == 1, "node_modules/lib").when(i % 5 == 2, "docs/build")
        .when(i % 5 == 3, ".github").otherwise("rebuild")
    )
    suffix = (
        F.when(i % 7 == 0, ".py").when(i % 7 == 1, ".tar.gz").when(i % 7 == 2, ".PY")
        .when(i % 7 == 3, ".md").when(i % 7 == 4, ".").when(i % 7 == 5, "").otherwise(".js")
    )
    return F.concat(F.col(source), F.lit("/"), folder, F.lit("/f"), i.cast("string"), suffix)


def documents_as_files(docs: DataFrame) -> DataFrame:
    """documents -> file records: repo_name=source, content=text,
    size=bytes of the text, path derived per :func:`derived_path`."""
    return docs.select(
        "doc_id",
        F.col("source").alias("repo_name"),
        derived_path().alias("path"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("size"),
        "lang",
    ).withColumn("extension", path_extension("path"))


def pages_as_files(pages: DataFrame) -> DataFrame:
    """pages -> file records: host=repo_name, URL path (query and fragment
    cut) = path, html = content, byte length = size."""
    clean = F.regexp_replace("url", r"[?#].*$", "")
    return pages.select(
        "page_id",
        "url",
        F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]+)", 1).alias("repo_name"),
        F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/?(.*)$", 1).alias("path"),
        F.col("html").alias("content"),
        F.octet_length("html").cast("bigint").alias("size"),
    )


def query_turns(conv: DataFrame) -> DataFrame:
    """conversations -> a batch of text queries: every user turn, with
    "conversation/turn" as its id."""
    return conv.where(F.col("role") == "user").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), F.col("text").alias("query")
    )
