"""Per-repository and corpus-wide summaries.  All are hash aggregations
with map-side partial aggregation, so a repository holding a third of
the corpus still ships one partial row per map task; the per-repository
language map is bounded by the extension allow-list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import config


def language_histogram(files: DataFrame, key: str = "extension", repo_col: str = "repo_name") -> DataFrame:
    """Long form: (repo_name, extension, n_files)."""
    return files.groupBy(repo_col, key).agg(F.count(F.lit(1)).alias("n_files"))


def languages_map(hist: DataFrame, key: str = "extension", repo_col: str = "repo_name") -> DataFrame:
    """Long histogram -> one MAP<STRING,BIGINT> per repository, keys sorted."""
    return hist.groupBy(repo_col).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("n_files"))))).alias("languages"))


def repo_metadata(files: DataFrame, key: str = "extension", repo_col: str = "repo_name",
                  root_col: str | None = None, origin_col: str | None = None) -> DataFrame:
    """One row per repository: file_count, total_bytes, size_mb (3 places),
    url (origin, else ``local:<root>``), last_updated (time of this run) and
    the language map.  One aggregation by (repository, extension), rolled
    up to repositories."""
    extra = []
    if root_col:
        extra.append(F.min(root_col).alias("__path"))
    if origin_col:
        extra.append(F.min(origin_col).alias("__origin"))
    cells = files.groupBy(repo_col, key).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").cast("bigint").alias("__bytes"), *extra)
    up = [F.min(c).alias(c) for c, given in (("__path", root_col), ("__origin", origin_col)) if given]
    repos = cells.groupBy(repo_col).agg(
        F.sum("n_files").alias("file_count"), F.sum("__bytes").cast("bigint").alias("total_bytes"), *up,
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("n_files"))))).alias("languages"))
    path = F.col("__path") if root_col else F.col(repo_col)
    local = F.concat(F.lit("local:"), path)
    return repos.select(
        F.col(repo_col).alias("name"), path.alias("path"), (F.coalesce("__origin", local) if origin_col else local).alias("url"),
        F.current_timestamp().alias("last_updated"), "file_count", "total_bytes",
        F.round(F.col("total_bytes") / F.lit(float(config.MIB)), 3).alias("size_mb"), "languages",
    )


def language_totals(files: DataFrame, key: str = "extension") -> DataFrame:
    return files.groupBy(key).agg(F.count(F.lit(1)).alias("n_files"))


def top_languages(files: DataFrame, n: int = 10, key: str = "extension") -> DataFrame:
    return language_totals(files, key).orderBy(F.desc("n_files"), F.asc(key)).limit(n)


def repo_names(files: DataFrame, repo_col: str = "repo_name") -> DataFrame:
    return files.select(repo_col).distinct()


def corpus_stats(registry: DataFrame, files: DataFrame, vectors: DataFrame | None = None, key: str = "extension",
                 vec_col: str = "embedding") -> DataFrame:
    """One row: total_repositories and total_files from the registry,
    languages (extension -> files, over registered repositories; one whose
    files are missing still counts in the totals), vector_db statistics and
    the repository names.

    Files are reduced to one row per (repository, extension) before they
    meet the registry, so nothing per file is joined."""
    cells = files.groupBy("repo_name", key).agg(F.count(F.lit(1)).alias("n"))
    known = cells.join(registry.select(F.col("name").alias("repo_name")), "repo_name", "left_semi")
    langs = (known.groupBy(key).agg(F.sum("n").alias("n"))
             .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("languages"), F.count(F.lit(1)).alias("n_languages")))
    reg = registry.agg(F.count(F.lit(1)).alias("total_repositories"), F.coalesce(F.sum("files_processed"), F.lit(0)).cast("bigint").alias("total_files"),
                       F.sort_array(F.collect_list("name")).alias("repositories"))
    db = F.struct(F.lit("spark-parquet").alias("db_type"), F.lit(0).cast("bigint").alias("total_documents"), F.lit(0).cast("bigint").alias("vector_size"))
    if vectors is not None:
        one = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vec_col)), F.lit(0)).cast("bigint").alias("w"))
        db = F.struct(F.lit("spark-parquet").alias("db_type"), one.select("n").scalar().alias("total_documents"), one.select("w").scalar().alias("vector_size"))
    return reg.select(
        "total_repositories", "total_files", langs.select("n_languages").scalar().alias("n_languages"),
        langs.select("languages").scalar().alias("languages"), db.alias("vector_db"), "repositories")
