"""Repository snapshots: the processed file records of a scan, with history.

A snapshot is stored flat as Parquet, ``files/repo_key=.../at=...``: one row
per file, a folder per repository and snapshot time, so a hot repository is
spread over many files and tasks and a read of one time opens only its
folders.  ``log`` has a row per repository and snapshot (also for one without
files) and is written last: a snapshot that was not finished is not seen.
Earlier snapshots stay readable, by time, and two times can be compared.

The nested single-document form ``{"metadata": {...}, "files": [...]}`` is also
readable (one document per file, parsed by one task each, ``files`` exploded).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_FIELDS = [
    T.StructField("path", T.StringType()),
    T.StructField("full_path", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("modified", T.StringType()),
    T.StructField("hash", T.StringType()),
]
FLAT_SCHEMA = T.StructType([*FILE_FIELDS, T.StructField("repo_name", T.StringType()), T.StructField("repo_key", T.StringType()), T.StructField("at", T.LongType())])
LOG_SCHEMA = "repo_name string, at bigint, n_files bigint"
NESTED_SCHEMA = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("last_updated", T.StringType()),
        T.StructField("file_count", T.LongType()),
        T.StructField("languages", T.MapType(T.StringType(), T.LongType())),
        T.StructField("size_mb", T.DoubleType()),
    ])),
    T.StructField("files", T.ArrayType(T.StructType(FILE_FIELDS))),
])


def _key(repo: Column) -> Column:
    return F.concat(F.lit("r"), F.md5(repo.cast("binary")))


def snapshot_folder(repo: Column) -> Column:
    """Folder of a repository's snapshots below the snapshot path."""
    return F.concat(F.lit("files/repo_key="), _key(repo))


def _micros(at: dt.datetime | None) -> int:
    at = at or dt.datetime.now(dt.timezone.utc)
    at = at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
    return round((at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))


def write_snapshot(files: DataFrame, path: str, at: dt.datetime | None = None, repos: DataFrame | None = None) -> int:
    """Add a snapshot of file records (needs repo_name) taken ``at`` a time
    (now); returns it in microseconds.  ``repos`` (repo_name): what was
    scanned, if that may include repositories without a file."""
    spark, when = files.sparkSession, _micros(at)
    cols = [f.name for f in FILE_FIELDS if f.name in files.columns]
    out = files.select(*cols, "repo_name", _key(F.col("repo_name")).alias("repo_key"), F.lit(when).alias("at"))
    if "modified" in out.columns:
        out = out.withColumn("modified", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    # a retried snapshot replaces what it wrote before
    (out.hint("rebalance", "repo_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("repo_key", "at").parquet(f"{path}/files"))
    written = spark.read.schema(FLAT_SCHEMA).parquet(f"{path}/files").where(F.col("at") == when).groupBy("repo_name").agg(F.count(F.lit(1)).alias("n_files"))
    if repos is not None:
        written = repos.select("repo_name").distinct().join(written, "repo_name", "left").fillna(0, "n_files")
    written.select("repo_name", F.lit(when).alias("at"), "n_files").write.mode("append").parquet(f"{path}/log")
    return when


def snapshot_log(spark: SparkSession, path: str) -> DataFrame:
    """(repo_name, at, n_files) of every snapshot."""
    return spark.read.schema(LOG_SCHEMA).parquet(f"{path}/log").distinct()


def read_snapshot(spark: SparkSession, path: str, as_of: dt.datetime | int | None = None) -> DataFrame:
    """File rows of every repository's last snapshot (up to ``as_of``), with
    ``snapshot_at``."""
    log = snapshot_log(spark, path)
    if as_of is not None:
        log = log.where(F.col("at") <= F.lit(as_of if isinstance(as_of, int) else _micros(as_of)))
    last = log.groupBy("repo_name").agg(F.max("at").alias("at")).select(_key(F.col("repo_name")).alias("repo_key"), "at")
    files = spark.read.schema(FLAT_SCHEMA).parquet(f"{path}/files").join(last, ["repo_key", "at"], "left_semi")
    return files.withColumn("snapshot_at", F.timestamp_micros("at")).drop("repo_key", "at")


def diff_stored(spark: SparkSession, path: str, then, now=None) -> DataFrame:
    """Changes between two stored times: repo_name, path, old_hash, new_hash, change."""
    from quarry.operators.lifecycle import diff_snapshots

    return diff_snapshots(read_snapshot(spark, path, then), read_snapshot(spark, path, now))


def read_nested_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Nested snapshot documents -> one row per file with repo_name."""
    doc = spark.read.schema(NESTED_SCHEMA).option("multiLine", True).json(path)
    return doc.select(F.col("metadata.name").alias("repo_name"),
                      F.explode_outer("files").alias("f")).where(F.col("f").isNotNull()) \
        .select("repo_name", "f.*")
