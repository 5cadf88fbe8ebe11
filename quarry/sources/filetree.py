"""Distributed recursive file scan.

A listing is a DataFrame job, not a driver loop:

1. roots (root, repo_name) -> ``mapInPandas`` walks directories.  A task
   lists at most ``budget`` directories of what it was given and hands the
   rest back; what is handed back is written to the shared folder, dealt
   anew and walked in the next round, until nothing is left.  So a deep or
   wide repository spreads over tasks, and every directory is listed once.
2. eligibility (ignored directories on the *relative* path, extension
   allow-list, size cap) is applied to the listing, before any byte is
   read; ignored directories are also pruned while walking.
3. eligible files are dealt by path and read in bounded batches; size and
   time of the listing travel with them, so nothing is joined back;
   decoding, newline normalisation and hashing happen in JVM expressions
   (:func:`quarry.operators.records.file_records`).

Files must live on storage every executor can see under the same path.
Links to directories are not followed (they can form cycles); links to
files are read.  Dot-files, ``_``-files and empty files are listed; empty
contents are dropped at the record stage.  What cannot be listed or read
comes out of :func:`scan_rejects`.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import config
from quarry.functions.text import path_extension
from quarry.operators.filters import eligible_files, max_bytes
from quarry.operators.records import file_records

ENTRY = T.StructType([
    T.StructField("repo_name", T.StringType()),
    T.StructField("root", T.StringType()),
    T.StructField("rel", T.StringType()),
    T.StructField("kind", T.StringType()),          # 'f' file, 'd' directory, 'e' error
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.DoubleType()),
    T.StructField("error", T.StringType()),
])
CONTENT = T.StructType([
    T.StructField("repo_name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("full_path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("modified", T.TimestampType()),
    T.StructField("raw", T.BinaryType()),
    T.StructField("error", T.StringType()),
])
BATCH_BYTES = 32 << 20
CHUNK_ROWS = 10_000


def validate_root(path: str) -> str:
    """A scan root must be an existing directory."""
    if not os.path.isdir(path):
        raise ValueError(f"cannot scan {path!r}: no such directory")
    return os.path.abspath(path)


def _list_directory(repo, root, rel, ignore):
    """Entries of one directory: files, sub-directories ('d') and errors."""
    d = os.path.join(root, rel) if rel else root
    try:
        with os.scandir(d) as it:
            for ent in it:
                r = f"{rel}/{ent.name}" if rel else ent.name
                try:
                    if ent.is_dir(follow_symlinks=False):
                        if ent.name not in ignore:
                            yield (repo, root, r, "d", None, None, None)
                    elif ent.is_file(follow_symlinks=True):
                        st = ent.stat(follow_symlinks=True)
                        yield (repo, root, r, "f", int(st.st_size), float(st.st_mtime), None)
                except OSError as e:
                    yield (repo, root, r, "e", None, None, type(e).__name__)
    except OSError as e:
        yield (repo, root, rel, "e", None, None, type(e).__name__)


def _lister(ignore: frozenset, budget: int):
    cols = [f.name for f in ENTRY.fields]

    def frame(rows):
        return pd.DataFrame(rows, columns=cols).astype({"size": "Int64", "mtime": "float64"})

    def run(batches):
        rows, listed = [], 0
        for pdf in batches:
            for repo, root, rel in zip(pdf["repo_name"], pdf["root"], pdf["rel"]):
                todo = [rel]
                while todo and (listed < budget or todo == [rel]):       # at least the directory that was given
                    listed += 1
                    for entry in _list_directory(repo, root, todo.pop(), ignore):
                        if entry[3] == "d":
                            todo.append(entry[2])
                        else:
                            rows.append(entry)
                        if len(rows) >= CHUNK_ROWS:
                            yield frame(rows)
                            rows = []
                rows.extend((repo, root, r, "d", None, None, None) for r in todo)
        if rows:
            yield frame(rows)

    return run


def roots_frame(spark: SparkSession, roots: Sequence[tuple[str, str] | str]) -> DataFrame:
    """(root, repo_name) pairs; a bare path is named after its last part."""
    rows = []
    for r in roots:
        path, name = (r, None) if isinstance(r, str) else r
        path = validate_root(path)
        rows.append((path, name or os.path.basename(path.rstrip("/"))))
    return spark.createDataFrame(rows, "root string, repo_name string")


def list_files(roots: DataFrame, ignore: Iterable[str] = config.IGNORE_DIRS, budget: int = 2000,
               parallelism: int | None = None) -> DataFrame:
    """All regular files below each root: repo_name, root, path (relative),
    full_path, size, modified; plus kind='e' rows for listing errors."""
    from quarry.session import scratch_path, ship_package

    spark = roots.sparkSession
    ship_package(spark)
    ign = frozenset(ignore)
    n = parallelism or spark.sparkContext.defaultParallelism
    base = scratch_path(spark, "listing")
    frontier = roots.select("repo_name", "root", F.lit("").alias("rel"))
    rounds = 0
    while rounds == 0 or frontier.take(1):
        frontier.repartition(n).mapInPandas(_lister(ign, budget), ENTRY).write.parquet(f"{base}/round={rounds}")
        frontier = (spark.read.schema(ENTRY).parquet(f"{base}/round={rounds}").where(F.col("kind") == "d").select("repo_name", "root", "rel"))
        rounds += 1
    out = spark.read.schema(ENTRY).parquet(*[f"{base}/round={i}" for i in range(rounds)]).where(F.col("kind") != "d")
    return out.select(
        "repo_name", "root", F.col("rel").alias("path"),
        F.concat(F.col("root"), F.lit("/"), F.col("rel")).alias("full_path"),
        "size", F.timestamp_seconds("mtime").alias("modified"), "kind", "error")


def _reader(batch_bytes: int, keep_bytes: bool):
    cols = [f.name for f in CONTENT.fields]

    def run(batches):
        rows, acc = [], 0
        for pdf in batches:
            for repo, path, full, size, modified in zip(pdf["repo_name"], pdf["path"], pdf["full_path"], pdf["size"], pdf["modified"]):
                data, error = None, None
                try:
                    with open(full, "rb") as fh:
                        data = fh.read()
                    acc += len(data)
                except OSError as e:
                    error = type(e).__name__
                rows.append((repo, path, full, size, modified, data if keep_bytes else None, error))
                if acc >= batch_bytes or len(rows) >= CHUNK_ROWS:
                    yield pd.DataFrame(rows, columns=cols)
                    rows, acc = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=cols)

    return run


def read_listed(listing: DataFrame, allowed=config.SUPPORTED_EXTENSIONS, ignore=config.IGNORE_DIRS, limit_bytes: int | None = None,
                parallelism: int | None = None, batch_bytes: int = BATCH_BYTES, keep_bytes: bool = True) -> DataFrame:
    """Eligible files of a listing with their bytes, or the error that
    reading them gave."""
    from quarry.session import ship_package

    spark = listing.sparkSession
    ship_package(spark)
    n = parallelism or spark.sparkContext.defaultParallelism
    files = listing.where(F.col("kind") == "f").withColumn("extension", path_extension("path"))
    files = eligible_files(files, allowed, ignore, max_bytes() if limit_bytes is None else limit_bytes)
    return (files.select("repo_name", "path", "full_path", "size", "modified").repartition(n, "path")
            .mapInPandas(_reader(batch_bytes, keep_bytes), CONTENT))


def scan_listing(listing: DataFrame, **kw) -> DataFrame:
    """Eligible files of a listing, read and turned into file records."""
    got = read_listed(listing, **kw).where(F.col("error").isNull())
    return file_records(got, raw_col="raw", keep=("repo_name",))


def scan_rejects(listing: DataFrame, **kw) -> DataFrame:
    """What a scan of this listing cannot deliver: entries that could not be
    listed and eligible files that could not be read (repo_name, path, reason)."""
    listed = listing.where(F.col("kind") == "e").select("repo_name", "path", F.col("error").alias("reason"))
    unread = read_listed(listing, keep_bytes=False, **kw).where(F.col("error").isNotNull())
    return listed.unionByName(unread.select("repo_name", "path", F.col("error").alias("reason")))


def scan_files(spark: SparkSession, roots, **kw) -> DataFrame:
    """File records for one root or many (S1/S3): ``roots`` is a path, a
    list of paths or (path, repo_name) pairs, or a roots DataFrame."""
    if isinstance(roots, str):
        roots = [roots]
    rdf = roots if isinstance(roots, DataFrame) else roots_frame(spark, roots)
    listing = list_files(rdf, kw.get("ignore", config.IGNORE_DIRS))
    return scan_listing(listing, **kw)
