"""Index maintenance as DataFrame operators: ids, change detection,
removal, replacement and incremental upsert.  Each returns the rows that
should be stored; :mod:`quarry.sources.store` writes them.

Keys are (repo_name, path); ids are deterministic, so re-adding a
repository is idempotent.  Joins are on unique keys (one row per file),
so a repository holding a third of the corpus does not skew them; small
name lists go through Spark's size-checked broadcast threshold.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("repo_name", "path")


def doc_id(repo_col: str = "repo_name", path_col: str = "path") -> Column:
    """Deterministic document id: sha256 of repo_name, 0x1F, path."""
    return F.sha2(F.concat(F.col(repo_col), F.lit("\x1f"), F.col(path_col)), 256)


def with_doc_id(df: DataFrame, out: str = "doc_id") -> DataFrame:
    return df.withColumn(out, doc_id())


def diff_snapshots(old: DataFrame, new: DataFrame, key=KEY, hash_col: str = "hash") -> DataFrame:
    """Full outer join on the key: change is added, removed, changed or
    unchanged.  Presence is a flag of each side, so a null hash is a value
    like any other (two nulls are unchanged)."""
    o = old.select(*key, F.col(hash_col).alias("old_hash"), F.lit(True).alias("__old"))
    n = new.select(*key, F.col(hash_col).alias("new_hash"), F.lit(True).alias("__new"))
    j = o.join(n, list(key), "full_outer")
    return j.withColumn("change", _change("old_hash", "new_hash")).drop("__old", "__new")


def _change(old_hash: str, new_hash: str) -> Column:
    return (F.when(F.col("__old").isNull(), "added")
            .when(F.col("__new").isNull(), "removed")
            .when(F.col(old_hash).eqNullSafe(F.col(new_hash)), "unchanged")
            .otherwise("changed"))


def names_frame(spark, names: Iterable[str], col: str = "repo_name") -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"{col} string")


def remove_repos(index: DataFrame, repos: DataFrame, repo_col: str = "repo_name") -> DataFrame:
    """Index rows whose repository is not in ``repos`` (anti join)."""
    return index.join(repos.select(F.col(repo_col)).distinct(), repo_col, "left_anti")


def known_repos(names: DataFrame, registry: DataFrame, repo_col: str = "repo_name",
                reg_col: str = "name") -> DataFrame:
    """Names that are registered (semi join)."""
    reg = registry.select(F.col(reg_col).alias(repo_col))
    return names.join(reg, repo_col, "left_semi")


def update_repo(index: DataFrame, new_rows: DataFrame, repo: str, repo_col: str = "repo_name") -> DataFrame:
    """Replace one repository's rows by a fresh scan of it.  If the scan
    is empty the repository's rows are gone (its registry row stays)."""
    keep = index.where(~F.col(repo_col).eqNullSafe(F.lit(repo)))
    fresh = new_rows.where(F.col(repo_col) == F.lit(repo)).select(*index.columns)
    return keep.unionByName(fresh)


def incremental_upsert(old_index: DataFrame, new_files: DataFrame, embed, key=KEY,
                       hash_col: str = "hash") -> DataFrame:
    """New index = unchanged rows (old vectors kept) + added/changed rows
    embedded now; removed rows dropped.  ``embed`` maps a files frame to
    the index schema; it only sees the delta and must keep ``change``.

    Only keys and hashes meet in the full outer join.  What differs is
    written once; old rows and new files are joined with that, so neither
    vectors nor texts of unchanged rows move while the delta is small enough
    for Spark to broadcast its keys."""
    from quarry.session import scratch_path

    spark = old_index.sparkSession
    key = list(key)
    differs = diff_snapshots(old_index, new_files, key, hash_col).where(F.col("change") != "unchanged").select(*key, "change")
    path = scratch_path(spark, "delta")
    differs.write.parquet(path)
    differs = spark.read.schema(differs.schema).parquet(path)
    unchanged = old_index.join(differs.select(*key), key, "left_anti").withColumn("change", F.lit("unchanged"))
    delta = embed(new_files.join(differs.where(F.col("change") != "removed"), key))
    return unchanged.unionByName(delta, allowMissingColumns=True)


def registry_from_files(files: DataFrame, source=None, is_url: bool = False, repo_col: str = "repo_name",
                        data_file: str | None = None, repo_path=None) -> DataFrame:
    """One registry row per repository: name, source, is_url, processed_at,
    files_processed, data_file (its snapshot) and repo_path."""
    src = source if source is not None else F.concat(F.lit("local:"), F.col(repo_col))
    from quarry.sources.snapshot import snapshot_folder

    snapshot = F.concat(F.lit(f"{data_file}/"), snapshot_folder(F.col(repo_col))) if data_file else F.lit(None).cast("string")
    return files.groupBy(repo_col).agg(F.count(F.lit(1)).alias("files_processed")).select(
        F.col(repo_col).alias("name"), src.alias("source"), F.lit(is_url).alias("is_url"),
        F.current_timestamp().alias("processed_at"), "files_processed",
        snapshot.alias("data_file"), (repo_path if repo_path is not None else F.col(repo_col)).alias("repo_path"))


def export_stats(stats: DataFrame, path: str) -> None:
    """Write ``stats`` (one row) as one JSON document with its export time."""
    stats.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("exported_at"),
                 F.struct(*stats.columns).alias("stats")).write.mode("overwrite").json(path)


def read_export(spark, path: str, stats_schema) -> DataFrame:
    """The statistics of an export, as they were written."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("exported_at", T.StringType()), T.StructField("stats", stats_schema)])
    return spark.read.schema(schema).json(path).select("stats.*")


def upsert_files(store, files: DataFrame, embed) -> int:
    """Bring a store up to date with files that arrived (repo_name, path,
    content, hash and other payload; of a repeated path any one counts): new
    ones are added, changed ones replaced, others left; returns how many
    differed.  ``embed`` maps payload rows to vector rows and sees only what
    differs.  What differs is laid on top of what a repository has, and only
    once its layers would hold more rows than it has files it is written anew
    as a whole, so what is written grows with the changes and not with the
    store.  The repositories with a difference are switched in one step, and
    files that are already in the store as they are change nothing, so a
    batch that is applied again is harmless."""
    from quarry.operators.records import index_payload
    from quarry.session import scratch_path

    spark = files.sparkSession

    def staged(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    new = staged(index_payload(with_doc_id(files.dropDuplicates(list(KEY)))), "arrived")
    docs = store.read("docs")
    # only keys and hashes of the store meet the batch, and only those of its files
    had = new.limit(0) if docs is None else docs.select(*KEY, "hash").join(new.select(*KEY), list(KEY), "left_semi")
    differs = diff_snapshots(had, new).where(F.col("change").isin("added", "changed"))
    differs = staged(differs.select(*KEY, "change"), "differs")
    come = {r[0]: r[1] for r in differs.groupBy("repo_name").count().collect()}        # repositories of one micro-batch
    if not come:
        return 0
    delta = new.join(differs.select(*KEY), list(KEY), "left_semi")
    vectors = embed(delta)
    if docs is None:
        store.add(delta, vectors, registry_from_files(delta))
        return sum(come.values())
    had_vectors = store.read("vectors")
    had_vectors = vectors.limit(0) if had_vectors is None else had_vectors
    delta, vectors = (a.limit(0).unionByName(b, allowMissingColumns=True) for a, b in ((docs, delta), (had_vectors, vectors)))
    top = []
    if delta.dtypes == docs.dtypes and vectors.dtypes == had_vectors.dtypes:
        now = store.get_all(come)
        top = [n for n, r in now.items() if r and (r["stacked"] or 0) + come[n] <= (r["files_processed"] or 0)]
    counted = docs.where(F.col("repo_name").isin(list(come))).select("repo_name").unionByName(differs.where(F.col("change") == "added").select("repo_name"))
    ids, changed = delta.select("doc_id"), new.join(differs.where(F.col("change") == "changed").select(*KEY), list(KEY), "left_semi")
    if whole := [n for n in come if n not in top]:
        again = F.col("repo_name").isin(whole)
        delta = docs.where(again).join(differs.select(*KEY), list(KEY), "left_anti").unionByName(delta)
        vectors = had_vectors.where(again).join(ids, "doc_id", "left_anti").unionByName(vectors)
    store.add(delta, vectors, registry_from_files(counted), on_top=top, replaced=changed.where(F.col("repo_name").isin(top)))
    return sum(come.values())
