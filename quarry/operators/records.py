"""File records: decoded, newline-normalised, hashed text plus metadata,
the document payload defaults and the text handed to an embedder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.text import (
    content_hash, decode_text, embedding_text, normalize_newlines, path_extension,
)

FILE_RECORD_COLUMNS = ("path", "full_path", "content", "extension", "size", "modified", "hash")


def file_records(files: DataFrame, raw_col: str | None = None, content_col: str = "content",
                 root: str | None = None, keep: tuple[str, ...] = (), include_empty: bool = False) -> DataFrame:
    """Build the file record.

    Input needs ``path`` and either bytes (``raw_col``, decoded UTF-8 with
    a Latin-1 fallback) or text (``content_col``); ``size`` (on-disk bytes)
    and ``modified`` are used when present.  Text gets universal newlines
    before hashing; empty texts are dropped unless ``include_empty``.
    """
    text = decode_text(raw_col) if raw_col else F.col(content_col)
    cols = files.columns
    full = F.col("full_path") if "full_path" in cols else (
        F.concat(F.lit(root.rstrip("/") + "/"), F.col("path")) if root else F.col("path"))
    size = F.col("size").cast("bigint") if "size" in cols else F.octet_length(text).cast("bigint")
    modified = F.col("modified").cast("timestamp") if "modified" in cols else F.lit(None).cast("timestamp")
    out = files.select(
        *keep, F.col("path"), full.alias("full_path"), normalize_newlines(text).alias("content"),
        path_extension("path").alias("extension"), size.alias("size"), modified.alias("modified"),
    )
    if not include_empty:
        out = out.where(F.length("content") > 0)
    return out.withColumn("hash", content_hash("content"))


def with_repo_name(files: DataFrame, name: str | None, derived) -> DataFrame:
    """Effective repository name: the given one unless empty, else derived."""
    return files.withColumn("repo_name", F.coalesce(F.lit(name or None).cast("string"), derived))


def index_payload(docs: DataFrame) -> DataFrame:
    """Payload defaults for index rows: missing repo -> "unknown",
    extension/hash -> "", size -> 0, and the time of indexing; path and
    content are required (a null one fails the job)."""
    cols = docs.columns
    for req in ("path", "content"):
        if req not in cols:
            raise ValueError(f"documents need a {req!r} column")

    def opt(name, default, typ):
        return F.coalesce(F.col(name).cast(typ), F.lit(default).cast(typ)) if name in cols \
            else F.lit(default).cast(typ)

    def required(name):
        return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"a document without {name}"))).otherwise(F.col(name)).alias(name)

    return docs.select(
        *[c for c in cols if c not in ("path", "content", "repo_name", "extension", "size", "hash", "modified", "added_at")],
        required("path"), required("content"),
        opt("repo_name", config.DEFAULT_REPO_NAME, "string").alias("repo_name"),
        opt("extension", "", "string").alias("extension"),
        opt("size", 0, "bigint").alias("size"),
        (F.col("modified").cast("timestamp") if "modified" in cols else F.lit(None).cast("timestamp")).alias("modified"),
        opt("hash", "", "string").alias("hash"),
        F.current_timestamp().alias("added_at"),
    )


def with_embedding_text(docs: DataFrame, path_col: str = "path", content_col: str = "content",
                        out: str = "embedding_text") -> DataFrame:
    return docs.withColumn(out, embedding_text(path_col, content_col))
