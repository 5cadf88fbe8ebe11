"""File eligibility predicates.  Each is a Column-level ``where`` so it is
pushed into the scan (Parquet pushdown for size/extension; for the file
tree source the same tests run on the listing, before bytes are read)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.text import path_has_ignored_dir


def max_bytes(max_file_size_mb: float = config.MAX_FILE_SIZE_MB) -> int:
    return int(max_file_size_mb * config.MIB)


def filter_ignored_dirs(files: DataFrame, ignore: Iterable[str] = config.IGNORE_DIRS,
                        path_col: str = "path") -> DataFrame:
    return files.where(~path_has_ignored_dir(path_col, ignore))


def filter_extension(files: DataFrame, allowed: Iterable[str] = config.SUPPORTED_EXTENSIONS,
                     ext_col: str = "extension") -> DataFrame:
    return files.where(F.col(ext_col).isin(*sorted(allowed)))


def filter_size(files: DataFrame, limit_bytes: int | None = None, size_col: str = "size") -> DataFrame:
    """Keep files of at most ``limit_bytes`` (default 2 MiB); equality kept."""
    limit = max_bytes() if limit_bytes is None else limit_bytes
    return files.where(F.col(size_col) <= F.lit(limit))


def filter_nonempty(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Drop empty content; whitespace-only content is kept."""
    return files.where(F.length(content_col) > 0)


def eligible_files(files: DataFrame, allowed: Iterable[str] = config.SUPPORTED_EXTENSIONS,
                   ignore: Iterable[str] = config.IGNORE_DIRS, limit_bytes: int | None = None,
                   path_col: str = "path", ext_col: str = "extension", size_col: str = "size") -> DataFrame:
    """All listing-level tests in one conjunction, cheapest first."""
    limit = max_bytes() if limit_bytes is None else limit_bytes
    cond = ((F.col(size_col) <= F.lit(limit))
            & F.col(ext_col).isin(*sorted(allowed))
            & ~path_has_ignored_dir(path_col, ignore))
    return files.where(cond)


def filter_repo(df: DataFrame, repo: str | None, repo_col: str = "repo_name") -> DataFrame:
    """Repository equality filter; None or "" means no filter."""
    return df if repo is None or repo == "" else df.where(F.col(repo_col) == F.lit(repo))
