"""Files as a data source: ``spark.read.format("quarry_files")``.

The listing is a Spark job (:func:`quarry.sources.filetree.list_files`), dealt
to ``parts`` by path and written to the shared folder; the reader has one
partition per file of that listing, so planning touches a list of file names
and no entry of the tree.  Filters on size and extension are pushed into the
reader and applied to listing entries, so a file that a query does not want is
never opened.  Bytes leave a task in batches of bounded size; what cannot be
read is a row with ``error``.

The listing folder must be one that the executors see as files, like the tree
itself.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

from quarry import config

FORMAT = "quarry_files"
SCHEMA = "repo_name string, path string, full_path string, extension string, size bigint, modified timestamp, raw binary, error string"
BATCH_BYTES = 4 << 20      # a batch is held as Python bytes and as Arrow at once
BATCH_ROWS = 1_000


class ListedFiles(InputPartition):
    """One file of the listing."""


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        place = urlparse(options["listing"])
        if place.scheme not in ("", "file"):
            raise ValueError(f"the listing must be in a folder that executors see as files, not {options['listing']!r}")
        self.listing = place.path
        self.max_size: int | None = None
        self.extensions: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("size",) and isinstance(f, (LessThanOrEqual, LessThan)):
                most = f.value if isinstance(f, LessThanOrEqual) else f.value - 1
                self.max_size = most if self.max_size is None else min(self.max_size, most)
            elif column == ("extension",) and isinstance(f, (In, EqualTo)):
                some = frozenset(f.value if isinstance(f, In) else [f.value])
                self.extensions = some if self.extensions is None else self.extensions & some
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        names = sorted(n for n in os.listdir(self.listing) if n.endswith(".parquet"))
        return [ListedFiles(os.path.join(self.listing, n)) for n in names]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("repo_name", pa.string()), ("path", pa.string()), ("full_path", pa.string()), ("extension", pa.string()), ("size", pa.int64()),
                            ("modified", pa.timestamp("us", tz="UTC")), ("raw", pa.binary()), ("error", pa.string())])
        rows: list[dict] = []
        held = 0
        for batch in pq.ParquetFile(partition.value).iter_batches(BATCH_ROWS):
            for e in batch.to_pylist():
                if self.max_size is not None and e["size"] > self.max_size or self.extensions is not None and e["extension"] not in self.extensions:
                    continue
                raw = error = None
                try:
                    with open(e["full_path"], "rb") as f:
                        raw = f.read()
                except OSError as x:
                    error = type(x).__name__
                rows.append({**e, "raw": raw, "error": error})
                held += len(raw or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class FileTreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FileTreeReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and switch on the push-down of
    filters into Python sources."""
    from quarry.session import ship_package

    ship_package(spark)
    spark.dataSource.register(FileTreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_listing(spark: SparkSession, roots, path: str, ignore: Iterable[str] = config.IGNORE_DIRS, parts: int | None = None) -> str:
    """List trees (a path, paths, (path, name) pairs or a roots DataFrame) into ``path``."""
    from quarry.functions.text import path_extension
    from quarry.sources.filetree import list_files, roots_frame

    frame = roots if isinstance(roots, DataFrame) else roots_frame(spark, [roots] if isinstance(roots, str) else roots)
    files = list_files(frame, ignore).where(F.col("kind") == "f")
    files = files.select("repo_name", "path", "full_path", path_extension("path").alias("extension"), "size", "modified")
    files.repartition(parts or spark.sparkContext.defaultParallelism, "full_path").write.parquet(path)
    return path


def open_files(spark: SparkSession, listing: str) -> DataFrame:
    """Listed files with their bytes; filter on ``size`` and ``extension``
    to say which are opened."""
    register(spark)
    return spark.read.format(FORMAT).option("listing", listing).load()
