"""Documents written out as a directory tree, for the scan queries."""

from __future__ import annotations

import os

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path, ship_package


def fresh_tree(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, as a POSIX path."""
    path = scratch_path(spark, "tree")
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if not path.startswith("/"):
        raise ValueError("scanning a file tree needs a checkpoint folder that is mounted as a POSIX path")
    return path


def write_tree(files: DataFrame, root: str, encoding: str = "utf-8") -> int:
    """Write each row's content to ``root/<path>`` from the executors; text
    that ``encoding`` cannot express is written as UTF-8.  Returns the
    number of files."""
    def write(batches):
        n = 0
        for batch in batches:
            for p, c in zip(batch.column("path"), batch.column("content")):      # one text as a Python string at a time
                p, c = p.as_py(), c.as_py()
                full = os.path.join(root, p)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                try:
                    data = c.encode(encoding)
                except UnicodeEncodeError:
                    data = c.encode("utf-8")
                with open(full, "wb") as fh:
                    fh.write(data)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    ship_package(files.sparkSession)
    return files.select("path", "content").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def remove_files(files: DataFrame, root: str) -> int:
    """Remove the files of these rows' paths again."""
    def remove(it):
        n = 0
        for pdf in it:
            for p in pdf["path"]:
                os.remove(os.path.join(root, p))
                n += 1
        yield pd.DataFrame({"n": [n]})

    ship_package(files.sparkSession)
    return files.select("path").mapInPandas(remove, "n long").agg(F.sum("n")).first()[0] or 0
