"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import scratch_path, ship_package

# A word is a run of characters other than the ASCII space, tab, newline,
# vertical tab, form feed and carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
find_words = re.compile(WORD_PATTERN).findall


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0), JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back:
    cuts the lineage, survives lost executors, and lets several consumers
    read the result with column pruning."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of whole texts handed to a Python worker at once.
BATCH_ROWS = 1000


def prepare_python(spark: SparkSession) -> None:
    """Ship this package to the workers, and keep Arrow batches of texts
    small: the default of 10,000 rows is far too many when a row is a
    document."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package shipped to the workers."""
    prepare_python(df.sparkSession)
    return df.mapInArrow(fn, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(docs: DataFrame, parts: int, column: str = "doc_id") -> list[int]:
    """At most ``parts - 1`` ascending cut points that split the rows into
    ranges of about equal row counts.  One small aggregate over the id
    column; the driver gets a list bounded by ``parts``."""
    if parts < 2:
        return []
    cuts = [i / parts for i in range(1, parts)]
    got = docs.agg(F.percentile_approx(column, cuts, max(10_000, 20 * parts)).alias("q")).first()["q"]
    return sorted(set(got or []))


def range_bucket(column: Column, bounds: list[int], stride: int = 64) -> Column:
    """Index of the range a value falls in (null: 0, before all values):
    the number of cut points at or below it.  Two steps over literal
    arrays: every ``stride``-th cut first, then the ``stride`` cuts there."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    coarse = F.array(*[F.lit(b).cast("bigint") for b in bounds[stride - 1::stride]]).cast("array<bigint>")
    at = F.size(F.filter(coarse, lambda x: x <= column)) * stride
    return at + F.size(F.filter(F.slice(cuts, at + 1, stride), lambda x: x <= column))


# ------------------------------------------------------------ ordered groups

def in_order(df: DataFrame, key: str, order: list[Column], keep: list[str], name: str) -> DataFrame:
    """``key``, ``keep`` and ``seq`` of every row, staged: ``seq`` rises along
    each key in the given order, and its upper bits (``seq >> 33``) are the
    task a row went to.

    Rows are dealt by ranges of (key, order, row), so a key of any size, and
    even one repeated row, is spread over tasks; what is only needed for the
    order is not written."""
    tie = df.withColumn("__tie", F.monotonically_increasing_id())
    by = [F.col(key), *order, F.col("__tie")]
    dealt = tie.repartitionByRange(shuffle_partitions(df.sparkSession), *by).sortWithinPartitions(*by)
    return stage_table(dealt.select(key, *keep, F.monotonically_increasing_id().alias("seq")), name)


def running(dealt: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Running sums (own row included) along each non-null key of a table of
    :func:`in_order`.  A window sums what one task holds of a key; the sum of
    the tasks before it is looked up.  Only the first key of a task can have
    rows in earlier tasks, so that table has at most a row per task and is
    broadcast."""
    rows = dealt.withColumn("__task", F.shiftright("seq", 33)).withColumns({f"__v_{n}": c for n, c in sums.items()})
    first = rows.groupBy("__task").agg(F.min(key).alias(key)).select(key).distinct()
    parts = rows.join(F.broadcast(first), key, "left_semi").groupBy(key, "__task").agg(*[F.sum(f"__v_{n}").alias(f"__b_{n}") for n in sums])
    earlier = Window.partitionBy(key).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(key, "__task", *[F.sum(f"__b_{n}").over(earlier).alias(f"__b_{n}") for n in sums])
    before = before.where(F.col(f"__b_{next(iter(sums))}").isNotNull())
    before = stage_table(before, "sums-before")
    here = Window.partitionBy(key, "__task").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({n: F.sum(f"__v_{n}").over(here) for n in sums})
    out = local.join(F.broadcast(before), [key, "__task"], "left")
    return out.withColumns({n: F.col(n) + F.coalesce(f"__b_{n}", F.lit(0)) for n in sums}).drop(
        "__task", *[f"__{k}_{n}" for n in sums for k in "vb"])


HOT_GROUPS = 1000


def join_unique(rows: DataFrame, groups: DataFrame, on: str, size: str, n_rows: int) -> DataFrame:
    """Inner join of ``rows`` with a table that has one row per ``on`` and,
    in ``size``, how many of the ``n_rows`` rows have it.  Groups with more
    than ``n_rows / HOT_GROUPS`` rows, of which there are fewer than
    ``HOT_GROUPS``, are broadcast and their rows stay where they are; the
    others meet by a shuffle that no group of theirs can make uneven."""
    limit = max(HOT_GROUPS, n_rows // HOT_GROUPS)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    rest = rows.join(hot.select(on), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(cold, on))
