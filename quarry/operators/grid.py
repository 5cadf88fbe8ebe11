"""A grid of blocks: every query row against every corpus row.

The corpus is dealt into parts of about ``block_rows`` rows, each moved once
and held by one task; the queries are sent to every part and stream past its
block in Arrow batches.  That is the plan at every size.  A task holds one
block and one batch; shuffled are the corpus once and the queries once per
part; nothing goes through the driver.  A kernel sees one block and one batch
at a time and returns what it wants of their pairs, such as the local best k
of every query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A kernel factory: from the batches of a block to a function that maps a
# batch of queries to batches of results.
Kernel = Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]
MakeKernel = Callable[[pa.Table], Kernel]


def _cells(batches: Iterator[pa.RecordBatch], make: MakeKernel) -> Iterator[pa.RecordBatch]:
    """Rows of a task come part by part, the block before the queries."""
    part, block, kernel = None, [], None
    for batch in batches:
        run = batch.column("part").to_numpy() * 2 + batch.column("side").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            if run[lo] // 2 != part:
                part, block, kernel = run[lo] // 2, [], None
            rows = batch.slice(lo, hi - lo)
            if run[lo] % 2 == 0:
                block.append(pa.RecordBatch.from_struct_array(rows.column("c")))
            elif block or kernel:
                if kernel is None:
                    kernel, block = make(pa.Table.from_batches(block)), []
                yield from kernel(pa.RecordBatch.from_struct_array(rows.column("q")))


def block_grid(queries: DataFrame, corpus: DataFrame, make: MakeKernel, schema, block_rows: int = 65536,
               n_rows: int | None = None, parts: int | None = None, deal: Column | None = None) -> DataFrame:
    """What ``make``'s kernels return for all (block, batch) pairs.

    ``n_rows``: the corpus' row count, if known.  A corpus that is already
    cut gives the number of ``parts`` and the part of a row (``deal``);
    otherwise rows are dealt in turn."""
    from quarry.session import ship_package

    spark = corpus.sparkSession
    ship_package(spark)
    if parts is None:
        n = corpus.count() if n_rows is None else n_rows
        # Every part gets all queries, so there are only as many as blocks or cores.
        parts = max(math.ceil(n / block_rows), spark.sparkContext.defaultParallelism)
    at = F.monotonically_increasing_id() if deal is None else deal
    c_row, q_row = F.struct(*corpus.columns), F.struct(*queries.columns)
    c_type, q_type = corpus.select(c_row).schema[0].dataType, queries.select(q_row).schema[0].dataType
    held = corpus.select(F.pmod(at, F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("side"), c_row.alias("c"), F.lit(None).cast(q_type).alias("q"))
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("side"), F.lit(None).cast(c_type).alias("c"), q_row.alias("q"))
    dealt = held.unionByName(sent).repartitionById(parts, "part").sortWithinPartitions("part", "side")
    return dealt.mapInArrow(lambda batches: _cells(batches, make), schema)


def vectors(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; a null one is all NaN, one of
    another width an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = ~column.is_null().to_numpy(zero_copy_only=False)
    out = np.full((len(column), width), np.nan)
    present = column.drop_null()
    lens = present.value_lengths().to_numpy(zero_copy_only=False)
    if len(lens) and (lens != width).any():
        raise ValueError(f"vector width {int(lens[lens != width][0])} does not match {width}")
    out[valid] = present.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def best_k(scores: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of every row, ordered by row and rank.
    Equal scores go by column; NaN comes last; ``allowed`` marks the cells
    that may be taken."""
    key = np.where(np.isnan(scores), -np.inf, scores)
    n = scores.shape[1]
    mask = np.ones(scores.shape, dtype=bool) if allowed is None else allowed
    if n > k:
        cut = np.where(mask, key, -np.inf)
        mask = mask & (key >= np.partition(cut, n - k, axis=1)[:, n - k][:, None])
    rows, cols = np.nonzero(mask)
    order = np.lexsort((cols, -key[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep]
