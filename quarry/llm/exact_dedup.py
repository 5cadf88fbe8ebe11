"""Exact dedup by two-pass Bloom filtering.

Texts are equal when they are the same after white space (the ASCII space,
tab, newline, vertical tab, form feed, carriage return) is deleted.  A filter
of ``CELLS`` cells per document is built twice, each time with another hash
of the normalised text's SHA-256: a cell is marked if two or more documents
fall in it.  The first pass counts every document's cell, the second only
those of documents whose first cell is marked.  A document that is not marked
in both passes has no equal and passes straight through: no column of it is
moved.  The others (all copies, and about one in
two hundred of the rest) are written once, grouped by SHA-256 and decided
exactly, so a filter that is too full costs time, never a result.

Passes one and two shuffle an 8-byte cell per document, summed before the
shuffle.  The marked cells are bitmaps of ``BITS`` bits; all of them together
have at most ``MAX_BYTES`` bytes whatever the corpus (cells per document
shrink beyond that), which is what is broadcast.  Copies meet by
:func:`~quarry.llm.common.join_unique`, so a group with a third of all rows
is split.

Result: of equal texts the row with the most characters in the original text
stays, then the one with the smallest id (null last); of rows that agree in
these too, exactly one.  Null counts as empty; all texts without any other
character are equal.  Very long texts are compared whole.  Rows are carried
in a struct, so other columns may have any name.  An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import join_unique, stage_table

SPACES = " \t\n\x0b\x0c\r"
CELLS = 16
BITS = 32768                    # of one bitmap, as Spark's bitmap functions fix it
MAX_BYTES = 256 * 1024 * 1024
SEEDS = (1, 2)                  # of the two passes


def text_key(text: Column) -> Column:
    """SHA-256 (lowercase hex) of a text without its white space."""
    bare = F.coalesce(text, F.lit(""))
    for space in SPACES:
        bare = F.replace(bare, F.lit(space), F.lit(""))
    return F.sha2(bare, 256)


def _cell(seed: int, cells: int) -> Column:
    return F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(cells))


def marked_cells(rows: DataFrame, seed: int, cells: int) -> DataFrame:
    """(bucket, bitmap): the cells in which two or more rows fall."""
    hits = rows.groupBy(_cell(seed, cells).alias("cell")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    at = hits.select(F.shiftright("cell", 15).alias("bucket"), (F.col("cell") % BITS).alias("bit"))
    return stage_table(at.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")), "bloom")


def with_mark(rows: DataFrame, marks: DataFrame, seed: int, cells: int, out: str) -> DataFrame:
    """``rows`` with ``out``: whether the row's cell is marked."""
    cell = _cell(seed, cells)
    found = rows.withColumns({"bucket": F.shiftright(cell, 15), "bit": (cell % BITS).cast("int")})
    found = found.join(F.broadcast(marks), "bucket", "left")
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright("bit", 3) + 1, F.lit(1))), 16, 10).cast("bigint")
    mark = F.coalesce(F.getbit(byte, F.col("bit") % 8) == 1, F.lit(False))
    return found.withColumn(out, mark).drop("bucket", "bit", "bitmap")


def mark_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", columns: list[str] | None = None,
                cells: int = CELLS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Every row of ``docs``: ``row`` (a struct of ``columns``, all if None),
    ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.  Given
    columns are written once beside the key; of whole rows only the key is
    written and it is computed again where they pass."""
    names = docs.columns if columns is None else columns
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(id).alias("id"),
                       F.length(F.coalesce(F.col(text), F.lit(""))).alias("size"), text_key(F.col(text)).alias("key"))
    if columns is None:
        keys = stage_table(rows.select("key"), "text-keys")
    else:
        keys = rows = stage_table(rows, "text-keys")
    cells = BITS * max(1, min(-(-keys.count() * cells // BITS), max_bytes * 8 // BITS))
    first = marked_cells(keys, SEEDS[0], cells)
    second = marked_cells(with_mark(keys, first, SEEDS[0], cells, "hit").where("hit"), SEEDS[1], cells)
    both = with_mark(with_mark(rows, first, SEEDS[0], cells, "hit1"), second, SEEDS[1], cells, "hit2")
    both = both.withColumn("hit", F.col("hit1") & F.col("hit2"))

    maybe = stage_table(both.where("hit").select("row", "id", "size", "key", F.monotonically_increasing_id().alias("at")), "maybe-copies")
    best = F.min(F.struct(-F.col("size"), F.col("id").isNull(), F.col("id").alias("id"), F.col("at").alias("at"))).alias("best")
    groups = stage_table(maybe.groupBy("key").agg(F.count(F.lit(1)).alias("n"), best), "copy-groups")
    copies = join_unique(maybe, groups, "key", "n", maybe.count())
    decided = copies.select("row", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
                            (F.col("at") == F.col("best.at")).alias("kept"), F.col("key").alias("text_sha256"))
    through = both.where(~F.col("hit")).select("row", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                                               F.lit(True).alias("kept"), F.col("key").alias("text_sha256"))
    return through.unionByName(decided)


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    return mark_copies(docs, id, text).where("kept").select("row.*")
