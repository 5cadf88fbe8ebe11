"""Site-relative line dedup (DataFrame functions only).

A line is boilerplate of a host when the share of the host's pages that
contain it exceeds ``max_ratio`` beyond what chance explains: the share minus
one standard error (the lower end of its Wilson interval) has to exceed it,
and the line has to be on two pages at least.  The rule is the same for a host
of two pages and of millions; the more pages, the closer it is to the plain
ratio.  Such lines are dropped from every page of that host; other hosts keep
them.

Lines are compared after trimming ASCII white space, by 64-bit hash; blank
lines never count and always stay.  Every line of every page is counted:
per page the distinct hashes are taken in the row, and (host, hash) counts
are combined map-side before the shuffle, so a hot host or a line on every
page costs one row per task.  At most ``lines per page / max_ratio`` lines
of a host can exceed the ratio, which bounds the per-host list that is
joined back; texts are never shuffled when the lists fit the checked
broadcast bound.

Edge cases: a null host is a host of its own; a null text is a page without
lines and stays null; repeated rows are separate pages; a text of any length
is read whole, line by line, and a line counts once per page; equal shares are
treated alike, no order decides; rows are carried in a struct, so other
columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage_table

# One page in twenty.  A share counted over n pages is off by sqrt(p(1-p)/n),
# so a ratio at the rate of the block itself would drop or keep it by chance;
# at half a rate of one in ten a block is 3.7 such errors away on 500 pages.
MAX_RATIO = 0.05
# Lists are broadcast only when their measured total is at most this many
# hashes (8 bytes each) and hosts; else they are joined by shuffle.
BROADCAST_LINES = 1_000_000

_BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """Hash of a trimmed line; null for a blank one."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(bare != "", F.xxhash64(bare))


def line_frequencies(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """(host, line, pages, host_pages) of every line on at least one page."""
    pages = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_pages"))
    keys = F.array_distinct(F.transform(F.split(F.col(text), "\n"), line_key))
    lines = (docs.select(F.col(host).alias("host"), F.explode(keys).alias("line")).where("line is not null")
             .groupBy("host", "line").agg(F.count("*").alias("pages")))
    return (lines.alias("l").join(pages.alias("p"), F.col("l.host").eqNullSafe(F.col("p.host")))
            .select("l.host", "l.line", "l.pages", "p.host_pages"))


def sure_share(pages: Column, host_pages: Column) -> Column:
    """Lower end of the Wilson interval of one standard error around a share."""
    p, n = pages / host_pages, host_pages.cast("double")
    return (p + 0.5 / n - F.sqrt(p * (1 - p) / n + 0.25 / (n * n))) / (1 + 1 / n)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """(host, lines): the hashes to drop, one row per host that has any."""
    freq = line_frequencies(docs, host, text)
    return (freq.where((F.col("pages") >= 2) & (sure_share(F.col("pages"), F.col("host_pages")) > max_ratio))
            .groupBy("host").agg(F.collect_list("line").alias("lines")))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """Every row of ``docs`` as the struct ``row``, with ``kept`` (the text
    without boilerplate lines) and ``dropped`` (number of lines dropped)."""
    bad = stage_table(boilerplate(docs, host, text, max_ratio), "boilerplate")
    size = bad.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("n")).first()["n"]
    bad = bad.select(F.col("host").alias("bad_host"), F.col("lines").alias("bad"))
    if size <= BROADCAST_LINES:
        bad = F.broadcast(bad)
    rows = docs.select(F.struct("*").alias("row"), F.col(host).alias("host"), F.col(text).alias("text"))
    joined = rows.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("bad"), line_key(x)), F.lit(False)))
    out = joined.withColumn("left", F.when(F.col("bad").isNotNull(), left))
    return out.select(
        "row", F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join("left", "\n")).alias("kept"),
        F.when(F.col("left").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("left")).cast("bigint").alias("dropped"))


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", length: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text, and the
    ``length`` column (code points), if named, brought up to date."""
    out = drop_boilerplate(docs, host, text, max_ratio)
    cols = []
    for c in docs.columns:
        own = F.col("row").getField(c)
        if c == text:
            cols.append(F.col("kept").alias(c))
        elif c == length:
            cols.append(F.when(F.col("dropped") > 0, F.length("kept")).otherwise(own).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(own.alias(c))
    return out.select(*cols)
