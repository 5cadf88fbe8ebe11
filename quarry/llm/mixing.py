"""Mixing sources to target weights by capped water-filling.

Every source gets ``level * weight`` words, clamped at ``max_epochs`` times
its own size; what a clamp leaves over raises the level for the others, in
proportion to their weights, until no source is above its clamp.  A source
is then taken ``floor(target / size)`` whole times plus a seeded sample of
the remainder.

The sample is exact, not a coin flip per document: documents are ordered by
a seeded hash of their id and taken while the running size stays within the
remainder (to the nearest document).  The running size is found without
sorting a source: sizes are summed per hash prefix (map-side combined), and
only the one prefix where the remainder ends is ordered.  The prefix length
grows with the source, so that slice stays at a few thousand documents
whatever the source's size.  The result per source is a cut-off key, so
texts are never shuffled to be sampled.

Edge cases: a null source is a source (ordered last); a null or empty text
has size 0 and takes 0 words; rows that repeat a doc_id are taken or left
together; texts of any length are counted whole; rows are carried in a
struct, so other columns may have any name; an empty table gives an empty result; a source of size 0 has
target 0; if even all clamps together fall short of the budget, every
source gets its clamp.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import stage_table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17
# Documents that share a hash prefix where a source's sample ends.
SLICE = 4096
# The plan (a row per source) is broadcast up to this many sources.
BROADCAST_SOURCES = 100_000


def sample_key(doc_id: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def rank_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Weights repeating over the sources in code-point order, null last.
    One row per source, so the ordering is over the (small) source table."""
    k = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (k % len(weights)) + 1))


def water_level(sources: DataFrame, budget: float) -> float:
    """The level at which ``sum(least(cap, level * weight)) = budget``;
    infinite if all caps together are not enough.

    The set of clamped sources is a function of the level and only grows,
    so each round is one aggregate over the source table and the state is a
    single number."""
    level = budget / w if (w := sources.agg(F.sum("weight")).first()[0]) else math.inf
    while math.isfinite(level):
        over = F.col("cap") < F.lit(level) * F.col("weight")
        capped, free = sources.agg(
            F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        new = (budget - capped) / free if free else math.inf
        if new <= level:
            break
        level = new
    return level


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per source: ``source, source_size, target, whole, cutoff``.
    ``sized`` has ``source, size, key``; a document is taken ``whole`` times
    and once more if its key is at most ``cutoff``."""
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    stats = rank_weights(stats, weights).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    stats = stage_table(stats, "mix-sources")
    total = stats.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = water_level(stats, share * float(total))
    target = F.col("cap") if math.isinf(level) else F.least("cap", F.lit(level) * F.col("weight"))
    plan = stats.withColumn("target", target)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / SLICE) / math.log(16))).cast("int")
    plan = stage_table(plan.withColumn("digits", F.least(digits, F.lit(8))), "mix-plan")

    open_ = plan.where("rest > 0").select(F.col("source").alias("s"), "rest", "digits")
    rows = (sized.join(_small(open_, plan), F.col("source").eqNullSafe(F.col("s")))
            .select("s", "rest", "size", "key", F.expr("substring(key, 1, digits)").alias("prefix")))
    by_prefix = W.partitionBy("s").orderBy("prefix").rowsBetween(W.unboundedPreceding, 0)
    ends = (rows.groupBy("s", "prefix").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
            .withColumn("upto", F.sum("size").over(by_prefix))
            .where(F.col("upto") > F.col("rest"))
            .groupBy("s").agg(F.min_by(F.struct("prefix", (F.col("upto") - F.col("size")).alias("before")), "prefix").alias("e"))
            .select(F.col("s").alias("es"), "e.prefix", "e.before"))
    ends = stage_table(ends, "mix-ends")
    end = _small(ends, ends)
    slice_ = rows.join(end, F.col("s").eqNullSafe(F.col("es")) & (rows["prefix"] == end["prefix"])).select(
        "s", "rest", "before", "key", "size", end["prefix"].alias("prefix"))
    groups = slice_.groupBy("s", "key").agg(F.sum("size").alias("g"), F.first("rest").alias("rest"),
                                            F.first("before").alias("before"), F.first("prefix").alias("prefix"))
    by_key = W.partitionBy("s").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    mid = F.col("before") + F.sum("g").over(by_key) - F.col("g") / 2
    # Keys of earlier prefixes sort before the bare prefix, keys of this one after it.
    cut = (groups.withColumn("mid", mid).groupBy("s")
           .agg(F.coalesce(F.max(F.when(F.col("mid") <= F.col("rest"), F.col("key"))), F.max("prefix")).alias("cutoff")))
    return stage_table(
        plan.join(cut, plan["source"].eqNullSafe(cut["s"]), "left")
        .select("source", "source_size", "target", "whole", F.coalesce("cutoff", F.lit("")).alias("cutoff")), "mix")


def _small(df: DataFrame, counted: DataFrame) -> DataFrame:
    """Broadcast hint for a per-source table whose row count (measured on
    ``counted``, already written) is within the bound."""
    return F.broadcast(df) if counted.count() <= BROADCAST_SOURCES else df


def repetitions(docs: DataFrame, plan: DataFrame, key: Column, source: str = "source") -> DataFrame:
    """``docs`` joined with its source's plan, and ``reps``: how often the
    mix takes the document."""
    p = _small(plan.select(F.col("source").alias("__s"), "source_size", "target", "whole", "cutoff"), plan)
    return (docs.join(p, docs[source].eqNullSafe(F.col("__s")), "left")
            .withColumn("reps", F.col("whole") + F.when(key <= F.col("cutoff"), 1).otherwise(0)).drop("__s"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
        max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, reps``."""
    sized = stage_table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                    sample_key(F.col("doc_id"), seed).alias("key")), "mix-sizes")
    plan = mixing_plan(sized, weights, share, max_epochs)
    return repetitions(sized, plan, F.col("key")).select("doc_id", "source", "size", "source_size", "target", "reps")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                  max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it."""
    sized = stage_table(docs.select("source", word_count(F.col("text")).alias("size"),
                                    sample_key(F.col("doc_id"), seed).alias("key")), "mix-sizes")
    plan = mixing_plan(sized, weights, share, max_epochs)
    packed = docs.select(F.struct("*").alias("__doc"), F.col("source").alias("__source"), F.col("doc_id").alias("__id"))
    taken = repetitions(packed, plan, sample_key(F.col("__id"), seed), "__source").where("reps > 0")
    copies = taken.select("__doc", F.explode(F.sequence(F.lit(1), F.col("reps").cast("int"))))
    return copies.select("__doc.*")
