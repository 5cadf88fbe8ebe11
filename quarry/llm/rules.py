"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document.  The ledger keeps the raw
measurements and one bit per failed rule; a *policy version* is just a
mask over those bits, so a new policy, a comparison of versions, or an
ablation ("how many documents would come back without rule r?") reads the
ledger and never the texts again.

Edge cases: a null or empty text has no words and all measurements 0 (it
fails ``few_words``); a text of any length is measured whole; an empty table
gives an empty ledger; a null key stays null and repeated rows are measured
row by row; nothing is ordered between rows, so there are no ties; only the
``keys`` columns are carried along, so other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE_PATTERN, WORD_PATTERN, stage_table

SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurement columns; the bit is the
    rule's position in the list, so rules are only ever appended."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeat_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 18 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("dup_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),      # a heading or two may repeat
    Rule("shouting", "100 * n_upper > 50 * n_letters"),
)

# Policy versions: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeat_words"),
    "v1": ("few_words", "repeat_words", "symbols", "dup_lines"),
    "v2": tuple(r.name for r in RULES),
}
PRODUCTION = "v2"


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[n] for n in names)


def measure(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keys`` columns and the measurements.  Each step is its own projection and
    refers to the previous one's arrays several times, so that the optimiser
    computes an array once per row and never inside a lambda."""
    kept = list(keys)
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(*kept, t.alias("__t")).select(
        *kept, "__t",
        F.regexp_extract_all("__t", F.lit(WORD_PATTERN), F.lit(0)).alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: F.regexp_like(x, F.lit(WORD_PATTERN))).alias("__l"),
    )
    step = step.select(
        *kept,
        F.size("__w").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("__t", SPACE_PATTERN, "")).cast("bigint").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        F.size("__l").cast("bigint").alias("n_lines"),
        F.length(F.regexp_replace("__t", r"[^\p{L}]+", "")).cast("bigint").alias("n_letters"),
        F.length(F.regexp_replace("__t", r"[^\p{Lu}]+", "")).cast("bigint").alias("n_upper"),
        # (hash, position) of every 3-word window, sorted: equal windows are neighbours.
        F.expr("""case when size(__w) >= 3 then
            sort_array(transform(sequence(0, size(__w) - 3),
                i -> struct(xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2)) as h, i as p)))
            end""").alias("__tri"),
    )
    measured = [m for m in MEASURES if m != "n_repeat_words"]
    step = step.select(*kept, *measured, F.expr("""sort_array(transform(
        filter(__tri, (x, k) -> x.h = get(__tri, k - 1).h or x.h = get(__tri, k + 1).h), x -> x.p))""").alias("__pos"))
    # A repeated window at p covers p, p+1, p+2; count the union.
    covered = F.expr("""coalesce(aggregate(
        transform(__pos, (p, k) -> cast(least(3, coalesce(get(__pos, k + 1) - p, 3)) as bigint)),
        0L, (a, x) -> a + x), 0L)""")
    return step.select(*kept, *[covered.alias(m) if m == "n_repeat_words" else F.col(m) for m in MEASURES])


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = F.lit(0).cast("bigint")
    for i, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES,
           keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and ``fail_bits`` of every document."""
    return measure(docs, text, keys).withColumn("fail_bits", failure_bits(rules))


def passes(policy: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """Verdict of a policy version over ``fail_bits``."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy], rules))) == 0


def mask_counts(book: DataFrame) -> DataFrame:
    """(fail_bits, n): the ledger reduced to one count per distinct bitmask
    (at most 2^rules rows, combined map-side)."""
    return book.groupBy("fail_bits").agg(F.count("*").alias("n"))


def ablations(book: DataFrame, policy: str = PRODUCTION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, and documents that
    only it rejects (they come back when the rule is dropped), read off the
    ledger's bitmask counts with bit arithmetic."""
    return mask_ablations(mask_counts(book), policy, rules)


def mask_ablations(masks: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    mask = mask_of(POLICIES[policy], rules)
    names = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit"))
        for i, r in enumerate(rules) if r.name in POLICIES[policy]
    ])
    hit = F.col("fail_bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("fail_bits").bitwiseAND(F.lit(mask)) == F.col("r.bit")
    return (masks.select("fail_bits", "n", F.explode(names).alias("r"))
            .groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only_this"),
                 F.sum("n").alias("n_docs"),
                 F.bit_or("fail_bits").alias("bits_seen")))


def all_ablations(book: DataFrame) -> DataFrame:
    """:func:`ablations` of every policy version, with ``policy``, over one
    pass of the ledger (its bitmask counts are written once)."""
    masks = stage_table(mask_counts(book), "rule-masks")
    out = None
    for name in POLICIES:
        one = mask_ablations(masks, name).select(F.lit(name).alias("policy"), "*")
        out = one if out is None else out.unionByName(one)
    return out
