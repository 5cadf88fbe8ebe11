"""Corpus pipeline: quality filter, line dedup, near-dedup, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of ``documents``.  ``run`` writes every stage's
result to the shared checkpoint folder and reads it back as the next one's
input, so a lost executor never reaches back past one stage.

Edge cases: an empty table passes all stages and gives no sequences; a null
text is an empty one (fingerprint 0, one end token) and a null source or lang
is a value of its own; rows that repeat a doc_id are separate documents until
near-dedup, which keeps the first written; texts of any length are read
whole; other columns are carried along by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import line_dedup, mixing, packing, quality, simhash
from quarry.llm.catalog import tokenizer_path
from quarry.llm.common import stage_table
from quarry.sources.tables import load


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines."""
    return line_dedup.dedup_lines(docs, host="source", text="text", length="n_chars")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), special=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

# The classifier, XXH64 fingerprints and tokenising are not SQL; the result
# is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i < len(STAGES) - 1:
            out = stage_table(out, "pipeline-" + name.replace(" ", "-"))
    return out
