"""The pipeline's rows against a brute-force run, and its registration."""

from collections import Counter

import __spark_entry__ as E
import corpus_pipeline
from pyspark.sql import functions as F
from test_mixing import brute as brute_mix
from test_native import brute_lines
from test_simhash import brute_groups, brute_print
from test_tokens import check_packing

from quarry.llm import line_dedup
from quarry.sources.tables import load

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = load(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    out = stages[names[0]](spark, docs, SF)
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"], r["source"]) for r in out.collect()]
    quality = {r["doc_id"]: r["quality"] for r in load(spark, SF, "labels").collect()}
    assert all(quality.get(i, 1) == 1 for i, *_ in kept)                        # every labelled bad document is gone
    assert {i for i, q in quality.items() if q == 1} <= {i for i, *_ in kept}    # every labelled good one stays
    lines = brute_lines(kept, line_dedup.MAX_RATIO)
    source = {i: s for i, _, s in kept}
    got = stages[names[1]](spark, out, SF)
    assert got.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted(lines)
    root = brute_groups({i: brute_print(t) for i, t in sorted(lines)})
    single = [(i, t) for i, t in lines if root[i] == i]
    got = stages[names[2]](spark, got, SF)
    assert got.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted(single)
    plan = {i: (size, taken) for i, size, _, _, taken in brute_mix([(i, t, source[i]) for i, t in single])}
    got = stages[names[3]](spark, got, SF)
    copies = Counter(r["doc_id"] for r in got.collect())
    assert got.columns == docs.columns and all(copies[i] * size == taken for i, (size, taken) in plan.items())
    mixed = [(r["doc_id"], r["text"]) for r in got.collect()]
    placed = E.queries()["pipeline"](spark, SF).collect()
    n, tokens = check_packing(mixed, placed)
    assert n <= -(-tokens // 1024) + 3


def test_stages_on_empty_and_odd_rows(spark, make_docs):
    odd = [(1, None, None), (2, "", "s"), (3, "plain words and more of them here", "s"), (3, "plain words and more of them here", "s"), (None, "no id at all in this row", "t")]
    for docs in (make_docs([]), make_docs(odd).withColumn("size", F.lit("clash")).withColumn("fp", F.lit(0))):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.collect()
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == docs.columns


def test_registered_queries():
    names = set(E.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
