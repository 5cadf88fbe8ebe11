"""Quality classifier: held-out accuracy, shrinkage against a direct
computation, edge cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import quality
from quarry.sources.tables import load

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = load(spark, SF, "labels").where("quality is not null")
    docs = load(spark, SF, "documents")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    out = quality.classify(docs, labels.where(half)).join(labels.where(~half), "doc_id").select("kept", "quality").collect()
    right = sum(r["kept"] == bool(r["quality"]) for r in out) / len(out)
    good = [r["kept"] for r in out if r["quality"] == 1]
    assert len(out) > 100 and right > 0.97
    assert sum(good) / len(good) > 0.985                      # clean documents stay


def _scored(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, host string, path string, evidence double, p double")


def test_posterior_matches_direct_computation(spark):
    r = random.Random(1)
    rows = []
    for i in range(300):
        host = r.choice(["hot"] * 8 + ["a", "b", None])
        path = r.choice(["x", "y", None])
        e = r.gauss(2 if host != "b" else -2, 1)
        rows.append((i, host, path, e, 1 / (1 + math.exp(-e))))
    rows.append((300, "single", "x", 1.0, 0.7))
    got = {x["doc_id"]: x for x in quality.posteriors(_scored(spark, rows)).collect()}
    groups = {}
    for _, h, q, _, p in rows:
        groups.setdefault(h, {}).setdefault(q, []).append(p)
    ps = [p for *_, p in rows]
    total, rate = len(ps), float(np.mean(ps))
    cells = [np.array(v) for g in groups.values() for v in g.values()]
    within = sum(((c - c.mean()) ** 2).sum() for c in cells) / (total - len(cells))
    hosts = {h: np.array([p for v in g.values() for p in v]) for h, g in groups.items()}

    def strength(sites):
        between = sum(len(c) * (c.mean() - up) ** 2 for c, up in sites)
        spread = (between - (len(sites) - 1) * within) / (total - sum(len(c) ** 2 for c, _ in sites) / total)
        return min(quality.MAX_STRENGTH, within / spread) if spread > 0 else quality.MAX_STRENGTH

    k = strength([(c, rate) for c in hosts.values()])
    up = {h: (c.sum() + k * rate) / (len(c) + k) for h, c in hosts.items()}
    kp = strength([(np.array(v), up[h]) for h, g in groups.items() for v in g.values()])
    for i, h, q, e, p in rows:
        cell = groups[h][q]
        site = (sum(cell) - p + kp * up[h]) / (len(cell) - 1 + kp)
        assert abs(got[i]["site_rate"] - site) < 1e-9
        assert abs(got[i]["posterior"] - 1 / (1 + math.exp(-(e + math.log(site / (1 - site)))))) < 1e-9
    assert abs(got[300]["site_rate"] - up["single"]) < 1e-9     # a lone document gets its parent's rate


def test_edge_cases(spark, make_docs):
    rows = [(i, "good words in a row, as prose goes." * (i % 3 + 1) if i % 2 else "### %%% $$$ &&& *** " * 9, f"s{i % 3}") for i in range(60)]
    rows += [(100, None, None), (101, "", "s1"), (1, rows[1][1], rows[1][2]), (102, "prose " * 50000, "s1"), (None, "plain prose here.", "s1")]
    docs = make_docs(rows).withColumn("posterior", F.lit("clash")).withColumn("kept", F.lit(1)).withColumn("host", F.lit(2))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(5, 1, 0), (None, 0, 0), (999, 1, 0), (7, None, 0)],
                                   "doc_id bigint, quality int, toxic int")
    out = quality.keep_good(docs, labels)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert {i for i in ids if i is not None and i < 60} == set(range(1, 60, 2)) and ids.count(1) == 2
    assert quality.classify(docs, labels).count() == len(rows)
    assert quality.classify(docs, labels.limit(0)).where("kept").count() == len(rows)       # no labels: no evidence
    assert quality.classify(make_docs([]), labels).count() == 0
    assert quality.train(docs, labels, max_labelled=10) is not None


def test_sites_without_broadcast(spark, monkeypatch):
    rows = [(i, f"h{i % 4}", "p", 0.5, 0.6) for i in range(20)]
    want = sorted(r["posterior"] for r in quality.posteriors(_scored(spark, rows)).collect())
    monkeypatch.setattr(quality, "BROADCAST_SITES", -1)
    assert sorted(r["posterior"] for r in quality.posteriors(_scored(spark, rows)).collect()) == want
