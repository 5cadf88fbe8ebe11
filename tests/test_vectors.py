import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import knn as K


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, "a", [1.0, 0.0, 0.0]), (2, "a", [2.0, 0.0, 0.0]), (3, "b", [0.0, 1.0, 0.0]),
            (4, "b", [0.0, 0.0, 0.0]), (5, "c", [0.6, 0.8, 0.0]), (6, "c", [0.6, 0.8, 0.0])]
    return spark.createDataFrame(rows, "doc_id long, repo_name string, embedding array<double>")


def test_cosine_handles_non_unit_and_zero(small):
    hits = K.knn(small, [1.0, 0.0, 0.0], k=6).collect()
    assert [h.doc_id for h in hits] == [1, 2, 5, 6, 3, 4]       # ties by id, NULL last
    assert hits[0].score == pytest.approx(1.0) and hits[1].score == pytest.approx(1.0)
    assert hits[-1].score is None


def test_filters_pre_and_post(small):
    pre = K.knn(small, [0.6, 0.8, 0.0], k=2, repo="b").collect()
    assert [h.doc_id for h in pre] == [3, 4]
    post = K.knn(small, [0.6, 0.8, 0.0], k=2, repo="b", prefilter=False).collect()
    assert post == []
    assert [h.doc_id for h in K.knn(small, [0.6, 0.8, 0.0], k=2, repo="").collect()] == [5, 6]


def test_l2_and_dot(small):
    l2 = {r.doc_id: r.score for r in K.knn(small, [1.0, 0.0, 0.0], k=6, metric="l2").collect()}
    assert l2[1] == pytest.approx(1.0) and l2[2] == pytest.approx(0.5) and l2[4] == pytest.approx(0.5)
    l2s = {r.doc_id: r.score for r in K.knn(small, [1.0, 0.0, 0.0], k=6, metric="l2", squared=False).collect()}
    assert l2s[3] == pytest.approx(1 / (1 + np.sqrt(2)))
    dot = K.knn(small, [1.0, 0.0, 0.0], k=1, metric="dot").first()
    assert dot.doc_id == 2 and dot.score == pytest.approx(2.0)
    with pytest.raises(ValueError):
        K.knn(small, [1.0], metric="manhattan")


def test_width_check(small, spark):
    K.check_width(small, 3)
    bad = small.unionByName(spark.createDataFrame([(9, "z", [1.0])], small.schema))
    with pytest.raises(ValueError):
        K.check_width(bad, 3)


def _brute(q, c, k):
    qn = q / np.linalg.norm(q, axis=1)[:, None]
    cn = c / np.linalg.norm(c, axis=1)[:, None]
    s = np.round(qn @ cn.T, 6)
    out = set()
    for i in range(len(q)):
        order = sorted(range(len(c)), key=lambda j: (-s[i, j], j))[:k]
        out |= {(i, j, float(s[i, j])) for j in order}
    return out


@pytest.mark.parametrize("block_rows", [None, 17])
def test_knn_join_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    q = rng.normal(size=(37, 8))
    c = rng.normal(size=(211, 8))
    c[10] = c[11]                                   # tie
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, embedding array<double>")
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "doc_id long, embedding array<double>")
    got = K.knn_join(qdf, cdf, k=5, digits=6, block_rows=block_rows).collect()
    assert {(r.qid, r.doc_id, round(r.score, 6)) for r in got} == _brute(q, c, 5)
    assert sorted({r.rank for r in got}) == [1, 2, 3, 4, 5]


def test_knn_join_null_zero_and_wrong_widths(spark):
    q = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", None)], "qid string, embedding array<double>")
    c = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [2.0, 0.0]), ("c", None), ("d", [1.0, 1.0])], "doc_id string, embedding array<double>")
    got = {(r.qid, r["rank"]): (r.doc_id, r.score) for r in K.knn_join(q, c, 3, digits=6).collect()}
    assert got[("q1", 1)] == ("b", 1.0) and got[("q1", 2)] == ("d", 0.707107) and got[("q1", 3)] == ("a", None)
    assert [got[("q2", i)] for i in (1, 2, 3)] == [("a", None), ("b", None), ("c", None)]
    assert K.knn_join(q, c.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="vector width"):
        K.knn_join(q, spark.createDataFrame([("x", [1.0])], c.schema).union(c), 3).collect()


def test_knn_join_is_one_plan_without_the_driver(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>")
    plan = K.knn_join(q, q.withColumnRenamed("qid", "doc_id"), 1, block_rows=1)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_knn_per_group_has_partial_window_limit(small):
    df = K.knn_per_group(small, [1.0, 0.0, 0.0], 1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert {r.repo_name: r.doc_id for r in df.collect()} == {"a": 1, "b": 3, "c": 5}


def test_lsh_recall_and_zero_vectors(spark, tmp_path):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    odd = spark.createDataFrame([(-20, [0.0] * 64), (-40, None), (-60, [float("nan")] * 64), (-80, [float("inf")] * 64)],
                                "vec_id long, embedding array<float>")
    both = emb.select("vec_id", "embedding").union(odd)
    index = K.write_lsh(both, str(tmp_path / "lsh"), "vec_id")
    assert index.vectors.where("cid < 0").count() == 0 and K.LSH_OPEN < index.bits <= K.lsh_bits(emb.count())
    queries = both.where("vec_id % 20 = 0")
    approx = {(r.qid, r.doc_id) for r in K.knn_lsh(queries, index, 10, q_id="vec_id").collect()}
    exact = {(r.qid, r.doc_id) for r in K.knn_join(queries.where("vec_id >= 0"), emb, 10, q_id="vec_id", c_id="vec_id").collect()}
    assert len(approx & exact) / len(exact) >= 0.9
    assert {q for q, _ in approx} == {q for q, _ in exact}
    with pytest.raises(ValueError, match="keeps"):
        K.knn_lsh(queries, index, K.LSH_KEEP + 1, q_id="vec_id")


def test_lsh_copies_are_indexed_once_and_all_listed(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    rows = [(i, base[i].tolist()) for i in range(300)] + [(1000 + i, base[7].tolist()) for i in range(400)]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    index = K.write_lsh(corpus, str(tmp_path / "lsh"), keep=12)
    assert index.vectors.count() == 300 and index.buckets.count() == 300 * K.LSH_TABLES
    again = K.read_lsh(spark, str(tmp_path / "lsh"))
    hits = K.knn_lsh(spark.createDataFrame([(1, base[7].tolist())], "qid long, embedding array<double>"), again, 12, digits=6)
    got = [(r.doc_id, r.score, r["rank"]) for r in hits.orderBy("rank").collect()]
    assert got == [(d, 1.0, i + 1) for i, d in enumerate([7, *range(1000, 1011)])]


def test_lsh_probes_the_least_certain_bits_and_buckets_shrink(spark, tmp_path):
    one = spark.createDataFrame([(1, [3.0, -1.0, 0.5, 2.0])], "id long, v array<double>")
    p = K.planes(4, tables=2)[:, :5]
    want = set()
    for t in range(2):
        x = p[t] @ np.array([3.0, -1.0, 0.5, 2.0])
        code = sum(1 << b for b in range(5) if x[b] >= 0)
        near = sorted(range(5), key=lambda b: (abs(x[b]), b))[:2]
        want |= {t << K.LSH_MOST_BITS | code ^ (i & 1) << near[0] ^ (i >> 1) << near[1] for i in range(4)}
    assert {r.bucket for r in K.lsh_buckets(one, "id", "v", 4, 5, 2, 2).collect()} == want
    assert [K.lsh_bits(n) for n in (0, 1, 16, 17, 1 << 20, 1 << 40)] == [4, 4, 4, 5, 20, K.LSH_MOST_BITS]
    empty = spark.createDataFrame([], "doc_id long, embedding array<double>")
    index = K.write_lsh(empty, str(tmp_path / "none"))
    assert K.knn_lsh(empty.withColumnRenamed("doc_id", "qid"), index, 5).count() == 0


def test_lsh_bits_follow_the_measured_recall(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(100, 64))
    met, recall, bits = {}, {}, {}
    for name, v in (("clustered", centres[np.arange(3000) % 100] + 0.3 * rng.normal(size=(3000, 64))), ("random", rng.normal(size=(3000, 64)))):
        corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, embedding array<double>")
        q = corpus.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "qid")
        index = K.write_lsh(corpus, str(tmp_path / name))
        met[name], bits[name] = K.lsh_candidates(q, index).count() / (60 * 3000), index.bits
        got = {(r.qid, r.doc_id) for r in K.knn_lsh(q, index, 10).collect()}
        exact = {(r.qid, r.doc_id) for r in K.knn_join(q, corpus, 10).collect()}
        recall[name] = len(got & exact) / len(exact)
    assert min(recall.values()) >= 0.9
    assert bits["clustered"] == K.lsh_bits(3000) > bits["random"], (bits, met)
    assert 2 * met["clustered"] < met["random"] < 0.6, (bits, met)


def test_fit_bits_against_buckets_met(spark):
    rng = np.random.default_rng(2)
    q, near = rng.normal(size=(20, 8)), rng.normal(size=(20, 8)) * 0.6
    near += q
    frames = [spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>") for v in (q, near)]

    def share(bits):
        probes, own = (K.lsh_buckets(f, "id", "v", 8, bits, 4, o) for f, o in zip(frames, (K.LSH_OPEN, 0), strict=True))
        return probes.join(own, ["id", "bucket"]).select("id").distinct().count() / 20

    shares = {bits: share(bits) for bits in range(K.LSH_OPEN + 1, 13)}
    for recall in (0.5, 0.9):
        good = [b for b, s in shares.items() if s >= recall]
        assert K.fit_bits(q, near, 12, 4, 7, recall) == max([K.LSH_OPEN + 1, *good])


def test_udf_embedder_width_checked(spark):
    from quarry.operators.embed import udf_embedder

    def toy(texts):
        return [[float(len(t)), float(t.count("a")), 1.0] for t in texts]

    docs = spark.createDataFrame([(1, "banana"), (2, "apple"), (3, "kiwi")], "doc_id long, text string")
    emb = docs.withColumn("embedding", udf_embedder(lambda: toy, width=3)("text"))
    hits = K.knn(emb, [6.0, 3.0, 1.0], k=1).collect()
    assert hits[0].doc_id == 1 and hits[0].score == pytest.approx(1.0)
    bad = docs.withColumn("embedding", udf_embedder(lambda: toy, width=4)("text"))
    with pytest.raises(Exception):
        bad.collect()


def test_query_of_another_width_fails(spark, small):
    with pytest.raises(Exception, match="vector width"):
        K.knn(small, [1.0, 0.0], k=1).collect()


def test_grid_parts_follow_cores_not_shuffle_partitions(spark):
    """Every part gets all queries, so more parts than needed multiply the shuffle."""
    from quarry.operators.grid import block_grid

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        rows = spark.range(20)
        assert block_grid(rows, rows, lambda table: lambda batch: [], "id bigint").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_lsh_shuffles_no_candidate_pairs(spark, tmp_path):
    """The hits are the best of the candidates, and no join makes a row per candidate."""
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(5).normal(size=(600, 16)))]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    index = K.write_lsh(corpus, str(tmp_path / "lsh"))
    q = corpus.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid")
    hits = K.knn_lsh(q, index, 4, digits=6)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    met = {}
    for r in K.lsh_candidates(q, index).collect():
        met.setdefault(r.qid, []).append((-round(float(x[r.qid] @ x[r.cid]), 6), r.cid))
    assert {(r.qid, r["rank"], r.doc_id) for r in hits.collect()} == {(a, n + 1, d) for a, m in met.items() for n, (_, d) in enumerate(sorted(m)[:4])}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "(bucket#" not in plan.replace("collect_list(bucket#", "")       # no join on the bucket
