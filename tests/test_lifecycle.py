import json

import pytest

from pyspark.sql import functions as F

from quarry.operators import lifecycle as L
from quarry.operators.embed import embed_tf
from quarry.sources.snapshot import read_nested_snapshot, read_snapshot, write_snapshot
from quarry.sources.store import IndexStore


def files_df(spark, rows):
    return spark.createDataFrame(rows, "repo_name string, path string, content string") \
        .withColumn("hash", F.md5("content"))


def test_diff_snapshots(spark):
    old = files_df(spark, [("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")])
    new = files_df(spark, [("r", "b", "2"), ("r", "c", "33"), ("r", "d", "4")])
    got = {(r.path, r.change) for r in L.diff_snapshots(old, new).collect()}
    assert got == {("a", "removed"), ("b", "unchanged"), ("c", "changed"), ("d", "added")}


def test_incremental_upsert_equals_full_rebuild(spark):
    old = files_df(spark, [("r", "a", "one two"), ("r", "b", "two three"), ("s", "c", "x")])
    new = files_df(spark, [("r", "b", "two three"), ("r", "a", "one two two"), ("s", "d", "y z")])

    def embed(f):
        return embed_tf(f.withColumn("doc_id", L.doc_id()), "content", "doc_id", 64,
                        keep=("repo_name", "path", "hash"))

    def embed_delta(f):
        return embed_tf(f.withColumn("doc_id", L.doc_id()), "content", "doc_id", 64, keep=("repo_name", "path", "hash", "change"))

    inc = L.incremental_upsert(embed(old), new, embed_delta).drop("change")
    full = embed(new)
    norm = lambda df: sorted((r.path, r.hash, tuple(r.terms), tuple(round(w, 9) for w in r.weights))
                             for r in df.collect())
    assert norm(inc) == norm(full)


def test_null_hashes_and_names(spark):
    rows = [("r", "a", None), ("r", "b", "x")]
    old = spark.createDataFrame(rows, "repo_name string, path string, hash string")
    new = spark.createDataFrame([*rows, ("r", "c", None)], "repo_name string, path string, hash string")
    got = {(r.path, r.change) for r in L.diff_snapshots(old, new).collect()}
    assert got == {("a", "unchanged"), ("b", "unchanged"), ("c", "added")}
    index = spark.createDataFrame([(None, "n"), ("x", "p"), ("y", "q")], "repo_name string, path string")
    kept = L.update_repo(index, index.limit(0), "x").collect()
    assert sorted(r.path for r in kept) == ["n", "q"]


def test_upsert_moves_only_the_delta(spark):
    old = files_df(spark, [("r", "a", "1"), ("r", "gone", "2"), ("r", "b", "3")]).withColumn("v", F.lit(1))
    new = files_df(spark, [("r", "a", "1"), ("r", "b", "33"), ("r", "c", "4")])
    out = L.incremental_upsert(old, new, lambda f: f.withColumn("v", F.lit(2)))
    assert sorted((r.path, r.v, r.change) for r in out.collect()) == [("a", 1, "unchanged"), ("b", 2, "changed"), ("c", 2, "added")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "FullOuter" not in plan and "SortMergeJoin" not in plan


def repo(spark, name, paths, width=1):
    f = files_df(spark, [(name, p, f"{name}:{p}") for p in paths]).withColumn("doc_id", L.doc_id())
    vectors = f.select("doc_id", "repo_name", F.array(*[F.lit(1.0)] * width).alias("embedding"))
    return f, vectors, L.registry_from_files(f)


def held(store):
    docs, vectors = store.read("docs"), store.read("vectors")
    found = [] if docs is None else sorted((r.repo_name, r.path) for r in docs.collect())
    assert found == ([] if docs is None else sorted((r.repo_name, r.path) for r in docs.join(vectors.select("doc_id"), "doc_id").collect()))
    return found


def test_store_lifecycle_invariants(spark, scratch):
    store = IndexStore(spark, scratch + "/idx", num_parts=4)
    summary = lambda df: [tuple(r) for r in df.collect()]
    assert summary(store.add(*repo(spark, "r1", ["a", "b"]), vec_col="embedding")) == [("r1", 2, 2)]
    assert summary(store.add(*repo(spark, "2024", ["c"]), vec_col="embedding")) == [("2024", 1, 1)]
    assert summary(store.add(*repo(spark, "r1", ["a", "b"]))) == [("r1", 2, 2)]         # idempotent re-add
    assert summary(store.add(*[df.limit(0) for df in repo(spark, "r1", ["a"])])) == []         # nothing to add
    assert held(store) == [("2024", "c"), ("r1", "a"), ("r1", "b")]
    store.update("r1", *repo(spark, "r1", ["z"]))                                       # update = replace
    assert held(store) == [("2024", "c"), ("r1", "z")]
    one = store.read("docs", "2024")
    assert [r.path for r in one.collect()] == ["c"]
    assert all("repo_key=" in f and f.count("/gen=") == 1 for f in one.inputFiles()) and len(one.inputFiles()) == 1
    with pytest.raises(ValueError, match="no files"):
        store.add(*repo(spark, "r3", ["x"])[:2], repo(spark, "empty", ["y"])[2])
    with pytest.raises(ValueError, match="width"):
        store.add(*repo(spark, "r3", ["x"], width=2), vec_col="embedding")
    with pytest.raises(KeyError):
        store.update("unknown", *repo(spark, "unknown", ["x"]))
    assert held(store) == [("2024", "c"), ("r1", "z")] and not store.has("r3")
    assert store.remove(["r1", "unknown"]) == {"r1": True, "unknown": False}
    assert held(store) == [("2024", "c")]
    assert [r.name for r in store.repos().collect()] == ["2024"] and store.get("r1") is None
    store.remove(["2024"])
    assert held(store) == [] and store.repos().count() == 0
    store.add(*repo(spark, "r1", ["a"]))
    store.wipe()
    assert store.read("docs") is None and store.repos() is None


def test_update_by_an_empty_or_a_foreign_scan(spark, scratch):
    store = IndexStore(spark, scratch + "/idx", num_parts=4)
    both = [a.unionByName(b) for a, b in zip(repo(spark, "a", ["x", "y"]), repo(spark, "b", ["z"]), strict=True)]
    store.add(*both, vec_col="embedding")
    with pytest.raises(ValueError, match="other repositories"):
        store.update("a", *repo(spark, "b", ["new"]))
    with pytest.raises(ValueError, match="other repositories"):
        store.update("a", repo(spark, "a", ["new"])[0], repo(spark, "b", ["new"])[1])
    assert held(store) == [("a", "x"), ("a", "y"), ("b", "z")]
    gone = [df.limit(0) for df in repo(spark, "a", ["x"])]
    assert [tuple(r) for r in store.update("a", *gone).collect()] == [("a", 0, 0)]
    assert held(store) == [("b", "z")] and store.get("a")["files_processed"] == 0      # rows gone, registry row stays


@pytest.mark.parametrize("step", ["docs", "vectors", "registry", "commit", "clean"])
def test_a_failure_between_any_two_writes_leaves_a_whole_index(spark, scratch, monkeypatch, step):
    store = IndexStore(spark, scratch + "/idx", num_parts=4)
    store.add(*repo(spark, "r", ["old"]))
    store.add(*repo(spark, "other", ["o"]))

    def fail(name):
        if name == step:
            raise RuntimeError("executor lost")

    monkeypatch.setattr(store, "_step", fail)
    with pytest.raises(RuntimeError):
        store.update("r", *repo(spark, "r", ["new", "newer"]))
    after = [("other", "o"), ("r", "new"), ("r", "newer")] if step == "clean" else [("other", "o"), ("r", "old")]
    assert held(store) == after
    assert store.get("r")["files_processed"] == (2 if step == "clean" else 1)
    monkeypatch.undo()
    store.vacuum()
    assert held(store) == after
    assert len(store._entries()) == 1 and all(len(store._children(f"{store.path(t)}/{p}")) == 1 for t in ("docs", "vectors") for p in store._folders(["r", "other"]).values())


def test_a_damaged_registry_entry_is_set_aside(spark, scratch):
    store = IndexStore(spark, scratch + "/idx", num_parts=4)
    store.add(*repo(spark, "r", ["a"]))
    store.add(*repo(spark, "s", ["b"]))
    spark.range(1).selectExpr("'no parquet' AS value").write.text(store.path("registry") + "/entry=5")
    with pytest.warns(UserWarning, match="set aside"):
        assert [r.name for r in store.repos().collect()] == ["r", "s"]
    assert store.damaged == ["entry=5"] and held(store) == [("r", "a"), ("s", "b")]


def test_payload_defaults(spark):
    from quarry.operators.records import index_payload, with_repo_name

    docs = spark.createDataFrame([("a.py", "text", None, None)], "path string, content string, repo_name string, size long")
    row = index_payload(docs).first()
    assert (row.repo_name, row.extension, row.size, row.hash) == ("unknown", "", 0, "") and row.added_at is not None
    with pytest.raises(Exception, match="without content"):
        index_payload(spark.createDataFrame([("a.py", None)], "path string, content string")).collect()
    assert with_repo_name(docs, "", F.lit("derived")).first().repo_name == "derived"
    assert with_repo_name(docs, "given", F.lit("derived")).first().repo_name == "given"


def test_snapshot_roundtrip_and_nested(spark, scratch):
    f = files_df(spark, [("r", "a.py", "x"), ("q", "b.md", "y")]).withColumn("extension", F.lit(".py"))
    write_snapshot(f, scratch + "/snap")
    got = sorted((r.repo_name, r.path, r.hash) for r in read_snapshot(spark, scratch + "/snap").collect())
    assert got == sorted((r.repo_name, r.path, r.hash) for r in f.collect())
    doc = {"metadata": {"name": "demo", "path": "/x", "url": "local:/x", "last_updated": "t", "file_count": 2,
                        "languages": {".py": 2}, "size_mb": 0.0},
           "files": [{"path": "a.py", "full_path": "/x/a.py", "content": "1", "extension": ".py", "size": 1,
                      "modified": "2024-01-01T00:00:00", "hash": "h"},
                     {"path": "b.py", "full_path": "/x/b.py", "content": "2", "extension": ".py", "size": 1,
                      "modified": "2024-01-01T00:00:00", "hash": "g"}]}
    with open(scratch + "/demo.json", "w") as fh:
        json.dump(doc, fh, indent=2)
    rows = read_nested_snapshot(spark, scratch + "/demo.json").collect()
    assert sorted((r.repo_name, r.path) for r in rows) == [("demo", "a.py"), ("demo", "b.py")]


def test_snapshot_history(spark, scratch):
    import datetime as dt

    from quarry.sources.snapshot import diff_stored, snapshot_log

    path, day = scratch + "/history", lambda n: dt.datetime(2024, 1, n)
    one = files_df(spark, [("r", "a", "1"), ("r", "b", "2"), ("s/s", "c", "3")])
    write_snapshot(one, path, day(1))
    write_snapshot(files_df(spark, [("r", "b", "22"), ("r", "d", "4")]), path, day(5))
    write_snapshot(one.limit(0), path, day(9), repos=spark.createDataFrame([("s/s",)], "repo_name string"))      # now without a file
    at = lambda n: sorted((r.repo_name, r.path) for r in read_snapshot(spark, path, day(n)).collect())
    assert at(1) == at(4) == [("r", "a"), ("r", "b"), ("s/s", "c")]
    assert at(5) == [("r", "b"), ("r", "d"), ("s/s", "c")] and at(9) == [("r", "b"), ("r", "d")]
    changes = {(r.path, r.change) for r in diff_stored(spark, path, day(2)).collect()}
    assert changes == {("a", "removed"), ("b", "changed"), ("d", "added"), ("c", "removed")}
    assert {(r.repo_name, r.n_files) for r in snapshot_log(spark, path).collect()} == {("r", 2), ("s/s", 1), ("s/s", 0)}
    store = IndexStore(spark, scratch + "/idx", num_parts=4)                     # removal deletes the snapshots
    f, vectors, _ = repo(spark, "s/s", ["c"])
    store.add(f, vectors, L.registry_from_files(f, data_file=path))
    store.remove(["s/s"])
    assert {r.repo_name for r in read_snapshot(spark, path, day(4)).collect()} == {"r"}


def test_upsert_is_harmless_when_repeated(spark, scratch, monkeypatch):
    store = IndexStore(spark, scratch + "/idx", num_parts=4)
    embedded = []

    def embed(rows):
        embedded.append(rows.count())
        return embed_tf(rows, "content", "doc_id", 64, keep=("repo_name",))

    first = files_df(spark, [("r", "a", "one"), ("r", "b", "two"), ("s", "c", "three"), ("r", "a", "one")])
    assert L.upsert_files(store, first, embed) == 3
    assert L.upsert_files(store, first, embed) == 0                                   # the same batch again
    before = store.get("s")["gen"]
    second = files_df(spark, [("r", "b", "two changed"), ("r", "d", "four"), ("s", "c", "three")])
    assert L.upsert_files(store, second, embed) == 2
    assert embedded == [3, 2] and store.get("s")["gen"] == before                       # s was not touched
    got = {(r.repo_name, r.path, r.content) for r in store.read("docs").collect()}
    assert got == {("r", "a", "one"), ("r", "b", "two changed"), ("r", "d", "four"), ("s", "c", "three")}
    want = embed_tf(L.with_doc_id(files_df(spark, sorted(got))), "content", "doc_id", 64)
    tidy = lambda df: sorted((r.doc_id, tuple(r.terms)) for r in df.collect())
    assert tidy(store.read("vectors")) == tidy(want) and store.get("r")["files_processed"] == 3
    monkeypatch.setattr(store, "_step", lambda name: (_ for _ in ()).throw(RuntimeError("lost")) if name == "commit" else None)
    third = files_df(spark, [("r", "a", "uno"), ("t", "x", "new")])
    with pytest.raises(RuntimeError):
        L.upsert_files(store, third, embed)
    monkeypatch.undo()
    assert {(r.repo_name, r.path, r.content) for r in store.read("docs").collect()} == got
    assert L.upsert_files(store, third, embed) == 2                                   # and again, whole
    assert store.read("docs", "t").count() == 1


def test_maintained_frequencies_equal_a_rebuild(spark, scratch):
    from quarry.operators.embed import DocumentFrequencies, idf_table, idf_vector

    def vectors(*texts):
        return embed_tf(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), num_buckets=64)

    tidy = lambda df: sorted((r.bucket, r.df, round(r.idf, 9)) for r in df.collect())
    counts = DocumentFrequencies(spark, scratch + "/df", 64)
    counts.apply(1, vectors("a b c", "b c", "c", ""))
    assert tidy(counts.idf()) == tidy(idf_table(vectors("a b c", "b c", "c", "")))
    for _ in range(2):                                         # applied again under its id
        counts.apply(2, vectors("c d", "e"), vectors("a b c"))
    now = vectors("b c", "c", "", "c d", "e")
    assert tidy(counts.idf()) == tidy(idf_table(now))
    counts.compact(2)
    counts.apply(3, None, vectors("", "e"))
    now = vectors("b c", "c", "c d")
    assert tidy(counts.idf()) == tidy(idf_table(now))
    one = spark.range(1)
    assert [round(x, 9) for x in one.select(counts.vector().alias("v")).first().v] == [round(x, 9) for x in one.select(idf_vector(now, 64).alias("v")).first().v]


def test_upsert_writes_what_differs(spark, scratch, monkeypatch):
    """A change to a large repository is a layer on top, until the layers outgrow it."""
    store, written = IndexStore(spark, scratch + "/idx", num_parts=4), []
    write = store._write

    def counted(table, *args, **kw):
        out = write(table, *args, **kw)
        written.append((table, out[1]["n"]))
        return out

    monkeypatch.setattr(store, "_write", counted)
    files = {("r", f"f{i}"): "old" for i in range(12)} | {("s", "g"): "other"}

    def apply(some):
        files.update(some)
        written.clear()
        n = L.upsert_files(store, files_df(spark, [(*k, v) for k, v in some.items()]), lambda f: embed_tf(f, "content", "doc_id", 64, keep=("repo_name",)))
        for repo in (None, "r"):
            assert {(x.repo_name, x.path): x.content for x in store.read("docs", repo).collect()} == {k: v for k, v in files.items() if repo in (None, k[0])}
            assert store.read("vectors", repo).count() == sum(repo in (None, k[0]) for k in files)
        assert store.get("r")["files_processed"] == sum(k[0] == "r" for k in files)
        return n, dict(written)

    assert apply(dict(files)) == (13, {"docs": 13, "vectors": 13})
    one = {("r", "f0"): "new", ("r", "f12"): "added", ("s", "g"): "other"}
    assert apply(one) == (2, {"docs": 2, "vectors": 2, "replaced": 1})                  # was 13 of each
    assert apply(one) == (0, {})
    assert apply({("r", "f0"): "newer", ("r", "f12"): "changed"}) == (2, {"docs": 2, "vectors": 2, "replaced": 2})
    assert len(store.get("r")["layers"]) == 2
    monkeypatch.setattr(store, "_step", lambda name: (_ for _ in ()).throw(RuntimeError("lost")) if name == "commit" else None)
    with pytest.raises(RuntimeError):
        L.upsert_files(store, files_df(spark, [("r", "f1", "lost")]), lambda f: embed_tf(f, "content", "doc_id", 64, keep=("repo_name",)))
    monkeypatch.setattr(store, "_step", lambda name: None)
    store.vacuum()
    n, wrote = apply({("r", f"f{i}"): "anew" for i in range(10)})
    assert n == 10 and wrote["docs"] == 13 and not store.get("r")["layers"]              # 14 rows on top of 13 files: written as a whole
    store.remove(["r"])
    assert [x.path for x in store.read("docs").collect()] == ["g"]


def test_upsert_stream_has_few_batches(spark, scratch, monkeypatch):
    import __spark_entry__ as E
    from quarry.plans.catalog import UPSERT_BATCHES

    rows = [(i, f"word{i} more", "en", f"src{i % 2}", 10) for i in range(60)]
    for i in range(12):
        spark.createDataFrame(rows[5 * i:5 * i + 5], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("append").parquet(f"{scratch}/documents.parquet")
    calls, real = [], L.upsert_files
    monkeypatch.setattr(L, "upsert_files", lambda *a: calls.append(1) or real(*a))
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")                              # a task, and a file written, per file read
    try:
        assert E.queries()["stream_upsert"](spark, scratch).count() == 60
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert len(calls) <= 2 * UPSERT_BATCHES                                             # was one per file
