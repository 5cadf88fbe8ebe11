import hashlib
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from quarry.functions import text as T


def test_path_extension_matches_posix_suffix(spark):
    names = [".bashrc", "a.tar.gz", "foo.", "..py", "a.PY", "x", ".env", "a b.c",
             "src/.github/w.yml", "d.x/file", "dir/.hidden.md", "rebuild/f3.md"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = dict(df.select("p", T.path_extension("p").alias("e")).collect())
    for n in names:
        assert got[n] == PurePosixPath(n).suffix, n


def test_ignored_dirs_on_every_component(spark):
    rows = ["node_modules/x.js", "src/a.py", "docs/build/f.md", "rebuild/f.md", ".github/x.yml", "a/.git/b.py"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    got = dict(df.select("p", T.path_has_ignored_dir("p").alias("i")).collect())
    assert got == {"node_modules/x.js": True, "src/a.py": False, "docs/build/f.md": True,
                   "rebuild/f.md": False, ".github/x.yml": False, "a/.git/b.py": True}


def test_preview_matches_python(spark):
    texts = ["  hello\nworld  ", "\t　x\n" + "y" * 300, "", " \x0b a \x1c", "a\r\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.p for r in df.select(T.preview("t").alias("p")).collect()]
    want = [t.strip().replace("\n", " ")[:150] + "..." for t in texts]
    assert got == want


def test_newlines_and_hash_match_text_mode_read(spark, tmp_path):
    raw = b"a\r\nb\rc\n\xc3\xa9"
    f = tmp_path / "x.txt"
    f.write_bytes(raw)
    with open(f, encoding="utf-8") as fh:
        py_text = fh.read()
    df = spark.createDataFrame([(bytearray(raw),)], "b binary")
    row = df.select(T.normalize_newlines(T.decode_text("b")).alias("t")).first()
    assert row.t == py_text
    h = df.select(T.content_hash(T.normalize_newlines(T.decode_text("b"))).alias("h")).first().h
    assert h == hashlib.md5(py_text.encode()).hexdigest()


def test_decode_latin1_fallback(spark):
    raw = "café".encode("latin-1")
    df = spark.createDataFrame([(bytearray(raw),), (bytearray("﻿ok".encode()),)], "b binary")
    got = [r.t for r in df.select(T.decode_text("b").alias("t")).collect()]
    assert got == ["café", "﻿ok"]


def test_repo_name_from_url(spark):
    urls = ["https://github.com/a/b.git", "https://github.com/a/b/", "https://github.com/a/my.github.io", "/x/y"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    strict = [r.n for r in df.select(T.repo_name_from_url("u", strict_compat=True).alias("n")).collect()]
    clean = [r.n for r in df.select(T.repo_name_from_url("u").alias("n")).collect()]
    assert strict == [u.split("/")[-1].replace(".git", "") for u in urls]
    assert clean == ["b", "b", "my.github.io", "y"]


def test_term_bucket_is_md5_prefix(spark):
    df = spark.createDataFrame([("hello",), ("wörld",)], "t string")
    got = [r.b for r in df.select(T.term_bucket("t", 1000).alias("b")).collect()]
    assert got == [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 1000 for w in ("hello", "wörld")]
