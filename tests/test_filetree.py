import hashlib
import os

import pytest

from quarry.sources.filetree import list_files, roots_frame, scan_files, scan_rejects, validate_root

MIB = 1024 * 1024


def make_tree(root):
    files = {
        "main.py": b"print('hello world')",
        "README.md": b"# Test Repo",
        "src/utils.js": b"console.log('utils');",
        "node_modules/some_lib/ignored_file.js": b"ignored",
        "data.bin": b"\x01\x02\x03",
        "empty.py": b"",
        "large_file.txt": b"a" * (3 * MIB),
        "__init__.py": b"x = 1\r\ny = 2\r",
        "_priv.py": b"secret = 1",
        ".github/x.yml": b"on: push",
        "exact.txt": b"b" * (2 * MIB),
        "over.txt": b"c" * (2 * MIB + 1),
        "A.PY": b"upper",
        ".bashrc": b"alias",
        "latin.txt": "café".encode("latin-1"),
        "rebuild/keep.md": b"kept",
    }
    for rel, data in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(data)
    return files


def test_scan_mock_repo(spark, tmp_path):
    root = str(tmp_path / "repo")
    make_tree(root)
    rec = {r.path: r for r in scan_files(spark, root).collect()}
    assert set(rec) == {"main.py", "README.md", "src/utils.js", "__init__.py", "_priv.py", ".github/x.yml",
                        "exact.txt", "latin.txt", "rebuild/keep.md"}
    init = rec["__init__.py"]
    assert init.content == "x = 1\ny = 2\n"
    assert init.size == 13                                  # on-disk bytes, CRs included
    assert init.hash == hashlib.md5(b"x = 1\ny = 2\n").hexdigest()
    assert rec["latin.txt"].content == "café"
    assert rec["main.py"].repo_name == "repo" and rec["main.py"].extension == ".py"
    assert rec["main.py"].full_path == os.path.join(os.path.abspath(root), "main.py")


def test_root_below_ignored_dir_still_scans(spark, tmp_path):
    root = str(tmp_path / "build" / "proj")
    os.makedirs(root)
    with open(os.path.join(root, "a.py"), "w") as fh:
        fh.write("a")
    assert [r.path for r in scan_files(spark, root).collect()] == ["a.py"]


def test_multi_root_and_names(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for r in (a, b):
        os.makedirs(r)
        with open(os.path.join(r, "x.py"), "w") as fh:
            fh.write(r)
    got = sorted((r.repo_name, r.path) for r in scan_files(spark, [(a, "first"), (b, "")]).collect())
    assert got == [("b", "x.py"), ("first", "x.py")]


def test_deep_tree_is_split_into_rounds(spark, tmp_path):
    root = str(tmp_path / "deep")
    for i in range(5):
        for j in range(3):
            d = os.path.join(root, f"d{i}", f"e{j}", "f")
            os.makedirs(d)
            with open(os.path.join(d, "m.py"), "w") as fh:
                fh.write(f"{i}{j}")
    for budget in (1, 3, 2000):                            # directories a task lists before it hands back the rest
        lst = list_files(roots_frame(spark, [root]), budget=budget)
        paths = [r.path for r in lst.where("kind = 'f'").collect()]
        assert len(paths) == len(set(paths)) == 15
    assert scan_rejects(lst).count() == 0


def test_links_and_lost_files(spark, tmp_path):
    root = str(tmp_path / "links")
    os.makedirs(os.path.join(root, "a"))
    for name in ("x.py", "a/y.py", "a/gone.py"):
        with open(os.path.join(root, name), "w") as fh:
            fh.write(name)
    os.symlink("..", os.path.join(root, "a", "loop"))     # a cycle
    os.symlink("x.py", os.path.join(root, "z.py"))        # a link to a file is a file
    os.symlink("nowhere", os.path.join(root, "broken.py"))
    lst = list_files(roots_frame(spark, [root])).cache()
    assert sorted(r.path for r in lst.where("kind = 'f'").collect()) == ["a/gone.py", "a/y.py", "x.py", "z.py"]
    os.remove(os.path.join(root, "a", "gone.py"))
    assert [(r.path, r.reason) for r in scan_rejects(lst).collect()] == [("a/gone.py", "FileNotFoundError")]
    lst.unpersist()


def test_validate_root(tmp_path):
    with pytest.raises(ValueError):
        validate_root(str(tmp_path / "missing"))
    f = tmp_path / "file.txt"
    f.write_text("x")
    with pytest.raises(ValueError):
        validate_root(str(f))


def test_data_source_opens_only_what_a_query_wants(spark, tmp_path):
    from pyspark.sql import functions as F

    from quarry.sources.datasource import open_files, write_listing

    root = tmp_path / "tree"
    (root / "node_modules").mkdir(parents=True)
    for name, text in (("small.py", "x"), ("big.py", "y" * 5000), ("notes.bin", "z"), (".hidden.py", "h"), ("empty.py", ""), ("node_modules/skip.py", "s")):
        (root / name).write_text(text)
    listing = write_listing(spark, str(root), str(tmp_path / "listing"), parts=3)
    files = open_files(spark, listing)
    every = {r.path: (bytes(r.raw), r.size, r.extension) for r in files.collect()}
    assert set(every) == {"small.py", "big.py", "notes.bin", ".hidden.py", "empty.py"} and every["big.py"] == (b"y" * 5000, 5000, ".py")
    for gone in ("big.py", "notes.bin"):                     # to open one now would give a row with an error
        (root / gone).unlink()
    wanted = files.where(F.col("size") <= 1000).where(F.col("extension").isin(".py", ".md"))
    assert {(r.path, r.error) for r in wanted.collect()} == {("small.py", None), (".hidden.py", None), ("empty.py", None)}
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "<= 1000" not in plan and " IN " not in plan          # nothing is left to filter above the source
    assert {r.path for r in files.where(F.col("error").isNotNull()).collect()} == {"big.py", "notes.bin"}
    assert files.where(F.col("size") < 1).count() == 1


def test_data_source_refuses_a_listing_that_executors_cannot_open(spark):
    from quarry.sources.datasource import open_files

    with pytest.raises(Exception, match="executors see as files"):
        open_files(spark, "hdfs://store/listing").collect()
