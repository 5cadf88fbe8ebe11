"""Exact dedup against brute force: ties, nulls, hot groups, full filters."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import exact_dedup as X


def bare(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[bare(t)].append((-len(t or ""), i is None, i or 0))
    out = []
    for k, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        for n, m in enumerate(sorted(members)):
            out.append((None if m[1] else m[2], keep, len(members), n == 0, hashlib.sha256(k.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(marked):
    return sorted(((r.row["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in marked.collect()), key=repr)


ROWS = [
    (1, "a b c"), (2, "abc"), (3, " a\tb\nc\x0b\x0c\r "), (4, "ab c"), (5, None), (6, ""), (7, " \n"), (None, "abc        "), (8, "Abc"),
    (9, "n b"), (10, "nb"), (11, "x " * 30000), (12, "x" * 30000), (13, "dup"), (13, "dup"), (13, "dup"), (14, "dup"), (None, "solo"), (15, "é ü"), (16, "éü"),
    (-3, "neg"), (-4, "neg"), (17, "ab"), (18, "c"),
]


@pytest.mark.parametrize("columns", [None, ["doc_id"]])
def test_marks_match_brute_force(make_docs, columns):
    docs = make_docs(ROWS + [(100 + i, "hot  copy" if i % 3 else f"own {i}") for i in range(300)])
    docs = docs.withColumns({c: F.lit("clash") for c in ("key", "size", "kept", "bucket", "at", "hit")})
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(X.mark_copies(docs, columns=columns)) == brute(rows)


def test_a_full_filter_changes_no_result(make_docs, monkeypatch):
    monkeypatch.setattr(X, "_cell", lambda seed, cells: F.lit(0).cast("bigint"))           # every document shares one cell
    assert got(X.mark_copies(make_docs(ROWS))) == brute(ROWS)


def test_hot_groups_are_split(make_docs, monkeypatch):
    from quarry.llm import common

    monkeypatch.setattr(common, "HOT_GROUPS", 3)                                          # groups above max(3, n // 3) are broadcast
    rows = [(i, "same") for i in range(40)] + [(50 + i, f"pair {i // 2}") for i in range(10)]
    assert got(X.mark_copies(make_docs(rows))) == brute(rows)


def test_documents_without_an_equal_are_not_shuffled(spark, make_docs):
    marked = X.mark_copies(make_docs([(i, f"text {i}") for i in range(200)]), columns=["doc_id"])
    through = marked.where("group_size = 1")._jdf.queryExecution().executedPlan().toString()
    own = through.split("Union")[1].split("maybe-copies")[0]
    assert "Exchange hashpartitioning" not in own and "ArrowEval" not in through and "MapInArrow" not in through
    assert marked.count() == 200


def test_drop_copies_keeps_whole_rows_and_empty_tables(make_docs):
    docs = make_docs(ROWS)
    kept = X.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({bare(t) for _, t in ROWS})
    assert [r["text"] for r in kept.where("doc_id in (15, 16)").collect()] == ["é ü"]
    assert X.mark_copies(make_docs([])).count() == 0
