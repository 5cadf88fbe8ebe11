"""Prefix trie against a brute-force trie: templates, copies, ties, nulls,
long conversations, pieces."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = [*turns.get(base, [])[:h], *mine[h:]]
    return out


def brute(rows):
    convs = brute_rebuilt(rows)
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[:len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(node)))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(conversations):
    nodes, ends = P.prefix_trie(P.rebuild(P.turns_in_order(conversations)))
    full = nodes.join(P.end_digests(ends), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in full.select(cols).collect()), key=repr)


def talk(c, *texts):
    return [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


ROWS = [
    *talk(0, "hello", "hi there", "how are you", "fine", "good", "bye"), *talk(1, "hello", "hi there", "how are you"),
    *[r for c in range(2, 30) for r in talk(c, "x", "y", "z", "w", "v", f"own {c % 3}", "same")],
    *[r for c in range(30, 36) for r in talk(c, "only")],
    *talk(205, "no template", "b", "c", "d", "e", "f", "g"), *talk(206, "short"), *talk(-7, "neg", "a", "b"), *talk(-100, "n0", "n1", "n2", "n3", "n4", "n5"), *talk(-107, "neg"),
    (40, None, "user", "null turn"), (40, 3, None, None), (40, 1, "user", "b"), (40, 1, "user", "a"), (40, 1, "assistant", "z"), (40, 1, "user", "a"), (40, 9, "user", "é" * 5000),
    (None, 0, "user", "no conversation"), (41, 0, "user", ""), (41, 1, "", "user"), (42, 0, "user:", ""), (42, 1, "user", ":"),
]


def test_trie_matches_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "seq", "pos", "length", "digest")})
    assert trie(df) == brute(ROWS)


def test_long_conversations_and_small_pieces(spark, monkeypatch):
    """A conversation with most rows, in chunks; copies of one conversation;
    a hot parent, a hot end list."""
    from quarry.llm import common

    monkeypatch.setattr(P, "CHUNK", 7)
    monkeypatch.setattr(P, "PIECE", 4)
    monkeypatch.setattr(common, "HOT_GROUPS", 5)
    rows = [(500, i, "user", f"t{i % 9}") for i in range(60)] + [r for c in range(600, 640) for r in talk(c, "a", "b")]
    rows += [r for c in range(700, 720) for r in talk(c, "a", "b", "c", "d", "e", "f", f"child {c}")]
    assert trie(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_no_conversation_gives_no_node(spark, rows):
    assert trie(spark.createDataFrame(rows, SCHEMA)) == []


def test_running_sums_of_a_key_over_many_tasks(spark):
    from quarry.llm.common import in_order, running

    rows = spark.range(1000).select(F.when(F.col("id") < 600, 7).otherwise(F.col("id") % 5).alias("k"), F.col("id").alias("x"), F.lit("row").alias("same"))
    dealt = in_order(rows, "k", [F.col("same")], ["x"], "test-order")              # ties everywhere
    got = running(dealt, "k", {"n": F.lit(1), "total": F.col("x")}).collect()
    assert dealt.select(F.shiftright("seq", 33)).where("k = 7").distinct().count() > 1
    for k in {r.k for r in got}:
        mine = sorted((r.n, r.x, r.total) for r in got if r.k == k)
        assert [n for n, _, _ in mine] == list(range(1, len(mine) + 1))
        total = 0
        for _, x, t in mine:
            total += x
            assert t == total
