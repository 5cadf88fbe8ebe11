"""Capped water-filling: plan, sample and copies."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.llm import mixing


def brute(rows, weights=mixing.WEIGHTS, share=mixing.SHARE, cap=mixing.MAX_EPOCHS):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = share * sum(size.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * size[s]}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        target |= {s: cap * size[s] for s in over}
        left -= sum(cap * size[s] for s in over)
        free -= over
    reps = {}
    for s in order:
        whole = int(target[s] // size[s]) if size[s] else 0
        rest = target[s] - whole * size[s]
        groups = defaultdict(int)
        for i, t, src in rows:
            if src == s:
                groups[hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()] += len((t or "").split())
        upto = 0
        for k in sorted(groups):
            reps[s, k] = whole + (rest > 0 and upto + groups[k] / 2 <= rest)
            upto += groups[k]
    out = []
    for i, t, s in rows:
        k = hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()
        out.append((i, len((t or "").split()), size[s], round(target[s], 6), len((t or "").split()) * reps[s, k]))
    return out


KEY = lambda x: tuple((v is None, v or 0) for v in x)


def mixed(docs):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["size"] * r["reps"]) for r in mixing.mix(docs).collect()), key=KEY)


def test_mix_matches_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 8)                  # several digits of prefix even on a small table
    r = random.Random(5)
    rows = [(i, "w " * r.randint(0, 30), r.choice(["hot"] * 6 + ["a", "b", "Z", "é", None])) for i in range(400)]
    rows += [(1000, None, "empty"), (1001, "", "empty"), (None, "x y", "a"), (None, "x y", "a"), (7, rows[7][1], rows[7][2]), (2000, "w " * 4000, "b")]
    docs = make_docs(rows).withColumn("size", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("reps", F.lit(2))
    got = mixed(docs)
    assert got == sorted(brute(rows), key=KEY)
    assert all(taken <= 2 * size for _, size, _, _, taken in got)


def test_taken_is_near_target_and_reruns_agree(make_docs):
    rows = [(i, "w " * (i % 17 + 1), f"s{i % 5}") for i in range(2000)]
    one, two = mixed(make_docs(rows)), mixed(make_docs(rows[::-1]).repartition(7))
    assert one == two
    source = {i: f"s{i % 5}" for i in range(2000)}
    total, target = defaultdict(int), {}
    for i, _, _, t, taken in one:
        total[source[i]] += taken
        target[source[i]] = t
    assert all(abs(total[s] - target[s]) <= 17 for s in target)


def test_copies_and_empty(make_docs):
    rows = [(i, "w " * (i % 5 + 1), "a" if i % 3 else "b") for i in range(60)]
    docs = make_docs(rows).withColumn("reps", F.lit(9)).withColumn("whole", F.lit("clash"))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += 1
    want = {i: round(taken / size) for i, size, _, _, taken in brute(rows) if taken}
    assert dict(got) == want
    assert mixing.mix(make_docs([])).count() == 0 and mixing.mix_documents(make_docs([])).count() == 0
