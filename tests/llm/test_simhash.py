"""SimHash near-duplicates against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import simhash


def brute_print(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(prints, d=3):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= d:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "one", "Two words", "a B c", "ÀÉ à é x y", "w " * 70000 + "end", "a\x85b c d\ne f"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_print(text)


def _frame(spark, prints):
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    return spark.createDataFrame(rows, "doc_id bigint, fp bigint")


def _ids(spark, prints, crowd, d=3):
    ids = simhash.component_ids(_frame(spark, prints), d, crowd)
    of = {r["fp"] & (1 << 64) - 1: r["component_id"] for r in ids.collect()}
    return {i: of[p] for i, p in prints.items()}


@pytest.mark.parametrize("crowd", [256, 3])
def test_groups_match_brute_force(spark, crowd):
    """Clusters with flips on any bits, exact copies, chains, and (with a
    low limit) crowded variants on all three levels."""
    r = random.Random(crowd)
    prints, i = {}, 0
    for _ in range(12):
        base = r.getrandbits(64)
        spots = r.sample(range(64), 12)
        for _ in range(r.randint(1, 25)):
            p = base
            for b in r.sample(spots, r.randint(0, 4)):
                p ^= 1 << b
            prints[i] = p
            i += 1
    chain = r.getrandbits(64)
    for step in range(20):                                     # neighbours link, the ends are far apart
        for b in r.sample(range(3 * step, 3 * step + 3), 3):
            chain ^= 1 << b
        prints[i] = chain
        i += 1
    for _ in range(60):
        prints[i] = r.getrandbits(64)
        i += 1
    prints |= {i: 0, i + 1: 7, i + 2: 0, i + 3: (1 << 64) - 1, i + 4: ((1 << 64) - 1) ^ (1 << 63)}
    assert _ids(spark, prints, crowd) == brute_groups(prints)


@pytest.mark.parametrize("d", [0, 1, 2, 4, 5])
def test_other_distances(spark, d):
    r = random.Random(d)
    prints = {}
    for c in range(6):
        base = r.getrandbits(64)
        for k in range(8):
            prints[8 * c + k] = base
            for b in r.sample(range(64), r.randint(0, 3)):
                prints[8 * c + k] ^= 1 << b
    assert _ids(spark, prints, 2, d) == brute_groups(prints, d)


@pytest.mark.parametrize("bound", [2_000_000, -1])
def test_documents_end_to_end(spark, make_docs, monkeypatch, bound):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", bound)
    r = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    base = [[r.choice(words) for _ in range(200)] for _ in range(5)]
    rows = []
    for i in range(60):
        w = list(base[i % 5])
        for _ in range(r.randint(0, 2)):
            w[r.randrange(200)] = r.choice(words)
        rows.append((500 - i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (500, rows[0][1]), (None, rows[1][1]), (None, "unlike anything else at all")]
    docs = make_docs(rows).withColumn("fp", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("component_id", F.lit(2))
    got = simhash.near_duplicates(docs).collect()
    prints = {k: brute_print(t) for k, (_, t) in enumerate(rows)}
    root = brute_groups(prints)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root[k]] = min(low.get(root[k], i), i)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    want = sorted(((i, prints[k], low.get(root[k])) for k, (i, _) in enumerate(rows)), key=key)
    assert sorted(((x["doc_id"], x["fp"] & (1 << 64) - 1, x["component_id"]) for x in got), key=key) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(key((x["doc_id"],)) for x in kept.collect()) == sorted(key((low.get(r_),)) for r_ in set(root.values()))


def test_empty(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert simhash.keep_one(make_docs([])).count() == 0
