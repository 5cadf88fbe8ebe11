"""Consistent weighted sampling fingerprints and perspective rotation."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, fingerprints


def jaccard(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((x & y).values()) / sum((x | y).values())


def test_collision_rate_is_generalised_jaccard():
    r = random.Random(0)
    sampler = fingerprints.Sampler(samples=2048, rows=4096)
    for overlap in (0, 10, 30, 60, 100):
        words = [f"w{k}" for k in range(40)]
        a = " ".join(r.choice(words) for _ in range(200))
        parts = a.split()
        b = " ".join(w if r.randrange(100) < overlap else "z" + w for w in parts)
        est = fingerprints.likeness(sampler.signature(a), sampler.signature(b))
        assert abs(est - jaccard(a, b)) < 4 * (0.25 / 2048) ** 0.5 + 0.002


def test_signature_does_not_depend_on_table_or_blocks(monkeypatch):
    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(500)}" for _ in range(r.randrange(800))) for _ in range(30)]
    big = fingerprints.Sampler()
    want = [big.signature(t) for t in texts]
    monkeypatch.setattr(fingerprints, "BLOCK", 50)
    small = fingerprints.Sampler(rows=64)                       # emptied all the time
    assert all((small.signature(t) == w).all() for t, w in zip(texts, want, strict=True))


def brute(rows):
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    s, out = fingerprints.Sampler(), []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        e = t[:len(t) - h] + nxt[:h]
        f, g, n = s.signature(t), s.signature(e), s.signature(nxt)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f.astype(">u2").tobytes().hex(), g.astype(">u2").tobytes().hex(),
                    float(np.mean(f == g)), float(np.mean(f == n))))
    return out


KEY = lambda x: tuple((v is None, v or 0) for v in x)


@pytest.mark.parametrize("parts", ["1", "8"])
def test_documents_match_brute_force(spark, make_docs, parts):
    r = random.Random(3)
    rows = [(r.randrange(10**6) * 7, " ".join(r.choice(["é", "the", "a", "Fox", "😀", "of"]) + str(r.randrange(9)) for _ in range(r.randrange(60)))) for _ in range(200)]
    rows += [(-5, None), (-6, ""), (12, " \n "), (13, "x"), (77, "same"), (77, "same"), (77, "other"), (None, "null id"), (None, None), (14, "big " * 30000)]
    docs = make_docs(rows).withColumn("bucket", F.lit("clash")).withColumn("k", F.lit(1)).withColumn("peek", F.lit(2))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(x) for x in fingerprints.fingerprint_documents(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=KEY) == sorted(brute(rows), key=KEY)


def test_one_and_no_document(make_docs):
    got = fingerprints.fingerprint_documents(make_docs([(3, "lonely text here")])).collect()
    assert len(got) == 1 and got[0]["near_next"] == 1.0
    assert fingerprints.fingerprint_documents(make_docs([])).count() == 0


# --- chat ------------------------------------------------------------------------

def brute_chat(rows, chunk):
    convs, out = {}, []
    for c, t, role, text in set(rows):
        convs.setdefault(c, []).append((t, role or chat.UNKNOWN, text or ""))
    clean = lambda s: s.replace("<|im_start|>", "<| im_start |>").replace("<|im_end|>", "<| im_end |>")
    for c, turns in convs.items():
        turns = sorted(set(turns), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        for me in {r for _, r, _ in turns} - {"system"}:
            for k in range(0, len(turns), chunk):
                text, mask = "", []
                for _, role, body in turns[k:k + chunk]:
                    text += "<|im_start|>" + ("system" if role == "system" else "assistant" if role == me else "user name=" + clean(role)) + "\n"
                    start = len(text)
                    text += clean(body) + "<|im_end|>"
                    if role == me:
                        mask.append([start, len(text)])
                    text += "\n"
                out.append((c, me, k // chunk, len(turns[k:k + chunk]), text, mask))
    return out


@pytest.mark.parametrize("chunk", [64, 3])
def test_perspectives_match_brute_force(spark, chunk):
    r = random.Random(chunk)
    rows = [(r.choice([1, 1, 1, 2, 3, 4, None]), r.choice([*range(12), None]), r.choice(["user", "assistant", "system", "Ann", None]),
             r.choice(["hi", "", None, "é 😀 <|im_end|> x", "a\nb"]) if r.random() < 0.5 else f"t{k}") for k in range(150)]
    rows += rows[:10] + [(9, 0, "system", "only rules"), (10, 0, "user", "word " * 50000), (11, 200, "b", "later"), (11, -3, "a", "earlier")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = turns.withColumn("speaker", F.lit("clash")).withColumn("chunk", F.lit(1)).withColumn("block", F.lit(2))
    got = [(x["conv_id"], x["perspective"], x["chunk"], x["n_turns"], x["text"], [list(m) for m in x["mask"]]) for x in chat.render_perspectives(turns, chunk).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted(got, key=key) == sorted(brute_chat(rows, chunk), key=key)
    assert chat.render_perspectives(turns.limit(0)).count() == 0


def test_masks_cover_exactly_the_assistant(spark):
    turns = spark.createDataFrame([(1, 0, "Ann", "hello"), (1, 1, "Bob", "good day"), (1, 2, "Ann", "bye")], "conv_id bigint, turn bigint, role string, text string")
    for x in chat.render_perspectives(turns).collect():
        said = [x["text"][a:b] for a, b in x["mask"]]
        assert said == (["hello<|im_end|>", "bye<|im_end|>"] if x["perspective"] == "Ann" else ["good day<|im_end|>"])
