"""Hard negatives against brute force; intervals against exact scores."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every=10, n_pos=5, n_neg=5):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        best[i] = min(best.get(i, r), r)
    out = []
    for a in (i for i in best if i % every == 0):
        al, av = best[a]
        s = sorted(((-sum(x * y for x, y in zip(av, v, strict=True)), i, label) for i, (label, v) in best.items() if i != a and len(v) == len(av)))
        for ps, p, _ in [x for x in s if x[2] == al][:n_pos]:
            hits = [(ns, n) for ns, n, label in s if label != al and 80 * -ps <= 100 * -ns <= 100 * -ps][:n_neg]
            out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n) in enumerate(hits)]
    return sorted(out)


def mined(spark, rows, every=10, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("v", "code", "part", "side", "score")})
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % every == 0, **kw).collect())


def cloud(n, width, seed, labels=3, centers=4):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centers, width))
    return [(i, int(rng.integers(labels)), [float(x) for x in c[i % centers] + 0.4 * rng.normal(size=width)]) for i in range(n)]


@pytest.mark.parametrize("width", [3, 64, 100])
def test_matches_brute_force(spark, width):
    rows = cloud(150, width, width)
    assert mined(spark, rows, block_rows=40) == brute(rows)


def test_edge_cases(spark):
    rows = cloud(60, 5, 1)
    rows += [(100 + i, 7, [1.0, 1.0, 0.0, 0.0, 0.5]) for i in range(30)] + [(140 + i, 8, [1.0, 1.0, 0.0, 0.0, 0.5]) for i in range(30)]       # ties
    rows += [(0, rows[0][1], rows[0][2])] * 20 + [(10, 9, [0.0] * 5)]                                                                       # repeats
    rows += [(200, None, [1.0] * 5), (210, 1, None), (220, 1, [1.0, None, 0.0, 0.0, 0.0]), (230, 1, [math.nan] + [0.0] * 4),
             (240, 1, [math.inf] + [0.0] * 4), (None, 1, [1.0] * 5), (250, 1, [0.0] * 5), (260, 1, [1.0, 2.0]), (270, 2, [1.0, 2.0]), (280, 1, [3.0, 2.0]),
             (290, 1, []), (300, 5, [-1.0] * 5), (310, 5, [1.0] * 5), (320, 77, [1.0] * 5)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []                                                                              # no other label


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, 1, [1e30]), (1, 2, [1.0])])


def index_block(v, ids=None):
    v = np.floor(256 * np.asarray(v))
    code, align, span, rest = H.encode(v)
    return H.Block(pa.table({
        "vec_id": pa.array(np.arange(len(v)) if ids is None else ids), "label": pa.array(np.zeros(len(v), dtype=np.int64)),
        "v": pa.array(v.astype(np.int64).tolist()), "code": pa.array(code.view("<i8").tolist()), "align": pa.array(align), "span": pa.array(span), "rest": pa.array(rest)}),
        np.arange(len(v)), v.shape[1]), v


@pytest.mark.parametrize("width", [1, 7, 64, 130])
def test_intervals_hold_every_score(width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(300, width)) * rng.choice([0.01, 1.0, 30.0], size=(300, 1))
    x[5] = 0
    x[6] = 1
    b, v = index_block(x)
    lower, upper = b.intervals(v[:40])
    s = v[:40] @ v.T
    assert (lower <= s).all() and (s <= upper).all()


def test_alignment_is_the_inner_product_with_the_own_code():
    v = np.floor(256 * np.random.default_rng(0).normal(size=(20, 64)))
    code, align, span, rest = H.encode(v)
    u = H.rotated(v)
    assert u.shape == (20, 256) and np.allclose((u * u).sum(1), (v * v).sum(1))
    unit = (np.unpackbits(code.view(np.uint8), axis=1, bitorder="little") * 2.0 - 1) / 16
    assert np.allclose((u * unit).sum(1), align)
    shadow = np.stack([H.rotated(np.eye(64)) @ x for x in unit])
    assert np.allclose(np.linalg.norm(shadow, axis=1), span) and (span < 0.95).all()
    assert np.allclose(np.linalg.norm(v - shadow * (align / span ** 2)[:, None], axis=1), rest)


def test_codes_filter_pairs(spark):
    """What the codes spare: most pairs are never scored."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(10, 64))[rng.integers(10, size=2000)] + 0.3 * rng.normal(size=(2000, 64))
    b, v = index_block(x / np.linalg.norm(x, axis=1)[:, None])
    lower, upper = b.intervals(v[:50])
    cut = np.partition(lower, lower.shape[1] - 5, axis=1)[:, -5]
    assert (upper >= cut[:, None]).mean() < 0.3
