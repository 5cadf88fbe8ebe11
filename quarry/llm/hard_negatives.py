"""Hard negatives by rotated one-bit codes with stored alignment.

Index.  Every vector becomes whole numbers (``floor(scale * x)``) and is
rotated, by random signs and a Hadamard matrix, into a space of ``WIDER``
times its width or more (a power of two, at least 64).  Its code is the signs
of the rotated components, one bit each.  Stored beside it are the alignment
(the vector's inner product with its own code, a unit vector), the length of
the code's shadow in the vectors' own space, and the length of what the code
does not explain.  In a wider space most of the code's error falls outside
the shadow, which is what makes the intervals narrow enough to filter.

Search.  An anchor is rotated the same way and its components quantised to
``PLANES`` bits, kept as bit planes, so the inner product of code and anchor
is a few popcounts.  With v = a x / |x|^2 + r (x the code's shadow, r
orthogonal to it), ``v.q = a (x.q) / |x|^2 + r.q`` and ``|r.q| <= |r|
sqrt(|q|^2 - (x.q)^2 / |x|^2)`` by Cauchy-Schwarz; the quantisation error of
x.q is bounded by its length.  This
gives every pair an interval that surely holds its score.  Only pairs whose
interval can matter are scored, in whole numbers: positives if it reaches the
fifth largest lower end of the anchor's label, negatives if it meets the
window of one of the anchor's positives.  So codes and rounding decide what
is scored, never what is found.

Anchors are a stated query set; they pass the corpus in blocks
(:func:`quarry.operators.grid.block_grid`): no pair is written, each task
returns the best few of its block, which are ranked per anchor (and positive)
behind a partial limit.

Edge cases: rows with a null id, label or vector, or a null or non-finite
component, take no part; rows that repeat an id count once (the smallest
label, then vector); only vectors of one width are compared; equal scores go
by the smaller id; an anchor with fewer positives or negatives returns what
there is; other columns do not matter; an empty table gives an empty result.
A component so large that a score may leave 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, stage_table
from quarry.operators.grid import best_k, block_grid
from quarry.operators.knn import rank_within

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100             # a negative's score in hundredths of the positive's
PLANES = 6
WIDER = 4
BLOCK_ROWS = 16384
CELLS = 1 << 20                 # pairs that a task looks at together
SEED = 12
EXACT = 1 << 53


# ------------------------------------------------------------------ codes

def _hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix of their width (a power of two)."""
    n, full = x.shape
    step = 1
    while step < full:
        x = x.reshape(n, -1, 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        step *= 2
    return x.reshape(n, full)


def _signs(width: int) -> np.ndarray:
    """Two rows of random signs, as long as the wider space."""
    full = 64
    while full < WIDER * width:
        full *= 2
    return np.random.default_rng(SEED).choice([-1.0, 1.0], size=(2, full))


def rotated(v: np.ndarray) -> np.ndarray:
    """Rows in the wider space: a rotation (two rounds, as one alone would
    only repeat what it spreads)."""
    signs = _signs(v.shape[1])
    out = np.zeros((len(v), signs.shape[1]))
    out[:, :v.shape[1]] = v
    return _hadamard(_hadamard(out * signs[0]) * signs[1]) / signs.shape[1]


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as unsigned 64-bit words."""
    return np.packbits(bits.astype(bool), axis=1, bitorder="little").view("<u8")


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code words, alignment, shadow length, residual length) of rows of
    whole numbers."""
    u = rotated(v)
    full, signs = u.shape[1], _signs(v.shape[1])
    align = np.abs(u).sum(axis=1) / np.sqrt(full)
    shadow = (_hadamard(_hadamard(np.where(u >= 0, 1.0, -1.0)) * signs[1]) * signs[0])[:, :v.shape[1]] / full ** 1.5
    span = np.maximum(np.linalg.norm(shadow, axis=1), 1e-12)
    rest = np.sqrt(np.maximum(np.einsum("ij,ij->i", v, v) - (align / span) ** 2, 0.0))
    return packed(u >= 0), align, span, rest


def _by_width(column: pa.Array) -> dict[int, np.ndarray]:
    lens = column.value_lengths().to_numpy(zero_copy_only=False)
    return {int(w): np.flatnonzero(lens == w) for w in np.unique(lens)}


def _matrix(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width).astype(np.float64)


def _encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        v = batch.column("v")
        for width, rows in _by_width(v).items():
            code, *lengths = encode(_matrix(v, rows, width))
            picked = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, pa.FixedSizeListArray.from_arrays(pa.array(code.view("<i8").ravel()), code.shape[1]).cast(pa.list_(pa.int64())),
                 *map(pa.array, lengths)], names=[*picked.schema.names, "code", "align", "span", "rest"])


def whole_vectors(rows: DataFrame, scale: int = SCALE, id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, one per id."""
    x = F.col(vector)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    kept = rows.where(F.col(id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False)))

    def whole(e):
        scaled = e.cast("double") * scale
        return F.when(F.abs(scaled) >= EXACT, F.raise_error(F.lit("a component is too large for integer scores")).cast("bigint")).otherwise(F.floor(scaled))

    kept = kept.select(F.col(id).alias("vec_id"), F.col(label).cast("bigint").alias("label"), F.transform(x, whole).alias("v"))
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def code_index(vectors: DataFrame) -> DataFrame:
    """``vectors`` with their codes and lengths, written once."""
    return stage_table(map_batches(vectors, _encode_rows, "vec_id bigint, label bigint, v array<bigint>, code array<bigint>, align double, span double, rest double"), "codes")


# ------------------------------------------------------------------ kernel

class Block:
    """A block of the index of one width, in id order."""

    def __init__(self, table: pa.Table, rows: np.ndarray, width: int):
        def col(name):
            return table.column(name).combine_chunks().take(pa.array(rows))

        ids = col("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.label = ids[order], col("label").to_numpy()[order]
        self.v = _matrix(table.column("v").combine_chunks(), rows[order], width)
        words = col("code").value_lengths()[0].as_py()
        self.code = col("code").flatten().to_numpy().reshape(-1, words)[order].view("<u8")
        self.ones = np.bitwise_count(self.code).sum(axis=1).astype(np.float64)
        self.align, self.span, self.rest = (col(c).to_numpy()[order] for c in ("align", "span", "rest"))
        self.length = np.sqrt(np.einsum("ij,ij->i", self.v, self.v))
        self.largest = float(np.abs(self.v).max(initial=0.0))

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of the scores of anchors (rows) and vectors."""
        w = rotated(q)
        low = w.min(axis=1, keepdims=True)
        step = (w.max(axis=1, keepdims=True) - low) / (2 ** PLANES - 1)
        level = np.rint(np.divide(w - low, step, out=np.zeros_like(w), where=step > 0)).astype(np.uint8)
        near = low + level * step
        error = np.linalg.norm(w - near, axis=1)[:, None]
        levels = np.zeros((len(q), len(self.ids)))
        for bit in range(PLANES):
            plane = packed(level >> bit & 1)
            for word in range(plane.shape[1]):
                levels += np.bitwise_count(plane[:, word][:, None] & self.code[:, word][None, :]) * float(1 << bit)
        dot = (2 * (low * self.ones + step * levels) - near.sum(axis=1, keepdims=True)) / np.sqrt(w.shape[1])
        length = np.linalg.norm(q, axis=1)[:, None]
        sure = np.maximum(np.abs(dot) - error, 0.0) / self.span
        slack = 1e-6 + 1e-9 * length * self.length
        share = self.align / self.span ** 2
        half = share * error + self.rest * np.sqrt(np.maximum(length ** 2 - sure ** 2, 0.0)) + slack
        middle = share * dot
        return middle - half, middle + half

    def scores(self, q: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Integer scores where ``wanted`` (NaN elsewhere), held exactly in
        doubles."""
        if q.shape[1] * float(np.abs(q).max(initial=0.0)) * self.largest >= EXACT:
            raise OverflowError("scores of these vectors are too large")
        out = np.full(wanted.shape, np.nan)
        for i in range(len(q)):
            at = np.flatnonzero(wanted[i])
            out[i, at] = self.v[at] @ q[i]
        return out


def _blocks(table: pa.Table) -> dict[int, Block]:
    table = table.combine_chunks()
    return {w: Block(table, rows, w) for w, rows in _by_width(table.column("v").combine_chunks()).items()}


def _pieces(blocks: dict[int, Block], batch: pa.RecordBatch):
    """(block, rows of the batch, their vectors), a bounded number of pairs at a time."""
    v = batch.column("v")
    for width, rows in _by_width(v).items():
        if (block := blocks.get(width)) is None:
            continue
        step = max(1, CELLS // len(block.ids))
        for lo in range(0, len(rows), step):
            yield block, rows[lo:lo + step], _matrix(v, rows[lo:lo + step], width)


def positive_kernel(k: int):
    def make(table: pa.Table):
        blocks = _blocks(table)

        def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for b, rows, q in _pieces(blocks, batch):
                lower, upper = b.intervals(q)
                mine = (b.label[None, :] == labels[rows][:, None]) & (b.ids[None, :] != ids[rows][:, None])
                lower[~mine] = -np.inf
                n = lower.shape[1]
                cut = np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else np.full(len(rows), -np.inf)
                wanted = mine & (upper >= cut[:, None])
                s = b.scores(q, wanted)
                r, c = best_k(s, k, wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows][r]), pa.array(b.ids[c]), pa.array(s[r, c].astype(np.int64))], names=["anchor_id", "positive_id", "score"])
        return run
    return make


def negative_kernel(k: int, low: int, high: int):
    def make(table: pa.Table):
        blocks = _blocks(table)

        def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            found = batch.column("positives").to_pylist()
            for b, rows, q in _pieces(blocks, batch):
                lower, upper = b.intervals(q)
                other = b.label[None, :] != labels[rows][:, None]
                wanted = np.zeros(other.shape, dtype=bool)
                windows = [[(p["positive_id"], p["score"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in found[i]] for i in rows]
                for i, own in enumerate(windows):
                    for _, _, a, z in own:
                        if a <= z:
                            wanted[i] |= other[i] & (upper[i] >= a) & (lower[i] <= z)
                s = b.scores(q, wanted)
                out: list[tuple] = []
                for i, own in enumerate(windows):
                    for positive, score, a, z in own:
                        at = np.flatnonzero(wanted[i] & (s[i] >= a) & (s[i] <= z))
                        at = at[np.lexsort((at, -s[i, at]))[:k]]
                        out += [(ids[rows[i]], positive, score, b.ids[j], int(s[i, j])) for j in at]
                names = ["anchor_id", "positive_id", "positive_score", "negative_id", "score"]
                columns = zip(*out, strict=True) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.int64()) for c in columns], names=names)
        return run
    return make


# ------------------------------------------------------------------ operator

def mine(rows: DataFrame, anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE,
         n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): the best ``n_negatives`` rows of another label with
    ``low`` to ``high`` hundredths of the positive's score, for each of the
    best ``n_positives`` rows of the anchor's label.  ``anchor`` (over
    ``vec_id``) says which rows are anchors."""
    index = code_index(whole_vectors(rows, scale, id, label, vector))
    n = index.count()
    anchors = index.where(anchor).select("vec_id", "label", "v")
    near = block_grid(anchors, index, positive_kernel(n_positives), "anchor_id bigint, positive_id bigint, score bigint", block_rows, n)
    near = stage_table(rank_within(near, ["anchor_id"], n_positives, "positive_id"), "positives")
    lists = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))
    hard = block_grid(anchors.join(lists, "vec_id"), index, negative_kernel(n_negatives, low, high),
                      "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, score bigint", block_rows, n)
    ranked = rank_within(hard, ["anchor_id", "positive_id"], n_negatives, "negative_id")
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
                         F.col("score").alias("negative_score"))
