"""Token-id files by an adaptive context-mixing range coder.

A file is a set of *segments* (rows of a Parquet folder, so writing commits
atomically, any shared store will do, and a lost executor's work is redone).
A segment holds whole documents: their ids and token counts, an order-0
table of its tokens, and *blocks* of ``BLOCK`` tokens.  Every block starts
from the same reset model and carries its own CRC-32, so any block can be
read, checked or lost alone.

Coding a token (model state per block):

* order 2 and order 1 each predict the id that followed the last two ids /
  the last id, with a confidence from past hits;
* one binary decision says whether the predicted id is right.  Its
  probability is a logistic mix of three inputs - adaptive hit rates of the
  order-2 and order-1 states and the order-0 probability of the predicted
  id - with weights that learn after every token;
* if it is wrong, the id is coded by the order-0 distribution.

Both go through a range coder (48-bit low, 16-bit words; carries are
resolved when a block ends).  The model uses integers and single IEEE
additions and multiplications only (logarithms come from tables whose
checksum is stored), so a reader gets exactly the writer's model.  All blocks of a segment are coded in step
with NumPy, one lane each.

Edge cases: a null or empty text is only the end id; texts of any length are
encoded whole and may span blocks; rows that repeat a doc_id are separate
documents, ordered by text; null ids come first; an empty table gives an
empty file and result; other columns do not matter; a block whose checksum
is wrong raises an error.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import id_bounds, map_batches, range_bucket, shuffle_partitions, stage_table
from quarry.llm.tokens import encoder, text_groups
from quarry.session import scratch_path

BLOCK = 2048                # tokens a block holds
SEGMENT = 4_000_000         # tokens at which a segment is closed (at a document's end)
END_ID = 1
VOCABULARY = 1 << 16

_SLOTS = 2048               # entries of each order's prediction table, per block
_BITS = 12                  # resolution of mixed probabilities
_RATE = 5                   # adaptation shift of hit rates
_TOTAL = 1 << 16            # range of literal frequencies


def _logistic_tables() -> tuple[np.ndarray, np.ndarray]:
    """stretch(p) = 256 ln(p / (1 - p)) of 12-bit p, and its inverse over
    [-2047, 2047], as integers."""
    top = 1 << _BITS
    stretch = [max(-2047, min(2047, round(256 * math.log((p + 0.5) / (top - p - 0.5))))) for p in range(top)]
    squash = [max(16, min(top - 16, round(top / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)]
    return np.array(stretch, np.float32), np.array(squash, np.int32)


_STRETCH, _SQUASH = _logistic_tables()
_TABLES_CRC = zlib.crc32(_STRETCH.tobytes() + _SQUASH.tobytes())


# --- order-0 table --------------------------------------------------------------

def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a total of 2^16, at least 1 for every id present."""
    present = np.flatnonzero(counts)
    spare = _TOTAL - len(present)
    if spare < 0:
        raise ValueError("more distinct ids than the order-0 table can hold")
    freq = np.zeros(len(counts), np.int64)
    freq[present] = 1 + counts[present] * spare // counts.sum()
    freq[present[np.argmax(counts[present])]] += _TOTAL - int(freq.sum())
    return freq


def pack_table(freq: np.ndarray) -> bytes:
    ids = np.flatnonzero(freq)
    gaps = np.diff(ids, prepend=-1) - 1
    return zlib.compress(np.concatenate([gaps, freq[ids] - 1]).astype("<u2").tobytes(), 6)


def unpack_table(raw: bytes) -> np.ndarray:
    both = np.frombuffer(zlib.decompress(raw), "<u2").astype(np.int64)
    gaps, rest = both[:len(both) // 2], both[len(both) // 2:]
    freq = np.zeros(VOCABULARY, np.int64)
    freq[np.cumsum(gaps + 1) - 1] = rest + 1
    return freq


def _order0_stretch(freq: np.ndarray) -> np.ndarray:
    """256 ln(f / 2^16), by integers only (log2 with a linear fraction)."""
    f = np.maximum(freq, 1)
    k = np.bitwise_count(f | f >> 1 | f >> 2 | f >> 3 | f >> 4 | f >> 5 | f >> 6 | f >> 7 | f >> 8 | f >> 9 | f >> 10 | f >> 11
                         | f >> 12 | f >> 13 | f >> 14 | f >> 15 | f >> 16).astype(np.int64) - 1
    log2 = (k << 8) + ((f << 8) >> k) - 256 - (16 << 8)
    return np.maximum(log2 * 177 >> 8, -2047)


# --- model ----------------------------------------------------------------------

class Model:
    """Predictions for one step of all lanes; reset by construction."""

    def __init__(self, lanes: int, freq: np.ndarray):
        self.prior = _order0_stretch(freq).astype(np.float32)
        self.t1 = np.zeros(lanes * _SLOTS, np.int32)          # predicted id << 3 | confidence
        self.t2 = np.zeros(lanes * _SLOTS, np.int32)
        self.rate1 = np.full(lanes * 16, 1 << 15, np.int32)
        self.rate2 = np.full(lanes * 8, 1 << 15, np.int32)
        for i in range(8):                                    # start: more past hits, more trust
            self.rate2[i::8] = (6 + 7 * i) << 10
            self.rate1[2 * i::16] = (2 + 2 * i) << 10
            self.rate1[2 * i + 1::16] = (4 + 7 * i) << 10
        self.w0, self.w1, self.w2 = (np.full(lanes, w, np.float32) for w in (0.125, 0.75, 0.75))
        lane = np.arange(lanes, dtype=np.int64)
        self.slot0, self.row1, self.row2 = lane * _SLOTS, lane * 16, lane * 8

    def predict(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(predicted id, 12-bit probability that it is right)."""
        self.i1 = self.slot0 + ((last * 40503 >> 5) & (_SLOTS - 1))
        self.i2 = self.slot0 + (((last * 0x1E3779B1 ^ before * 0x05EBCA6B) >> 15) & (_SLOTS - 1))
        e1, e2 = self.t1.take(self.i1, mode="clip"), self.t2.take(self.i2, mode="clip")
        c1, c2 = e1 >> 3, e2 >> 3
        n1, n2 = e1 & 7, e2 & 7
        guess = np.where(n2, c2, c1)
        self.k1 = self.row1 + (n1 + n1 + (c1 == guess))
        self.k2 = self.row2 + n2
        self.p1, self.p2 = self.rate1.take(self.k1, mode="clip"), self.rate2.take(self.k2, mode="clip")
        self.s1, self.s2 = _STRETCH.take(self.p1 >> 4, mode="clip"), _STRETCH.take(self.p2 >> 4, mode="clip")
        self.s0 = self.prior.take(guess, mode="clip")
        mix = self.w0 * self.s0
        mix += self.w1 * self.s1
        mix += self.w2 * self.s2
        mix += np.float32(2047)
        self.p = _SQUASH.take(mix.astype(np.int32), mode="clip")
        self.e1, self.e2, self.c1, self.c2, self.n1, self.n2 = e1, e2, c1, c2, n1, n2
        return guess, self.p

    def learn(self, hit: np.ndarray, ids: np.ndarray) -> None:
        up = hit.astype(np.int32)
        err = ((up << _BITS) - self.p).astype(np.float32)
        err *= np.float32(2.0 ** -30)
        self.w0 += self.s0 * err
        self.w1 += self.s1 * err
        self.w2 += self.s2 * err
        goal = (up << 16) - up
        self.rate1[self.k1] = self.p1 + ((goal - self.p1) >> _RATE)
        self.rate2[self.k2] = self.p2 + ((goal - self.p2) >> _RATE)
        fresh = (ids << 3) | 1
        for table, at, entry, guess, n in ((self.t1, self.i1, self.e1, self.c1, self.n1), (self.t2, self.i2, self.e2, self.c2, self.n2)):
            table[at] = np.where(guess == ids, entry + (n < 7), np.where(n > 1, entry - ((n + 1) >> 1), fresh))


# --- range coder ------------------------------------------------------------------

_LOW_MASK = np.uint64((1 << 32) - 1)
_U12, _U16, _U32 = np.uint64(_BITS), np.uint64(16), np.uint64(32)


def encode_lanes(x: np.ndarray, freq: np.ndarray) -> list[bytes]:
    """Code words of every lane of ``x`` (steps x lanes)."""
    steps, lanes = x.shape
    model = Model(lanes, freq)
    f, cum = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
    words = np.zeros((lanes, 2 * steps + 4), np.uint32)
    flat, at = words.reshape(-1), np.arange(lanes, dtype=np.int64) * words.shape[1]
    start = at.copy()
    zero, whole = np.uint64(0), np.uint64(_TOTAL)

    def settle(low, rng):
        small = np.flatnonzero(rng <= _LOW_MASK)
        if len(small):
            part = low[small]
            flat[at[small]] = part >> _U32                     # up to 17 bits: the carry is resolved at the end
            at[small] += 1
            low[small] = (part & _LOW_MASK) << _U16
            rng[small] <<= _U16

    last = before = np.zeros(lanes, np.int32)
    for ids in x:
        guess, p = model.predict(last, before)
        hit = guess == ids
        bound = (rng >> _U12) * p.astype(np.uint64)
        low += np.where(hit, zero, bound)
        rng = np.where(hit, bound, rng - bound)
        settle(low, rng)
        r = rng >> _U16
        low += r * np.where(hit, zero, cum.take(ids, mode="clip"))
        rng = r * np.where(hit, whole, f.take(ids, mode="clip"))
        settle(low, rng)
        model.learn(hit, ids)
        last, before = ids, last
    for _ in range(3):                                         # flush the 48 bits of low
        flat[at] = low >> _U32
        at += 1
        low = (low & _LOW_MASK) << _U16
    for i in range(words.shape[1] - 1, 0, -1):                 # carries run toward the front
        words[:, i - 1] += words[:, i] >> 16
    words &= 0xFFFF
    out = words.astype("<u2")
    return [out[i, :n].tobytes() for i, n in enumerate((at - start).tolist())]


def decode_lanes(payloads: list[bytes], steps: int, freq: np.ndarray) -> np.ndarray:
    """Inverse of :func:`encode_lanes`: ids as (steps x lanes)."""
    lanes = len(payloads)
    model = Model(lanes, freq)
    f, cum = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    ids_of = np.repeat(np.arange(len(freq), dtype=np.int32), freq)             # slot -> id
    width = max(map(len, payloads)) // 2 + 2
    words = np.zeros((lanes, width), np.uint64)
    for i, raw in enumerate(payloads):
        words[i, :len(raw) // 2] = np.frombuffer(raw, "<u2")
    flat, at = words.reshape(-1), np.arange(lanes, dtype=np.int64) * width
    code = (flat[at] << _U32) | (flat[at + 1] << _U16) | flat[at + 2]
    at += 3
    rng = np.full(lanes, 1 << 48, np.uint64)
    zero, whole, top = np.uint64(0), np.uint64(_TOTAL), np.uint64(_TOTAL - 1)

    def settle(code, rng):
        small = np.flatnonzero(rng <= _LOW_MASK)
        if len(small):
            code[small] = (code[small] << _U16) | flat[at[small]]
            at[small] += 1
            rng[small] <<= _U16

    out = np.empty((steps, lanes), np.int32)
    last = before = np.zeros(lanes, np.int32)
    for i in range(steps):
        guess, p = model.predict(last, before)
        bound = (rng >> _U12) * p.astype(np.uint64)
        hit = code < bound
        code -= np.where(hit, zero, bound)
        rng = np.where(hit, bound, rng - bound)
        settle(code, rng)
        r = rng >> _U16
        ids = np.where(hit, guess, ids_of.take(np.minimum(code // r, top).astype(np.int64), mode="clip"))
        code -= r * np.where(hit, zero, cum.take(ids, mode="clip"))
        rng = r * np.where(hit, whole, f.take(ids, mode="clip"))
        settle(code, rng)
        out[i] = ids
        model.learn(hit, ids)
        last, before = ids, last
    return out


# --- segments ----------------------------------------------------------------------

def encode_segment(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, list[bytes], list[int]]:
    """(order-0 table, payload of every block, CRC-32 of every block's ids)."""
    freq = frequencies(np.bincount(ids, minlength=VOCABULARY))
    lanes = -(-len(ids) // block)
    padded = np.concatenate([ids, np.full(lanes * block - len(ids), ids[-1], ids.dtype)]).reshape(lanes, block)
    steps = min(block, len(ids))
    payloads = encode_lanes(np.ascontiguousarray(padded[:, :steps].T).astype(np.int32), freq)
    return pack_table(freq), payloads, [zlib.crc32(ids[i:i + block].astype("<u4").tobytes()) for i in range(0, len(ids), block)]


def decode_segment(table: bytes, payloads: list[bytes], crcs: list[int], n: int, block: int = BLOCK) -> np.ndarray:
    ids = decode_lanes(payloads, min(block, n), unpack_table(table)).T.reshape(-1)[:n].astype("<u4")
    for i, crc in enumerate(crcs):
        if zlib.crc32(ids[i * block:(i + 1) * block].tobytes()) != crc:
            raise ValueError(f"checksum of block {i} does not match")
    return ids


_SEGMENT = ("bucket int, segment int, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, model_crc bigint, "
            "order0 binary, payloads array<binary>, block_crcs array<bigint>")


def _segment_rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int, target: int, special: bool) -> Iterable[pa.RecordBatch]:
    enc = encoder(path, spaced=False, special=special)
    end = end_id.to_bytes(4, "little")
    names = [c.split()[0] for c in _SEGMENT.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.binary()),
             pa.list_(pa.int64())]
    docs, lengths, raws, size, bucket, number = [], [], [], 0, None, 0

    def close():
        ids = np.frombuffer(b"".join(raws), "<u4")
        table, payloads, crcs = encode_segment(ids)
        row = [bucket, number, len(ids), docs, lengths, _TABLES_CRC, table, payloads, crcs]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    for rb in batches:
        buckets, ids, texts = rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2)
        for part in text_groups(texts):
            for b, doc, raw in zip(buckets[part], ids[part], enc.encode(texts[part]), strict=True):
                if docs and (b != bucket or size >= target):
                    yield close()
                    number = number + 1 if b == bucket else 0
                    docs, lengths, raws, size = [], [], [], 0
                elif b != bucket:
                    number = 0
                bucket = b
                raw += end
                docs.append(doc)
                lengths.append(len(raw) // 4)
                raws.append(raw)
                size += len(raw) // 4
    if docs:
        yield close()


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = END_ID, target: int = SEGMENT, special: bool = False) -> None:
    """Write the ids of every text of ``docs``, in ascending doc_id order,
    as segments under ``out``."""
    parts = shuffle_partitions(docs.sparkSession)
    bounds = id_bounds(docs, parts)
    keyed = docs.select(range_bucket(F.col("doc_id"), bounds).cast("int").alias("bucket"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    dealt = keyed.repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "text")
    map_batches(dealt, lambda it: _segment_rows(it, path, end_id, target, special), _SEGMENT).write.parquet(out)


_DOCS = "bucket int, segment int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for rb in batches:
        for row in rb.to_pylist():
            if row["model_crc"] != _TABLES_CRC:
                raise ValueError("the file was written with another model")
            ids = decode_segment(row["order0"], row["payloads"], row["block_crcs"], row["n_tokens"])
            lens = np.array(row["doc_tokens"], np.int64)
            stop = np.cumsum(lens)
            crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((stop - lens).tolist(), stop.tolist(), strict=True)]
            n = len(lens)
            cols = [pa.array([row["bucket"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(stop - lens), pa.array(lens), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _DOCS.split(", ")])


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded
    from the segments under ``out``.

    Segment offsets: totals per range of ids are accumulated over at most
    ``shuffle.partitions`` rows, then within each range."""
    seg = spark.read.schema(_SEGMENT).parquet(out)
    totals = seg.groupBy("bucket").agg(F.sum("n_tokens").alias("t"))
    ahead = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("bucket").alias("tb"), F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("before"))
    inside = W.partitionBy("bucket").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    offsets = (seg.select("bucket", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside"))
               .join(totals, F.col("bucket") == F.col("tb"))
               .select(F.col("bucket").alias("b"), F.col("segment").alias("s"), (F.col("before") + F.col("inside")).alias("offset")))
    offsets = stage_table(offsets, "token-offsets")
    rows = map_batches(seg.repartition(shuffle_partitions(spark), "bucket", "segment"), _document_rows, _DOCS)
    return (rows.join(offsets, (F.col("bucket") == F.col("b")) & (F.col("segment") == F.col("s")))
            .select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"))


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID, target: int = SEGMENT, special: bool = False) -> DataFrame:
    """Write ``docs`` to a token file in the shared folder and read it back."""
    out = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, out, end_id, target, special)
    return read_tokens(docs.sparkSession, out)
