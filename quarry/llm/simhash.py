"""SimHash near-duplicates through deletion-variant signatures.

Fingerprint: a bit is 1 if it is set in more than half of the XXH64 hashes
(seed 42) of the text's word shingles, repeats included.

Search: the 64 bits are cut into ``d // 2 + 1`` segments for a maximum
distance ``d``, so that of two fingerprints within ``d`` bits at least one
segment differs by at most one bit.  Each segment is indexed once per bit
with that bit wiped (64 rows per *distinct* fingerprint); fingerprints that
meet under equal (segment, wiped bit, remaining bits) are verified on all
64 bits.  A pair is verified in the one variant that is its canonical one,
so it is found exactly once.

Crowded variants: a variant shared by more than ``CROWD`` distinct
fingerprints is not compared pair by pair.  Its members agree in the wiped
segment, so only the other bits (and the wiped one) are free; those are cut
and indexed again the same way, which leaves at most 2^10 distinct
fingerprints per variant at the third level, whatever the input.  No member
is dropped, no size is capped, and no task holds more than a bounded run.

Linked groups: links are reduced to stars within a task, then joined into
connected components by alternating large-star and small-star rounds, each
written to the shared folder.  The component id is the smallest doc_id of
the component.

Edge cases: null and empty texts have fingerprint 0 and are linked like any
other; fewer words than a shingle form one shingle; copies and repeated
rows share a fingerprint and are one node of the search; a component whose
ids are all null has a null id; every shingle of a text of any length
counts; an empty table gives an empty result; other
columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, prepare_python, shuffle_partitions, stage_table

SHINGLE = 3
MAX_BITS = 3
SEED = 42
CROWD = 256
BROADCAST_ROWS = 2_000_000     # ids of dropped rows (8 bytes each) sent to every task at most
LEVELS = 3

_find = re.compile(rb"[^\x20\x09-\x0D]+").findall


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one UTF-8 text, as an unsigned integer."""
    words = _find((text or b"").lower())           # bytes: only A-Z change
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterable[bytes] = [b" ".join(words)]
        n = 1
    else:
        n = len(words) - shingle + 1
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = h[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def simhash(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint column (signed BIGINT with the same bits)."""

    @F.arrow_udf("bigint")
    def fp(texts: pa.Array) -> pa.Array:
        got = np.array([fingerprint(t, shingle) for t in texts.cast(pa.binary()).to_pylist()], np.uint64)
        return pa.array(got.view(np.int64))

    return fp(text)


# --- search -----------------------------------------------------------------

def segment_masks(max_bits: int) -> list[int]:
    m = max_bits // 2 + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def first_variants(prints: DataFrame, max_bits: int) -> DataFrame:
    """(bit, key, fp): one row per bit of the fingerprint, where ``key`` is
    the bit's segment with that bit wiped."""
    masks = segment_masks(max_bits)
    rows = [(b, m & ~(1 << b)) for m in masks for b in range(64) if m >> b & 1]
    table = F.array(*[F.struct(F.lit(b).cast("tinyint").alias("bit"), F.lit(_signed(m)).alias("mask")) for b, m in rows])
    return (prints.select("fp", F.explode(table).alias("v"))
            .select("v.bit", F.col("fp").bitwiseAND(F.col("v.mask")).alias("key"), "fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _canonical(x: np.ndarray, masks: list[int]) -> np.ndarray:
    """Bit of the variant in which a pair with difference ``x`` is verified:
    the differing bit of its first segment with at most one, or that
    segment's lowest bit if there is none."""
    out = np.full(len(x), -1, np.int64)
    for m in masks:
        d = x & np.uint64(m)
        n = np.bitwise_count(d)
        low = np.uint64(m & -m)
        bit = np.bitwise_count(np.where(n == 0, low, d) - np.uint64(1)).astype(np.int64)
        out = np.where((out < 0) & (n <= 1), bit, out)
    return out


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the same components, each node linked to its smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[:len(a)], at[len(a):]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[ia], lab[ib])
        new = lab.copy()
        np.minimum.at(new, ia, low)
        np.minimum.at(new, ib, low)
        new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    far = lab != np.arange(len(nodes))
    return nodes[far], nodes[lab[far]]


def _verify_runs(bit: np.ndarray, key: np.ndarray, fp: np.ndarray, max_bits: int, masks: list[int] | None, crowd: int):
    """Linked pairs within runs of equal (bit, key), and the rows of runs
    longer than ``crowd``."""
    n = len(fp)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (bit[1:] != bit[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    length = np.repeat(size, size)
    after = length - 1 - (np.arange(n) - np.repeat(start, size))      # rows of the run behind this one
    big = length > crowd
    pairs_a, pairs_b = [], []
    at, shift = np.flatnonzero(~big & (after >= 1)), 1
    while len(at):
        x = fp[at] ^ fp[at + shift]
        ok = np.bitwise_count(x) <= max_bits
        if masks is not None:
            ok[ok] = _canonical(x[ok], masks) == bit[at[ok]]
        pairs_a.append(fp[at[ok]])
        pairs_b.append(fp[at[ok] + shift])
        shift += 1
        at = at[after[at] >= shift]
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.uint64)
    return cat(pairs_a), cat(pairs_b), big


_FOUND = "crowded boolean, bit bigint, key bigint, a bigint, b bigint"


def _search_partition(batches: Iterator[pa.RecordBatch], max_bits: int, masks: list[int] | None, crowd: int) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by (bit, key) and keeps only the last, unfinished
    run between batches; a run past ``crowd`` rows is passed on at once."""
    schema = pa.schema([("crowded", pa.bool_()), ("bit", pa.int64()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def batch(crowded, bit, key, a, b):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, crowded)), pa.array(bit.astype(np.int64)), pa.array(key.view(np.int64)),
             pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    def handle(bit, key, fp):
        a, b, big = _verify_runs(bit, key, fp, max_bits, masks, crowd)
        if len(a):
            a, b = _stars(a, b)
            zero = np.zeros(len(a), np.uint64)
            yield batch(False, zero, zero, a, b)
        if big.any():
            yield batch(True, bit[big], key[big], fp[big], fp[big])

    held = None
    passing = None                                   # (bit, key) of the crowded run that is streaming through
    for rb in batches:
        bit = rb.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        key = np.ascontiguousarray(rb.column(1).to_numpy(zero_copy_only=False)).view(np.uint64)
        fp = np.ascontiguousarray(rb.column(2).to_numpy(zero_copy_only=False)).view(np.uint64)
        if passing is not None:
            same = (bit == passing[0]) & (key == passing[1])
            if same.any():
                yield batch(True, bit[same], key[same], fp[same], fp[same])
            if same.all():
                continue
            passing = None
            bit, key, fp = bit[~same], key[~same], fp[~same]
        if held is not None:
            bit, key, fp = (np.concatenate(x) for x in zip(held, (bit, key, fp), strict=True))
            held = None
        if not len(fp):
            continue
        last = int(np.argmax((bit == bit[-1]) & (key == key[-1])))
        if len(fp) - last > crowd:
            passing = (bit[-1], key[-1])
            yield from handle(bit, key, fp)
        else:
            if last:
                yield from handle(bit[:last], key[:last], fp[:last])
            held = (bit[last:], key[last:], fp[last:])
    if held is not None:
        yield from handle(*held)


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _finer_variants(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """(group, free, fp) -> (group', free', fp): the free bits cut into
    segments, each wiped at one bit; ``free'`` is what is left open."""
    for rb in batches:
        group, free, fp = (np.ascontiguousarray(rb.column(i).to_numpy(zero_copy_only=False)).view(np.uint64) for i in range(3))
        for mask in np.unique(free):
            rows = free == mask
            g, f = group[rows], fp[rows]
            bits = [b for b in range(64) if int(mask) >> b & 1]
            cuts = [len(bits) * i // segments for i in range(segments + 1)]
            for i in range(segments):
                part = bits[cuts[i]:cuts[i + 1]]
                whole = sum(1 << b for b in part)
                for b in part:
                    left = int(mask) & ~whole | (1 << b)
                    h = _mix(g, np.full(len(g), b, np.uint64), f & np.uint64(whole & ~(1 << b)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(np.full(len(g), _signed(left), np.int64)), pa.array(f.view(np.int64))],
                        names=["grp", "free", "fp"])


def links(prints: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """(a, b): edges that connect exactly the distinct fingerprints ``fp``
    of ``prints`` reachable through pairs within ``max_bits``."""
    masks = segment_masks(max_bits)
    parts = shuffle_partitions(prints.sparkSession)

    def search(rows: DataFrame, canonical: bool, limit: int, name: str) -> DataFrame:
        dealt = rows.repartition(parts, "bit", "key").sortWithinPartitions("bit", "key")
        found = map_batches(dealt, lambda it: _search_partition(it, max_bits, masks if canonical else None, limit), _FOUND)
        return stage_table(found, name)

    found = search(first_variants(prints, max_bits), True, crowd, "simhash-1")
    edges = found.where("not crowded").select("a", "b")
    whole = {b: m for m in masks for b in range(64) if m >> b & 1}
    for level in range(2, LEVELS + 1):
        crowded = found.where("crowded")
        if not crowded.take(1):
            break
        if level == 2:
            free = F.element_at(F.array(*[F.lit(_signed(~whole[b] & (1 << 64) - 1 | 1 << b)) for b in range(64)]), (F.col("bit") + 1).cast("int"))
            rows = crowded.select(F.xxhash64("bit", "key").alias("grp"), free.alias("free"), F.col("a").alias("fp"))
        else:
            rows = crowded.select(F.col("key").alias("grp"), F.col("bit").alias("free"), F.col("a").alias("fp"))
        finer = map_batches(rows, lambda it: _finer_variants(it, len(masks)), "grp bigint, free bigint, fp bigint")
        finer = finer.select(F.col("free").alias("bit"), F.col("grp").alias("key"), "fp")
        last = level == LEVELS
        found = search(finer, False, 1 << 62 if last else crowd, f"simhash-{level}")
        edges = edges.union(found.where("not crowded").select("a", "b"))
    return edges


# --- components -------------------------------------------------------------

def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node
    of its connected component."""
    e = stage_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-0")
    before = _signature(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage_table(large, "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(low, F.col("u") == F.col("x"))
        small = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())
        e = stage_table(small, "cc")
        after = _signature(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def component_ids(prints: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``prints``
    (doc_id, fp); ``root`` is the component's smallest fingerprint."""
    nodes = stage_table(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    roots = components(links(nodes, max_bits, crowd))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    placed = stage_table(placed, "simhash-placed")
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    return stage_table(placed.join(lowest, F.col("root") == F.col("r")).select("fp", "root", "component_id"), "simhash-ids")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``."""
    prepare_python(docs.sparkSession)
    prints = stage_table(docs.select("doc_id", simhash(F.col("text"), shingle).alias("fp")), "simhash-prints")
    ids = component_ids(prints, max_bits, crowd).withColumnRenamed("fp", "__fp")
    return prints.join(ids, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """``docs`` with one row of every component: the one with the smallest
    doc_id (among rows that repeat it, the first written; null ids last)."""
    prepare_python(docs.sparkSession)
    rows = stage_table(docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("doc_id"), simhash(F.col("text"), shingle).alias("fp"),
                                   F.monotonically_increasing_id().alias("row")), "simhash-rows")
    ids = component_ids(rows.select("doc_id", "fp"), max_bits, crowd).withColumnRenamed("fp", "__fp")
    best = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    keep = (best.join(ids, F.col("fp") == F.col("__fp")).groupBy("root").agg(F.min("best").alias("best"))
            .select(F.col("best.row").alias("kept_row")))
    # Ids of the rows that go, so that texts need not be shuffled: broadcast
    # up to a measured count, else joined by shuffle.
    gone = stage_table(rows.select("row").join(keep, F.col("row") == F.col("kept_row"), "left_anti").select(F.col("row").alias("gone_row")),
                       "simhash-gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, F.col("row") == F.col("gone_row"), "left_anti").select("doc.*")
