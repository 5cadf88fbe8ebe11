"""Best-fit packing by a grouping genetic algorithm.

Documents become token pieces (ids plus an end id); only a document longer
than a sequence is cut, its first piece taking the odd length, so all other
pieces of it fill a sequence alone.  What is left to pack are pieces shorter
than a sequence.

Pieces are dealt to shards of about ``SHARD`` pieces by hash.  Each shard is
packed by ``ISLANDS`` populations.  An individual is a grouping of the
shard's pieces into bins; a crossover injects whole well-filled bins of one
parent into the other, removes the bins that now hold a piece twice, and
best-fits the displaced pieces.  After every epoch the islands of a shard
exchange their elites (each gets its neighbour's); at the end the best
island stands.  Bins that stay under ``GOOD_FILL`` are opened and their
pieces dealt anew for another round, so that partly filled bins of many
shards meet.

Everything a task holds is one shard (a bounded list of lengths); texts and
tokens are read once, and only (piece, length) rows are shuffled.

Edge cases: a null or empty text is one piece of the end id; rows that
repeat a doc_id are separate documents; equal lengths are told apart by the
piece's row number; an empty table gives an empty result; other columns do
not matter; a text of any length is tokenised whole.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, shuffle_partitions, stage_table
from quarry.llm.tokens import encoder, text_groups

LENGTH = 1024
END_ID = 2
SHARD = 1024
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 8
POPULATION = 6
ROUNDS = 3
GOOD_FILL = 0.995
SEED = 11


# --- pieces -------------------------------------------------------------------

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _piece_rows(batches: Iterator[pa.RecordBatch], path: str, length: int, end_id: int, special: bool) -> Iterable[pa.RecordBatch]:
    enc = encoder(path, spaced=True, special=special)
    end = end_id.to_bytes(4, "little")
    for rb in batches:
        ids, texts = rb.column(0).to_pylist(), rb.column(1)
        cols: list[list] = [[] for _ in range(5)]
        for part in text_groups(texts):
            for doc, raw in zip(ids[part], enc.encode(texts[part]), strict=True):
                raw += end
                n = len(raw) // 4
                start, stop, piece = 0, (n - 1) % length + 1, 0
                while start < n:
                    for c, v in zip(cols, (doc, piece, start, stop - start, zlib.crc32(raw[4 * start:4 * stop])), strict=True):
                        c.append(v)
                    start, stop, piece = stop, stop + length, piece + 1
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                         names=["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, special: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""
    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"),
                       lambda it: _piece_rows(it, path, length, end_id, special), _PIECES)


# --- grouping genetic algorithm -------------------------------------------------

class Shelf:
    """Bins by free space, for best fit: a bit mask of the free sizes in
    use finds the tightest bin in one step."""

    def __init__(self, capacity: int, free: list[int]):
        self.capacity, self.free = capacity, free
        self.by_free: dict[int, list[int]] = defaultdict(list)
        for b, f in enumerate(free):
            self.by_free[f].append(b)
        self.mask = sum(1 << f for f in self.by_free if f)

    def place(self, items: Iterable[int], lens: list[int], bins: np.ndarray) -> None:
        """Put every item, in order, into the bin it fits most tightly (a
        new one if it fits none)."""
        mask, free, by_free, capacity = self.mask, self.free, self.by_free, self.capacity
        for i in items:
            size = lens[i]
            m = mask >> size
            if m:
                f = size + (m & -m).bit_length() - 1
                at = by_free[f]
                b = at.pop()
                if not at:
                    mask ^= 1 << f
                f -= size
                free[b] = f
            else:
                b, f = len(free), capacity - size
                free.append(f)
            if f:
                by_free[f].append(b)
                mask |= 1 << f
            bins[i] = b
        self.mask = mask


def best_fit(sizes: np.ndarray, order: Iterable[int], capacity: int) -> np.ndarray:
    """Bin of every item when placed in ``order`` by best fit."""
    out = np.empty(len(sizes), np.int32)
    Shelf(capacity, []).place(order, sizes.tolist(), out)
    return out


def shuffled_by_size(sizes: np.ndarray, spread: float, rng: np.random.Generator) -> list[int]:
    """Positions from large to small, sizes blurred by up to ``spread``."""
    return np.argsort(-sizes * rng.uniform(1 - spread, 1 + spread, len(sizes)), kind="stable").tolist()


def fills(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=sizes)


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Fewer bins first, then fuller ones among them."""
    f = fills(bins, sizes)
    return -len(f) + float(np.mean((f / capacity) ** 2))


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Child of ``a`` with whole well-filled bins of ``b`` injected."""
    fb = fills(b, sizes)
    good = np.flatnonzero(fb >= 0.98 * capacity)
    if not len(good):
        good = np.argsort(-fb)[:max(1, len(fb) // 4)]
    chosen = np.zeros(len(fb), bool)
    chosen[rng.choice(good, max(1, int(len(good) * rng.uniform(0.1, 0.5))), replace=False)] = True
    injected = chosen[b]                                       # items that arrive in b's bins
    fa = fills(a, sizes)
    broken = np.zeros(len(fa), bool)
    broken[a[injected]] = True                                 # bins of a that hold one of them
    broken[np.argsort(fa)[:max(1, len(fa) // 20)]] = True      # the emptiest bins are opened, too
    child = np.where(injected, b + len(broken), a)
    kept = injected | ~broken[a]
    used, place = np.unique(child[kept], return_inverse=True)
    child[kept] = place
    shelf = Shelf(capacity, (capacity - np.bincount(place, weights=sizes[kept], minlength=len(used))).astype(int).tolist())
    loose = np.flatnonzero(~kept)
    order = shuffled_by_size(sizes[loose], 0.1 * (rng.random() < 0.5), rng)      # half of the time a little out of order
    shelf.place(loose[order].tolist(), sizes.tolist(), child)
    return child.astype(np.int32)


def evolve(sizes: np.ndarray, elites: list[np.ndarray], capacity: int, generations: int, population: int,
           rng: np.random.Generator) -> np.ndarray:
    """Best grouping of one island after some generations."""
    fewest = -(-int(sizes.sum()) // capacity)
    pool = list(elites) or [best_fit(sizes, np.argsort(-sizes, kind="stable").tolist(), capacity)]
    scored = [(fitness(p, sizes, capacity), p) for p in pool]
    while len(scored) < population and min(int(p.max()) for _, p in scored) + 1 > fewest:
        p = best_fit(sizes, shuffled_by_size(sizes, 0.2, rng), capacity)
        scored.append((fitness(p, sizes, capacity), p))
    for _ in range(generations):
        best = max(scored, key=lambda x: x[0])
        if int(best[1].max()) + 1 <= fewest or len(scored) < 2:
            break
        children = []
        while len(children) < population - 1:
            # Two tournaments of two; the parents must differ.
            one, two = (max((scored[i] for i in rng.choice(len(scored), 2, replace=False)), key=lambda x: x[0]) for _ in range(2))
            if one[1] is two[1]:
                two = scored[(next(i for i, x in enumerate(scored) if x[1] is one[1]) + 1 + int(rng.integers(len(scored) - 1))) % len(scored)]
            c = crossover(one[1], two[1], sizes, capacity, rng)
            children.append((fitness(c, sizes, capacity), c))
        scored = sorted([*scored, *children], key=lambda x: -x[0])[:population]
    return max(scored, key=lambda x: x[0])[1]


# --- islands ---------------------------------------------------------------------

_ISLAND = "shard bigint, island int, epoch int, items array<bigint>, sizes array<int>, bins array<int>, score double"


def _evolve_rows(batches: Iterator[pa.RecordBatch], capacity: int, generations: int, population: int, seed: int) -> Iterable[pa.RecordBatch]:
    names = [c.split()[0] for c in _ISLAND.split(", ")]
    for rb in batches:
        for row in rb.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            elites = [np.array(e, np.int32) for e in row["elites"]]
            rng = np.random.default_rng([seed, row["shard"], row["island"], row["epoch"]])
            bins = evolve(sizes, elites, capacity, generations, population, rng)
            out = [[row["shard"]], [row["island"]], [row["epoch"]], [row["items"]], [row["sizes"]], [bins.tolist()],
                   [fitness(bins, sizes, capacity)]]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)


def _epoch(rows: DataFrame, capacity: int, generations: int, population: int, seed: int, name: str) -> DataFrame:
    dealt = rows.select("shard", "island", "epoch", "items", "sizes", "elites").repartition(
        shuffle_partitions(rows.sparkSession), "shard", "island")
    return stage_table(map_batches(dealt, lambda it: _evolve_rows(it, capacity, generations, population, seed), _ISLAND), name)


def pack_shards(items: DataFrame, shards: int, capacity: int = LENGTH, islands: int = ISLANDS, epochs: int = EPOCHS,
                generations: int = GENERATIONS, population: int = POPULATION, seed: int = SEED, salt: int = 0) -> DataFrame:
    """(shard, items, sizes, bins): the best grouping of every shard of
    ``items`` (item, length)."""
    shard = F.pmod(F.xxhash64(F.col("item"), F.lit(seed + salt)), F.lit(shards))
    state = (items.groupBy(shard.alias("shard"))
             .agg(F.sort_array(F.collect_list(F.struct("item", F.col("length").cast("int").alias("length")))).alias("x"))    # about SHARD pieces
             .select("shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.lit(0).alias("epoch"),
                     F.col("x.item").alias("items"), F.col("x.length").alias("sizes"), F.expr("cast(array() as array<array<int>>)").alias("elites")))
    done = _epoch(state, capacity, generations, population, seed, "pack-epoch-0")
    for e in range(1, epochs):
        guest = done.select(F.col("shard").alias("s"), F.pmod(F.col("island") + 1, F.lit(islands)).alias("i"), F.col("bins").alias("guest"))
        state = (done.join(guest, (F.col("shard") == F.col("s")) & (F.col("island") == F.col("i")))
                 .select("shard", "island", F.lit(e).alias("epoch"), "items", "sizes", F.array("bins", "guest").alias("elites")))
        done = _epoch(state, capacity, generations, population, seed, f"pack-epoch-{e}")
    return done.groupBy("shard").agg(F.max_by(F.struct("items", "sizes", "bins"), F.struct("score", -F.col("island"))).alias("b")).select("shard", "b.*")


def pack(pieces: DataFrame, capacity: int = LENGTH, shard_size: int = SHARD, rounds: int = ROUNDS,
         good_fill: float = GOOD_FILL, seed: int = SEED) -> DataFrame:
    """``pieces`` (with a unique ``item`` and its ``length``) plus
    ``sequence_id`` and ``offset``."""
    short = pieces.where(F.col("length") < capacity).select("item", "length")
    placed = []
    left = short
    for r in range(rounds):
        n = left.count()
        if not n:
            break
        best = pack_shards(left, max(1, -(-n // shard_size)), capacity, seed=seed, salt=r)
        last = r == rounds - 1 or n <= shard_size
        rows = (best.select("shard", F.explode(F.arrays_zip("items", "sizes", "bins")).alias("x"))
                .select("shard", F.col("x.items").alias("item"), F.col("x.sizes").alias("length"), F.col("x.bins").alias("bin")))
        bins = (rows.groupBy("shard", "bin").agg(F.sum("length").alias("fill"), F.sort_array(F.collect_list(F.struct("item", "length"))).alias("p")))
        bins = stage_table(bins, f"pack-bins-{r}")
        kept = bins if last else bins.where(F.col("fill") >= good_fill * capacity)
        # Round, shard and bin make the sequence id; offsets run through the bin.
        number = F.shiftleft(F.lit(r + 1).cast("bigint"), 58) + F.shiftleft(F.col("shard"), 18) + F.col("bin")
        offsets = F.expr("""transform(p, (x, i) -> struct(x.item as item,
            cast(aggregate(slice(p, 1, i), 0, (a, y) -> a + y.length) as bigint) as offset))""")
        placed.append(kept.select(number.alias("sequence_id"), F.explode(offsets).alias("x")).select("x.item", "sequence_id", "x.offset"))
        if last:
            break
        left = bins.where(F.col("fill") < good_fill * capacity).select(F.explode("p").alias("x")).select("x.item", "x.length")
    full = pieces.where(F.col("length") >= capacity).select("*", F.col("item").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    if not placed:
        return full
    where = placed[0]
    for p in placed[1:]:
        where = where.union(p)
    where = where.withColumnRenamed("item", "__item")
    return full.union(pieces.where(F.col("length") < capacity).join(where, F.col("item") == F.col("__item")).drop("__item"))


def pack_documents(docs: DataFrame, path: str, capacity: int = LENGTH, end_id: int = END_ID, shard_size: int = SHARD,
                   rounds: int = ROUNDS, good_fill: float = GOOD_FILL, seed: int = SEED, special: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = token_pieces(docs, path, capacity, end_id, special).withColumn("item", F.monotonically_increasing_id())
    pieces = stage_table(pieces, "pack-pieces")
    return pack(pieces, capacity, shard_size, rounds, good_fill, seed).drop("item")
