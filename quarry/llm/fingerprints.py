"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words (lower case) with their counts.  For
each of ``SAMPLES`` samples, every (word, weight) draws from gamma and
uniform variables fixed by the word and the sample number (improved
consistent weighted sampling); the smallest draw wins and contributes a
16-bit hash of the winning (word, level).  Two signatures agree in a sample
with probability equal to the generalised Jaccard similarity
``sum min(weights) / sum max(weights)`` of their texts, so the share of
equal samples estimates it.

A draw depends only on (word, weight, sample), so a worker keeps the draws
of the rows it has seen in one bounded table and a text's signature is a
gather and a column-wise minimum.

``neighbour_pairs`` gives every document its next one in descending id
order in one shuffle: ids are cut into ranges, each range is streamed in
order, and only the first document of a range is sent to the range above
as well.  No window over all rows, no text collected.

Edge cases: a null text is empty; an empty text (no word) has the reserved
all-zero fingerprint, alike to itself (1) and to nothing else (0); equal
texts have equal fingerprints; very long texts are processed in blocks of
distinct words; among rows that repeat a doc_id the order is by text; null
ids come last; a single document is its own next one; an empty table gives
an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import find_words, id_bounds, map_batches, range_bucket, shuffle_partitions

SAMPLES = 64
SEED = 7
TABLE_ROWS = 1 << 16
BLOCK = 4096                       # distinct words gathered at once
RANGES_PER_TASK = 4                # id ranges are dealt to tasks by hash: several each even out the load


def _uniform(h: np.ndarray, samples: int) -> np.ndarray:
    """(words, 5, samples) uniforms in (0, 1) from the words' 64-bit hashes:
    both halves of a hash and the lane number through a 32-bit finaliser."""
    lane = np.arange(1, 5 * samples + 1, dtype=np.uint32) * np.uint32(0x9E3779B9)
    x = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None] ^ lane
    x *= np.uint32(0x85EBCA6B)
    x ^= (h >> np.uint64(32)).astype(np.uint32)[:, None]
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    u = (x >> np.uint32(8)).astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2.0 ** -24)
    return u.reshape(len(h), 5, samples)


def draws(words: list[str], weights: np.ndarray, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each (word, weight) and sample: the log of its draw, and the
    16-bit hash of the (word, level) it stands for (never 0)."""
    h = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)
    u = _uniform(h, samples)
    r = -np.log(u[:, 0] * u[:, 1])                       # Gamma(2, 1)
    c = -np.log(u[:, 2] * u[:, 3])                       # Gamma(2, 1)
    beta = u[:, 4]
    level = np.floor(np.log(weights)[:, None] / r + beta)
    log_draw = np.log(np.maximum(c, np.float32(1e-7))) - r * (level - beta + np.float32(1))
    mark = (h >> np.uint64(20)).astype(np.uint32)[:, None] ^ (level.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B9))
    mark = (mark * np.uint32(0xD6E8FEB9) >> np.uint32(16)).astype(np.uint16)
    return log_draw, np.maximum(mark, np.uint16(1))


class Sampler:
    """Signatures of texts, with a bounded table of known draws."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED, rows: int = TABLE_ROWS):
        self.samples, self.seed, self.rows = samples, seed, rows
        self.at: dict[tuple[str, int], int] = {}
        self.draw = np.empty((rows, samples), np.float32)
        self.mark = np.empty((rows, samples), np.uint16)

    def _places(self, terms: list[tuple[str, int]]) -> np.ndarray:
        """Rows of the table that hold the terms' draws."""
        got = list(map(self.at.get, terms))
        new = [t for t, p in zip(terms, got, strict=True) if p is None]
        if not new:
            return np.array(got)
        if len(self.at) + len(new) > self.rows:
            self.at.clear()
            new = terms
        first = len(self.at)
        self.at.update(zip(new, range(first, first + len(new)), strict=True))
        weights = np.array([n for _, n in new], np.float32)
        for i in range(0, len(new), 256):
            part = slice(first + i, first + min(i + 256, len(new)))
            self.draw[part], self.mark[part] = draws([w for w, _ in new[i:i + 256]], weights[i:i + 256], self.samples, self.seed)
        return np.array(list(map(self.at.__getitem__, terms)))

    def signature(self, text: str | None) -> np.ndarray:
        terms = list(Counter(find_words((text or "").lower())).items())
        lanes = np.arange(self.samples)
        best = np.full(self.samples, np.inf, np.float32)
        out = np.zeros(self.samples, np.uint16)
        for i in range(0, len(terms), BLOCK):
            places = self._places(terms[i:i + BLOCK])
            draw = self.draw.take(places, axis=0)
            first = draw.argmin(axis=0)
            low = draw[first, lanes]
            wins = low < best
            out[wins] = self.mark[places[first], lanes][wins]
            best = np.minimum(best, low)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated generalised Jaccard similarity of two signatures."""
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """The last ``floor(n / 2)`` code points replaced by the first as many
    (or all) of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


# --- neighbours ---------------------------------------------------------------

_LOWEST = -(1 << 63)


def neighbour_stream(docs: DataFrame) -> DataFrame:
    """(bucket, peek, k, doc_id, text) in partitions sorted so that within
    a bucket each row's successor is its next document in descending id
    order; the row with ``peek`` is the next bucket's first document."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    bounds = id_bounds(docs, RANGES_PER_TASK * parts)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                        F.coalesce("doc_id", F.lit(_LOWEST)).cast("bigint").alias("k"))
    keyed = keyed.withColumn("bucket", range_bucket(F.col("k"), bounds).cast("int"))
    heads = {r["bucket"]: r["h"] for r in keyed.groupBy("bucket").agg(F.max("k").alias("h")).collect()}   # a row per range
    used = sorted(heads)
    above = {b: used[(i + 1) % len(used)] for i, b in enumerate(used)}
    n = len(bounds) + 1
    head = F.get(F.array(*[F.lit(heads.get(b)).cast("bigint") for b in range(n)]), F.col("bucket"))
    over = F.get(F.array(*[F.lit(above.get(b)).cast("int") for b in range(n)]), F.col("bucket"))
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("peek"))
    places = F.when(F.col("k") == head, F.array(own, F.struct(over.alias("b"), F.lit(True).alias("peek")))).otherwise(F.array(own))
    dealt = keyed.select("doc_id", "text", "k", F.explode(places).alias("p")).select(F.col("p.b").alias("bucket"), "p.peek", "k", "doc_id", "text")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "peek", F.desc("k"), "text")


_OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _fingerprint_pairs(batches: Iterator[pa.RecordBatch], samples: int) -> Iterable[pa.RecordBatch]:
    sampler = Sampler(samples)
    before = None                                    # (bucket, peek, doc_id, text, signature) of the last row read
    for rb in batches:
        cols: list[list] = [[] for _ in range(7)]
        rows = zip(rb.column("bucket").to_pylist(), rb.column("peek").to_pylist(), rb.column("doc_id").to_pylist(),
                   rb.column("text").to_pylist(), strict=True)
        for bucket, peek, doc_id, text in rows:
            after_peek = before is not None and before[0] == bucket and before[1]
            if after_peek:                           # further rows that repeat the peeked id
                continue
            sig = sampler.signature(text)
            if before is not None and before[0] == bucket:
                _, _, other, own, own_sig = before
                new = edited(own, text)
                new_sig = sampler.signature(new)
                row = (other, len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                       own_sig.astype(">u2").tobytes().hex(), new_sig.astype(">u2").tobytes().hex(),
                       likeness(own_sig, new_sig), likeness(own_sig, sig))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            before = (bucket, peek, doc_id, text, sig)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                         names=[c.split()[0] for c in _OUT.split(", ")])


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness."""
    return map_batches(neighbour_stream(docs), lambda it: _fingerprint_pairs(it, samples), _OUT)
