"""Benchmark decontamination: short test items inside long documents.

Containment search by MinHash, partitioned by size: an item of q shingles belongs to the class
of the next power of two, u. Against a whole document its Jaccard similarity would be next to
nothing, so each class has its own cut of the documents: windows of about 1.25 u shingles, one
from every u/4-th shingle on. A passage that holds 0.8 of an item then has a similarity of 0.29
or more to some window, and of 48 minima one agrees with probability 1 - 1e-7 at least. What
agrees anywhere is a candidate pair; exact containment decides.

A Bloom filter of all items' shingles, of fixed size whatever the number of items, spares the
windows that cannot agree with any item (a minimum that agrees is a shingle of the item).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifflume.llm.common import Words, mixed, ngram_hashes, ship, slices, staged

#: log2 of the bits of the Bloom filter (2 MB), and its probes.
FILTER_BITS, PROBES = 24, 2
#: Shingles of one document that are compared at once.
STRETCH = 1 << 15

_rng = np.random.Generator(np.random.PCG64(77))
_ODD = _rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, 256, np.uint64)

_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[ord("A") : ord("Z") + 1] += 32
_NORMAL[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def normal(data: np.ndarray) -> np.ndarray:
    """Lower case up to U+00FF; ASCII but letters and digits, U+0080-U+00BF (but ª µ º) and U+2000-U+203F become spaces."""
    out = _NORMAL[data]
    lead = np.flatnonzero(data[:-1] >= 0xC2) if len(data) > 1 else np.zeros(0, int)
    if len(lead):
        first, second = data[lead], data[lead + 1]
        upper = lead[(first == 0xC3) & (second < 0x9F) & (second != 0x97)]
        out[upper + 1] += 0x20
        blank = lead[(first == 0xC2) & ~np.isin(second, (0xAA, 0xB5, 0xBA))]
        out[blank] = out[blank + 1] = 0x20
        wide = lead[(first == 0xE2) & (second == 0x80)]
        for k in range(3):
            out[np.minimum(wide + k, len(data) - 1)] = 0x20
    return out


def shingles_of(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text, one after the other, and where each text's begin and the last end.

    A text of fewer than n words, but one, has one shingle: all its words.
    """
    words = Words(normal(data), bounds, lower=False)
    hashes, first = words.hashes(), words.first
    counts = np.diff(first)
    each = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(each)))
    out = np.empty(int(at[-1]), np.uint64)
    full = ngram_hashes(hashes, n)
    long = np.flatnonzero(counts >= n)
    place = np.repeat(first[long] - at[long], each[long])
    inside = np.repeat(counts >= n, each)
    out[inside] = full[np.flatnonzero(inside) + place]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        own = hashes[first[i] : first[i + 1]]
        out[at[i]] = ngram_hashes(own, len(own))[0] ^ np.uint64(len(own))
    return out, at


def size_class(q: int) -> int:
    return max(0, (q - 1).bit_length())


def window_minima(shingles: np.ndarray, u: int, hashes: int) -> np.ndarray:
    """Minima (hashes x windows) of the windows for items of up to u shingles."""
    step = max(1, u // 4)
    wide = -(-(u + step - 1) // step)
    chunks = -(-len(shingles) // step)
    values = np.full((hashes, (chunks + wide - 1) * step), 2**64 - 1, np.uint64)
    values[:, : len(shingles)] = shingles[None, :] * _ODD[:hashes, None] + _ADD[:hashes, None]
    least = values.reshape(hashes, -1, step).min(axis=2)
    return np.lib.stride_tricks.sliding_window_view(least, wide, axis=1).min(axis=2)


def keys_of(minima: np.ndarray, of_class: int) -> np.ndarray:
    salt = (np.arange(minima.shape[0], dtype=np.uint64) << np.uint64(8)) + np.uint64(of_class)
    return mixed(minima ^ mixed(salt)[:, None]).view(np.int64)


def item_sets(items: DataFrame, n: int, hashes: int) -> DataFrame:
    """item_id, n_shingles, size class, distinct shingles and MinHash keys of each item with words."""

    def build(batches):
        for batch in batches:
            rows = []
            for a, b, data, bounds in slices(batch.column(1)):
                found, at = shingles_of(data, bounds, n)
                for i in range(b - a):
                    own = np.unique(found[at[i] : at[i + 1]])
                    if len(own):
                        k = size_class(len(own))
                        minima = (own[None, :] * _ODD[:hashes, None] + _ADD[:hashes, None]).min(axis=1)
                        rows.append((batch.column(0)[a + i].as_py(), len(own), k, own.view(np.int64), keys_of(minima[:, None], k)[:, 0]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item_id", "n_item_shingles", "size_class", "shingles", "keys"])

    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(build, "item_id long, n_item_shingles long, size_class int, shingles array<long>, keys array<long>")


def bloom(spark: SparkSession, shingles: DataFrame) -> np.ndarray:
    """The filter's bits, as booleans; rows of 4 KB, at most 2**FILTER_BITS / 32768 of them, reach the driver."""
    mask, probes = (1 << FILTER_BITS) - 1, []
    for k in range(PROBES):
        probes.append(F.shiftrightunsigned("shingle", k * FILTER_BITS).bitwiseAND(F.lit(mask)))
    bits = shingles.select(F.explode(F.array(*probes)).alias("bit"))
    parts = bits.groupBy((F.col("bit") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg((F.col("bit") % 32768)).alias("bits"))
    out = np.zeros(1 << FILTER_BITS, bool)
    for row in parts.collect():
        own = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        out[row["part"] * 32768 : (row["part"] + 1) * 32768] = own
    return out


def in_bloom(bits: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    found = bits[shingles & mask]
    at = np.flatnonzero(found)
    for k in range(1, PROBES):
        at = at[bits[(shingles[at] >> np.uint64(k * FILTER_BITS)) & mask]]
    out = np.zeros(len(shingles), bool)
    out[at] = True
    return out


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, hashes: int = 48) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment of each pair with containment >= threshold.

    Containment: the part of an item's distinct n-word shingles that the document holds anywhere;
    words are runs of letters and digits in lower case (see `normal`). An item of fewer than n
    words has one shingle, all its words, and only a document of just these words holds it; items
    and documents without words (null texts) are in no pair. Rows with null ids are in no pair;
    documents of the same id count as one; repeated items give one pair. Empty tables: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    sets = staged(item_sets(items, n, hashes), "items")
    item_shingles = sets.select("item_id", "n_item_shingles", F.explode("shingles").alias("shingle")).distinct()
    classes = sorted(r[0] for r in sets.select("size_class").distinct().collect())  # at most 63
    shared = spark.sparkContext.broadcast(np.packbits(bloom(spark, item_shingles)))
    inverse = np.array([pow(int(x), -1, 2**64) for x in _ODD[:hashes]], np.uint64)

    def search(batches):
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            rows = []
            for a, b, data, bounds in slices(batch.column(1)):
                found, at = shingles_of(data, bounds, n)
                hit = in_bloom(bits, found)
                before = np.concatenate(([0], np.cumsum(hit)))[at]
                for i in np.flatnonzero(np.diff(before)):
                    own, held, keys = found[at[i] : at[i + 1]], hit[at[i] : at[i + 1]], []
                    for k in classes:
                        u = 1 << k
                        for start in range(0, len(own), STRETCH):
                            end = start + STRETCH + 2 * u
                            if not held[start:end].any():
                                continue
                            minima = window_minima(own[start:end], u, hashes)
                            back = (minima - _ADD[:hashes, None]) * inverse[:, None]
                            keys.append(keys_of(minima, k)[in_bloom(bits, back.ravel()).reshape(back.shape)])
                    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
                    if len(keys):
                        rows.append((batch.column(0)[a + i].as_py(), keys, np.unique(own[held]).view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "keys", "shingles"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    near = staged(rows.mapInArrow(search, "doc_id long, keys array<long>, shingles array<long>"), "windows")
    keys = sets.select("item_id", F.explode("keys").alias("key"))
    pairs = near.select("doc_id", F.explode("keys").alias("key")).join(keys, "key").select("doc_id", "item_id").distinct()
    held = near.select("doc_id", F.explode("shingles").alias("shingle")).distinct()
    shared_counts = (
        pairs.join(item_shingles, "item_id")
        .join(held, ["doc_id", "shingle"])
        .groupBy("doc_id", "item_id", "n_item_shingles")
        .agg(F.count("*").alias("n_shared"))
    )
    share = F.col("n_shared") / F.col("n_item_shingles")
    return shared_counts.where(share >= threshold).withColumn("containment", share)


def without_contaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` that are in no pair of `contaminated`; rows with null doc_id stay."""
    return docs.join(contaminated(docs, items, **settings).select("doc_id").distinct(), "doc_id", "left_anti")
