"""Sharding by fixed virtual slots and a versioned map from slots to shards."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarifflume.llm.common import shared_folder

#: Virtual slots. Fixed for the life of a data set: only the map from slots to shards changes.
SLOTS = 4096

MAP = "slot int, shard int, first long"


def even_map(slots: int, shards: int) -> list[int]:
    """Version 0: slots dealt out in runs of equal number."""
    return [s * shards // slots for s in range(slots)]


def rebalanced(shard_of: list[int], slot_bytes: list[int], shards: int) -> list[int]:
    """The map with as few slots moved as it takes to bring every shard near the mean size.

    Shards over the mean release their smallest slots until they are not; released slots go, largest
    first, to the smallest shard; then slots of the largest and the smallest shard change places
    while that brings the two closer.
    """
    out, sizes = np.array(shard_of), np.array(slot_bytes, np.int64)
    load = np.bincount(out, sizes, shards).astype(np.int64)
    mean, free = sizes.sum() / shards, []
    for shard in np.flatnonzero(load > mean):
        own = np.flatnonzero((out == shard) & (sizes > 0))
        for slot in own[np.argsort(sizes[own], kind="stable")]:
            if load[shard] <= mean:
                break
            free.append(slot)
            load[shard] -= sizes[slot]
    heap = [(int(x), k) for k, x in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(free, key=lambda s: (-sizes[s], s)):
        x, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (x + int(sizes[slot]), shard))
    load = np.bincount(out, sizes, shards).astype(np.int64)
    for _ in range(64 * shards):
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        a, b = np.flatnonzero(out == high), np.append(np.flatnonzero(out == low), -1)
        moved = sizes[a][:, None] - np.append(sizes[b[:-1]], 0)[None, :]
        best = int(np.abs(2 * moved - gap).argmin()) if moved.size else -1
        if best < 0 or not 0 < moved.flat[best] < gap:
            break
        i, j = divmod(best, len(b))
        out[a[i]] = low
        if b[j] >= 0:
            out[b[j]] = high
        load[high] -= moved.flat[best]
        load[low] += moved.flat[best]
    return [int(x) for x in out]


def write_map(spark: SparkSession, path: str, version: int, rows: list[tuple[int, int, int]]) -> None:
    """One version of the map (a row for each slot); earlier versions stay readable."""
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{path}/version={version}")


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (place in the shard, from 0), grown_shard (null).

    Records are hashed into virtual slots; bytes and rows are summed by slot, the only figures that
    reach the driver (`slots` rows). Version 0 of the map deals slots out evenly, version 1 is its
    rebalanced edit, and both are stored under `map_path`. A row's place is its rank in its slot
    plus the rows of the shard's earlier slots, so no shard is gathered in one task: the largest
    group is one slot, and only ids and sizes are shuffled.

    A null text has no bytes (size 8, crc 0). Rows with null or repeated doc_id are placed like any
    other (repeated rows in one slot); an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = slotted(docs, slots)
    sums = {r["vslot"]: r for r in rows.groupBy("vslot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    sizes = [sums[s]["size"] if s in sums else 0 for s in range(slots)]
    path = map_path or shared_folder(spark, "slot-map")
    maps = [even_map(slots, shards)]
    maps.append(rebalanced(maps[0], sizes, shards))
    for version, shard_of in enumerate(maps):
        first, entries = [0] * shards, []
        for s, k in enumerate(shard_of):
            entries.append((s, k, first[k]))
            first[k] += sums[s]["n"] if s in sums else 0
        write_map(spark, path, version, entries)
    placed = read_map(spark, path, 1).select(F.col("slot").alias("vslot"), "shard", "first")
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("rank", rank)
        .join(F.broadcast(placed), "vslot")  # one row for each slot, whatever the data
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The rows of `docs` in a folder for each shard, in the order of their places there.

    Files hold ranges of places, so a large shard is written by many tasks.
    """
    keyed = docs.join(placed.select("doc_id", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")), "doc_id")
    keyed.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_slot").withColumnRenamed("_shard", "shard_id").write.partitionBy("shard_id").parquet(path)
