"""Best-fit-decreasing packing of token documents into sequences of a fixed size."""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifflume.llm.common import ship, staged
from tarifflume.llm.vocabulary import SharedVocabulary


class Capacities:
    """Open bins by remaining capacity; a segment tree finds the tightest one that fits."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def put(self, left: int, first: int, n: int) -> None:
        """`n` bins from number `first` on have `left` places left."""
        self.bins[left].append((first, n))
        self._add(left, 1)

    def take(self, left: int) -> tuple[int, int]:
        self._add(left, -1)
        return self.bins[left].pop()

    def _add(self, left: int, by: int) -> None:
        i = left + self.leaves
        while i:
            self.tree[i] += by
            i //= 2

    def tightest(self, length: int) -> int:
        """The least remaining capacity, of `length` at least, of an open bin; -1 if none."""
        i = length + self.leaves
        if not self.tree[i]:
            while i > 1 and (i % 2 or not self.tree[i + 1]):
                i //= 2
            if i <= 1:
                return -1
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_plan(counts: Mapping[int, int], size: int) -> np.ndarray:
    """Best-fit decreasing over pieces given as counts by length.

    Rows (length, rank, n, bin, offset): the pieces of that length with ranks rank..rank+n-1 go
    to bins bin..bin+n-1, each at `offset`. Equal pieces meet equal bins, so bins of one content
    are handled as one range: the plan is that of one-by-one best-fit decreasing, in a time that
    depends on `size` and not on the number of pieces.
    """
    open_bins, plan, bins = Capacities(size), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = open_bins.tightest(length)
            if room < 0:  # new bins
                room, n, first = size, -(-left // (size // length)), bins
                bins += n
            else:
                first, n = open_bins.take(room)
            each = room // length  # the next piece of this length fits this bin tightest, as long as it fits
            full = min(n, left // each)
            for k in range(each if full else 0):
                plan.append((length, rank, full, first, size - room + k * length))
                rank += full
            left -= full * each
            if full and room > each * length:
                open_bins.put(room - each * length, first, full)
            first, n = first + full, n - full
            if n and left:  # one bin takes what is left of this length
                for k in range(left):
                    plan.append((length, rank, 1, first, size - room + k * length))
                    rank += 1
                open_bins.put(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            if n:
                open_bins.put(room, first, n)
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, size: int, end_id: int, path: str | None, with_ids: bool) -> DataFrame:
    """Pieces of each document, and their rank among those of the same length in their task."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = SharedVocabulary(spark, path)
    names = ["part", "doc_id", "piece", "start", "length", "ids_crc32", "rank", *["ids"] * with_ids]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        coder, part = vocabulary.coder(), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, ids, at in coder.ids(batch.column(1)):
                raw, rows, parts = ids.astype("<u4").tobytes(), [], []
                for i in range(b - a):
                    own = raw[4 * at[i] : 4 * at[i + 1]] + end
                    for k, start in enumerate(range(0, len(own), 4 * size)):
                        piece = own[start : start + 4 * size]
                        length = len(piece) // 4
                        rows.append((part, doc_ids[a + i], k, start // 4, length, zlib.crc32(piece), seen[length]))
                        seen[length] += 1
                        if with_ids:
                            parts.append(np.frombuffer(piece, "<i4"))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4], strict=True)]
                if with_ids:
                    columns.append(pa.array(parts, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, rank long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, size: int = 2048, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of each piece of `docs`.

    Documents (ids and `end_id`) longer than `size` are cut into pieces of `size`; all pieces are
    packed by best-fit decreasing. Only counts by length (at most `size` rows) reach the driver;
    a piece finds its bin by its rank among the pieces of its length, which is its rank in its
    task plus the pieces of that length in earlier tasks. Pieces are written once to the shared
    folder, so ranks stand when executors are lost.

    A null text is an empty document: one piece with `end_id` alone. Rows with null or repeated
    doc_id are packed like any other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = staged(cut_pieces(docs, size, end_id, path, with_ids), "pieces")
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit_plan(counts, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = [c for c in pieces.columns if c not in ("part", "rank")]

    def place(batches):
        steps = plan.value
        keys = (steps[:, 0] << 44) | steps[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            step = steps[np.searchsorted(keys, (batch.column("length").to_numpy() << 44) | rank, "right") - 1]
            columns = [batch.column(c) for c in names]
            columns += [pa.array(step[:, 3] + rank - step[:, 1]), pa.array(step[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select(*names, (F.col("rank") + F.col("base")).alias("rank"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return ranked.mapInArrow(place, f"{kept}, sequence_id long, offset long")
