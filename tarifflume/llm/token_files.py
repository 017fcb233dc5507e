"""Token ids in Huffman-coded files.

A folder holds `codebook` (id, length: code lengths of a canonical, length-limited Huffman code
made from the counts of all ids) and `blocks`, in ascending doc_id over parts and blocks. A block
holds whole documents, `block_ids` ids or more, and is read without any other: `payload` has the
codes, most significant bit first, `checkpoints` the bit where each run of `run` ids begins.
Both are Parquet folders, so writes commit whole and splits follow Spark's readers.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarifflume.llm.common import remove, shared_folder, ship
from tarifflume.llm.vocabulary import SharedVocabulary

BLOCKS = "part int, block int, n_ids long, before long, doc_ids array<long>, lengths array<long>, run int, checkpoints array<long>, payload binary"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Length of each symbol's code, 0 for those that don't occur, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols have no codes of at most {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    leaf, level = [np.ones(n, bool)], weights
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((weights, packages))
        place = np.argsort(both, kind="stable")
        leaf.append(place < n)
        level = both[place]
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(leaf):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by ascending length, then symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)):
        if n := int(lengths[symbol]):
            code <<= n - last
            codes[symbol], last = code, n
            code += 1
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, run: int) -> tuple[bytes, np.ndarray]:
    """The codes of ids, and the bit where each run begins. Lengths are at most 32."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    begin = end - n
    value = codes[ids] << (64 - n - (begin & 31)).astype(np.uint64)
    size = int(end[-1] >> 5) + 2 if len(ids) else 0
    word = begin >> 5
    # bits don't overlap, so sums of 32-bit parts are exact in doubles
    words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), size)
    words += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    bits = int(end[-1]) if len(ids) else 0
    return words.astype(">u4").tobytes()[: (bits + 7) // 8], begin[::run]


class Decoder:
    """Table-driven: the next `limit` bits give symbol and length. All runs advance together."""

    def __init__(self, lengths: np.ndarray):
        self.limit = max(1, int(lengths.max(initial=1)))
        codes = canonical_codes(lengths)
        self.symbol = np.zeros(1 << self.limit, np.uint32)
        self.length = np.ones(1 << self.limit, np.uint8)
        for s in np.flatnonzero(lengths):
            n = int(lengths[s])
            low = int(codes[s]) << (self.limit - n)
            self.symbol[low : low + (1 << (self.limit - n))] = s
            self.length[low : low + (1 << (self.limit - n))] = n

    def decode(self, payload: bytes, at: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
        """The ids of runs that begin at bits `at` and have `n_ids` ids each, longest runs first."""
        data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        out = np.zeros((len(at), int(n_ids.max(initial=0))), np.uint32)
        at = at.copy()
        for k in range(out.shape[1]):
            m = int(np.searchsorted(-n_ids, -k))  # runs with more than k ids
            now = at[:m]
            bits = (window[now >> 3] >> (32 - self.limit - (now & 7)).astype(np.uint32)) & np.uint32((1 << self.limit) - 1)
            out[:m, k] = self.symbol[bits]
            now += self.length[bits]
        return out


def tokenized(docs: DataFrame, end_id: int, vocabulary: SharedVocabulary) -> DataFrame:
    """doc_id, ids: little-endian, 16 bits where the vocabulary fits them, else 32."""
    kind = "<u2" if max(vocabulary.size, end_id + 1) <= 1 << 16 else "<u4"
    end = np.array([end_id], kind).tobytes()

    def code(batches):
        coder, width = vocabulary.coder(), np.dtype(kind).itemsize
        for batch in batches:
            for a, b, ids, at in coder.ids(batch.column(1)):
                raw, at = ids.astype(kind).tobytes(), (at * width).tolist()
                rows = [raw[at[i] : at[i + 1]] + end for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(code, "doc_id long, ids binary")


def write_token_files(docs: DataFrame, path: str, end_id: int = 2, vocabulary_path: str | None = None, block_ids: int = 1 << 16, run: int = 256, limit: int = 18) -> None:
    """Writes the ids of all texts, each with `end_id` behind, in ascending doc_id.

    A null text has `end_id` alone; rows with null doc_id come first, repeated ones stand
    together; an empty table gives an empty codebook and no blocks. Counts come from all ids; only
    they (a row for each vocabulary id) reach the driver. Texts are coded once, to a staged table
    that goes when the files are written.
    """
    spark = docs.sparkSession
    ship(spark)
    vocabulary = SharedVocabulary(spark, vocabulary_path)
    size = max(vocabulary.size, end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    stage = shared_folder(spark, "ids")
    tokenized(docs, end_id, vocabulary).write.option("compression", "zstd").parquet(stage)
    tokens = spark.read.schema("doc_id long, ids binary").parquet(stage)

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            joined = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind)
            total += np.bincount(joined, minlength=size)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts, limit)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("run", pa.int32()), ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())])

    def blocks(batches):
        own_lengths, own_codes = shared.value
        part, block, before, doc_ids, texts, n_ids = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def finished():
            ids = np.frombuffer(b"".join(texts), kind)
            payload, checkpoints = encode(ids, own_lengths, own_codes, run)
            each = [len(t) // np.dtype(kind).itemsize for t in texts]
            row = {"part": part, "block": block, "n_ids": len(ids), "before": before, "doc_ids": doc_ids, "lengths": each, "run": run, "checkpoints": checkpoints, "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                texts.append(ids)
                n_ids += len(ids) // np.dtype(kind).itemsize
                if n_ids >= block_ids:
                    yield finished()
                    block, before, doc_ids, texts, n_ids = block + 1, before + n_ids, [], [], 0
        if texts:
            yield finished()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    remove(spark, stage)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (and ids) of each document."""
    ship(spark)
    book = spark.read.schema("id long, length int").parquet(f"{path}/codebook").collect()  # a row for each vocabulary id at most
    lengths = np.zeros(1 + max((r["id"] for r in book), default=0), np.uint8)
    for r in book:
        lengths[r["id"]] = r["length"]
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    names = ["part", "doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def together(decoder: Decoder, rows: list[dict]):
        """Decodes some blocks at once."""
        at, n_ids, base = [], [], 0
        for r in rows:
            runs = np.array(r["checkpoints"], np.int64)
            at.append(runs + 8 * base)
            each = np.full(len(runs), r["run"], np.int64)
            if len(each):
                each[-1] = r["n_ids"] - r["run"] * (len(each) - 1)
            n_ids.append(each)
            base += len(r["payload"])
        at, n_ids = np.concatenate(at), np.concatenate(n_ids)
        order = np.argsort(-n_ids, kind="stable")
        found = decoder.decode(b"".join(r["payload"] for r in rows), at[order], n_ids[order])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        found = found[back]
        ids = found[np.arange(found.shape[1]) < n_ids[:, None]].astype("<u4")
        raw, columns, place = ids.tobytes(), [[] for _ in names], 0
        for r in rows:
            start = r["before"]
            for doc_id, n in zip(r["doc_ids"], r["lengths"], strict=True):
                values = (r["part"], doc_id, start, n, zlib.crc32(raw[4 * place : 4 * (place + n)]), ids[place : place + n].astype(np.int32))
                for column, v in zip(columns, values, strict=False):
                    column.append(v)
                place, start = place + n, start + n
        kinds = [pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names)

    def decode(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            rows, n = [], 0
            for k in range(batch.num_rows):
                rows.append({c: batch.column(c)[k].as_py() for c in batch.schema.names})
                n += rows[-1]["n_ids"]
                if n >= 1 << 20:
                    yield together(decoder, rows)
                    rows, n = [], 0
            if rows:
                yield together(decoder, rows)

    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    decoded = blocks.mapInArrow(decode, schema)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    bases = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return decoded.join(bases, "part").withColumn("start", F.col("start") + F.col("base")).drop("part", "base")
