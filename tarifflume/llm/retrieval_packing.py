"""Packing with lexical neighbours: a sharded BM25 index fills each seed document's window.

A document longer than a window gives whole windows of its own; its tail, like every shorter
document, is packed with what resembles it. Terms are token ids, so document frequencies are a
table of vocabulary size. Documents are ordered by their heaviest terms and dealt by range: what
is alike comes to the same task, and equal documents spread over as many tasks as they fill. A
task takes its rows in that order, `shard_tokens` at a time, and builds an inverted index of each
such shard. The first unused document is a seed; the unused documents that score best against it
follow until the window is full. What doesn't fit of the last one begins the next window, so
windows hold no padding. The window that is open when a task ends is cut at powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifflume.llm.common import remove, ship, staged
from tarifflume.llm.vocabulary import SharedVocabulary

#: Heaviest terms that order the documents.
ROUTE = 3
_K1, _B = 1.2, 0.75

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = pa.schema([(c.split()[0], pa.int64()) for c in _PIECE.split(", ")])
_TOKENS = f"kind int, {_PIECE}, tail binary, terms binary, documents array<long>"


def term_counts(of: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, how often), by text and term, for tokens `ids` of texts `of`."""
    keys, counts = np.unique(of.astype(np.int64) * size + ids, return_counts=True)
    return keys // size, keys % size, counts


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """A term's weight, by the number of documents that hold it."""
    return np.log1p((n_docs - df + 0.5) / (df + 0.5))


def saturated(counts: np.ndarray, lengths: np.ndarray, mean: float) -> np.ndarray:
    return counts * (_K1 + 1) / (counts + _K1 * (1 - _B + _B * lengths / mean))


def tokenized(docs: DataFrame, size: int, end_id: int, vocabulary: SharedVocabulary) -> DataFrame:
    """Rows of three kinds: 0 whole windows of long documents, 1 tails, 2 documents by term, one row a task.

    A tail has its ids, and for a document with windows of its own also the terms and counts of
    the whole document.
    """
    ship(docs.sparkSession)
    schema = pa.schema([("kind", pa.int32()), *_PIECES, ("tail", pa.binary()), ("terms", pa.binary()), ("documents", pa.list_(pa.int64()))])

    def rows(batches):
        coder, part = vocabulary.coder(), TaskContext.get().partitionId()
        documents, windows = np.zeros(vocabulary.size, np.int64), 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, ids, at in coder.ids(batch.column(1)):
                of = np.repeat(np.arange(b - a), np.diff(at))
                documents += np.bincount(term_counts(of, ids, vocabulary.size)[1], minlength=vocabulary.size)
                raw, out = ids.astype("<u4").tobytes(), []
                for i in range(b - a):
                    own = raw[4 * at[i] : 4 * at[i + 1]] + np.array([end_id], "<u4").tobytes()
                    n, doc_id = len(own) // 4, doc_ids[a + i]
                    whole = n // size
                    for k in range(whole):
                        crc = zlib.crc32(own[4 * size * k : 4 * size * (k + 1)])
                        out.append((0, doc_id, size * k, size, crc, n, (part << 32 | windows) * 2, 0, None, None, None))
                        windows += 1
                    if n > size * whole:
                        terms = None
                        if whole:
                            _, t, c = term_counts(np.zeros(n - 1, int), np.frombuffer(own, "<u4")[:-1], vocabulary.size)
                            terms = np.stack((t, c)).astype("<u4").tobytes()
                        out.append((1, doc_id, size * whole, n - size * whole, None, n, None, None, own[4 * size * whole :], terms, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        last = [2, *[None] * 9, documents]
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(last, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, _TOKENS)


def document_terms(batch: dict[str, list], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of whole documents, from their tails or, where given, their term lists."""
    of, terms, counts = [], [], []
    short = [i for i, t in enumerate(batch["terms"]) if t is None]
    ids = [np.frombuffer(batch["tail"][i], "<u4")[:-1] for i in short]
    if ids:
        a, t, c = term_counts(np.repeat(short, [len(x) for x in ids]), np.concatenate(ids), size)
        of.append(a), terms.append(t), counts.append(c)
    for i, known in enumerate(batch["terms"]):
        if known is not None:
            t, c = np.frombuffer(known, "<u4").reshape(2, -1).astype(np.int64)
            of.append(np.full(len(t), i)), terms.append(t), counts.append(c)
    if not of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, terms, counts = map(np.concatenate, (of, terms, counts))
    order = np.argsort(of, kind="stable")
    return of[order], terms[order], counts[order]


class Shard:
    """An inverted index over some documents: for each term its documents and their scores."""

    def __init__(self, of: np.ndarray, terms: np.ndarray, scores: np.ndarray, n: int):
        self.n, self.of, self.terms = n, of, terms  # by document
        self.first = np.searchsorted(of, np.arange(n + 1))
        order = np.argsort(terms, kind="stable")
        self.docs, self.scores = of[order], scores[order]
        self.held, starts = np.unique(terms[order], return_index=True)
        self.starts = np.append(starts, len(terms))

    def query_of(self, doc: int) -> np.ndarray:
        return self.terms[self.first[doc] : self.first[doc + 1]]

    def scored(self, query: np.ndarray) -> np.ndarray:
        """The score of every document of the shard for the terms of a query."""
        at = np.searchsorted(self.held, query)
        at = at[(at < len(self.held)) & (self.held[np.minimum(at, len(self.held) - 1)] == query)] if len(self.held) else at[:0]
        low, lengths = self.starts[at], self.starts[at + 1] - self.starts[at]
        place = np.repeat(low - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        return np.bincount(self.docs[place], self.scores[place], self.n)


class Windows:
    """The window that is being filled: its pieces are given out as they come."""

    def __init__(self, size: int, part: int):
        self.size, self.part, self.number, self.filled = size, part, 0, 0
        self.query: np.ndarray | None = None  # terms of the seed
        self.open: list[tuple] = []

    def add(self, doc: dict, begin: int) -> tuple[list[tuple], int]:
        """Ids of a tail from `begin` on, as many as fit: pieces of windows that are full now, and ids taken."""
        n = min(len(doc["tail"]) // 4 - begin, self.size - self.filled)
        self.open.append((doc, begin, n, self.filled))
        self.filled += n
        return (self.closed() if self.filled == self.size else []), n

    def closed(self) -> list[tuple]:
        sequence = (self.part << 32 | self.number) * 2 + 1
        out = [
            (d["doc_id"], d["start"] + begin, n, zlib.crc32(d["tail"][4 * begin : 4 * (begin + n)]), d["doc_tokens"], sequence, offset)
            for d, begin, n, offset in self.open
        ]
        self.open, self.filled, self.query = [], 0, None
        self.number += 1
        return out

    def cut(self) -> list[tuple]:
        """The open window as sequences whose lengths are powers of two, longest first."""
        left, out = self.open, []
        self.open, total, self.filled = [], self.filled, 0
        while left:
            room = 1 << (total.bit_length() - 1)
            total -= room
            while room:
                doc, begin, n, _ = left.pop(0)
                taken = min(n, room)
                self.open.append((doc, begin, taken, self.filled))
                self.filled += taken
                room -= taken
                if taken < n:
                    left.insert(0, (doc, begin + taken, n - taken, 0))
            out += self.closed()
        return out


def filled(docs: list[dict], shard: Shard, windows: Windows) -> Iterator[tuple]:
    """Pieces of full windows; each document of the shard is used once, neighbours of the seed first."""
    unused, seed, left = np.ones(len(docs), bool), 0, len(docs)
    rest: tuple[int, int] | None = None  # the document that was cut, and where
    while left or rest:
        first = rest
        if windows.query is None:  # a new window: it begins with the rest, or with the next unused document
            if not first:
                while not unused[seed]:
                    seed += 1
                first = (seed, 0)
                unused[seed] = False
                left -= 1
            windows.query = shard.query_of(first[0])
        if first:
            doc, begin = first
            pieces, n = windows.add(docs[doc], begin)
            yield from pieces
            rest = (doc, begin + n) if begin + n < docs[doc]["length"] else None
            if pieces:
                continue
        for doc in best_first(np.where(unused, shard.scored(windows.query), -1.0)) if left else ():
            unused[doc] = False
            left -= 1
            pieces, n = windows.add(docs[doc], 0)
            yield from pieces
            rest = (doc, n) if n < docs[doc]["length"] else None
            if pieces:
                break


def best_first(scores: np.ndarray) -> Iterator[int]:
    """Documents by falling score, equal ones in their order, without those below 0; sorted some at a time."""
    step, done = 64, 0
    n = int((scores >= 0).sum())
    while done < n:
        some = min(step, n)
        if some < len(scores):
            bound = np.partition(scores, len(scores) - some)[len(scores) - some]
            top = np.flatnonzero(scores >= bound)
        else:
            top = np.arange(len(scores))
        top = top[np.argsort(-scores[top], kind="stable")]
        top = top[scores[top] >= 0]
        for doc in top[done:]:
            yield int(doc)
        done, step = max(done, len(top)), step * 8


def pack(docs: DataFrame, size: int = 4096, end_id: int = 2, path: str | None = None, shard_tokens: int = 1 << 20, task_tokens: int = 1 << 22) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of `docs`.

    Each id of a document (its tokens and `end_id`) is in exactly one piece. Sequences are `size`
    long, but for those that end a task: they have the lengths of the powers of two that make up
    what was left. `shard_tokens` bounds an index (a task's memory), `task_tokens` is what a task
    of the packing takes on average; neither leaves anything out. Of the corpus, the driver sees
    document counts by vocabulary id and three totals.

    A null text is an empty document: `end_id` alone. Rows with null or repeated doc_id are packed
    like any other; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    vocabulary = SharedVocabulary(spark, path)
    rows = staged(tokenized(docs, size, end_id, vocabulary), "retrieval-tokens")
    total = rows.where("start = 0").agg(F.count("*").alias("n"), F.sum("doc_tokens").alias("tokens")).first()
    tail_tokens = rows.where("kind = 1").agg(F.sum("length")).first()[0] or 0
    df = np.zeros(vocabulary.size)
    for r in rows.where("kind = 2").select(F.posexplode("documents").alias("term", "n")).where("n > 0").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    mean = max(1.0, (total["tokens"] or 0) / max(1, total["n"]))
    weight = spark.sparkContext.broadcast(weights(df, total["n"]))  # of vocabulary size
    tails = rows.where("kind = 1").select("doc_id", "start", "length", "doc_tokens", "tail", "terms")

    def scored(batch: dict[str, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of, terms, counts = document_terms(batch, vocabulary_size)
        return of, terms, weight.value[terms] * saturated(counts, np.array(batch["doc_tokens"])[of], mean)

    vocabulary_size = vocabulary.size

    def routed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            of, terms, scores = scored(batch.to_pydict())
            order = np.lexsort((terms, -scores, of))
            of, terms = of[order], terms[order]
            first = np.searchsorted(of, np.arange(batch.num_rows + 1))
            columns = list(batch.columns)
            for k in range(ROUTE):
                place = first[:-1] + k
                key = np.where(place < first[1:], terms[np.minimum(place, max(0, len(terms) - 1))] if len(terms) else -1, -1)
                columns.append(pa.array(key.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *route])

    route = [f"route{k}" for k in range(ROUTE)]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tails.schema)
    keyed = tails.mapInArrow(routed, kinds + "".join(f", {c} int" for c in route))
    tasks = max(1, -(-tail_tokens // task_tokens))
    dealt = keyed.repartitionByRange(tasks, *route, "doc_id", "start").sortWithinPartitions(*route, "doc_id", "start")

    def packed(batches):
        windows, shard, held = Windows(size, TaskContext.get().partitionId()), [], 0

        def flushed():
            columns = {c: [d[c] for d in shard] for c in ("tail", "terms", "doc_tokens")}
            of, terms, scores = scored(columns)
            return filled(shard, Shard(of, terms, scores.astype(np.float32), len(shard)), windows)

        out: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                shard.append(row)
                held += row["length"] + (len(row["terms"]) // 8 if row["terms"] else 0)
                if held >= shard_tokens:
                    out += flushed()
                    shard, held = [], 0
                    yield pieces_of(out)
                    out = []
        if shard:
            out += flushed()
        out += windows.cut()
        yield pieces_of(out)

    inside = dealt.mapInArrow(packed, _PIECE)
    return rows.where("kind = 0").select(*_PIECES.names).unionByName(inside)


def pieces_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_PIECES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)
