"""Ranked lexical search: the best documents of each item by NRA over impact-sorted lists.

Terms are the maximal runs of ASCII letters and digits and of all characters from U+0080 on, with
A-Z in lower case. One pass over the documents counts their terms and keeps those that some item
holds; three totals and a document count for each term of the items follow from it, and with them
every impact. Documents are then searched where they lie: a task takes `shard_postings` of them at
a time as a shard, with a list for each term in falling order of impact, and reads the lists of an
item sequentially, all to the same depth ("no random access"). For each document it knows the sum
of what was read, a lower bound, and adds the last impact of each list that did not show the
document yet, an upper bound. When no other document can reach the k-th best, the lists go on to
be read for the k members alone until their scores are final. Ties are settled the same way: an
upper bound that equals the k-th score does not end the reading.

Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifflume.llm.common import Words, ship, slices, staged

_TERM = np.arange(256, dtype=np.uint8)
_TERM[ord("A") : ord("Z") + 1] += 32
_TERM[[b for b in range(128) if not chr(b).isalnum()]] = 0x20

#: Entries of each list that the first round reads; each further round reads four times as deep.
FIRST_DEPTH = 256
#: Tasks whose results are merged at once, before all are.
MERGED = 256


def terms_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, term hashes, where each text's begin and the last end), slice by slice."""
    for low, high, data, bounds in slices(texts):
        words = Words(_TERM[data], bounds, lower=False)
        yield low, high, words.hashes().astype(np.int64), words.first


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, its distinct terms and how often each occurs; equal items once, items without terms not at all."""
    ship(items.sparkSession)

    def rows(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for a, b, hashes, first in terms_of(batch.column(1)):
                for i in range(b - a):
                    terms, times = np.unique(hashes[first[i] : first[i + 1]], return_counts=True)
                    out.append((ids[a + i], terms, times.astype(np.int64)))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], lists), pa.array(columns[2], lists)], ["item_id", "terms", "times"])

    found = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(rows, "item_id long, terms array<long>, times array<long>")
    return found.where(F.size("terms") > 0).distinct()


def counted(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """doc_id, its number of terms, and which of the `wanted` (ascending hashes) it holds how often; without terms: no row."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(wanted)

    def rows(batches):
        known = sent.value
        for batch in batches:
            for a, b, hashes, first in terms_of(batch.column(1)):
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero(known[place] == hashes)
                of = np.searchsorted(first, hit, "right") - 1
                keys, times = np.unique(of * len(known) + place[hit], return_counts=True)
                bounds = pa.array(np.searchsorted(keys, np.arange(b - a + 1) * len(known)).astype(np.int32))
                held = [pa.ListArray.from_arrays(bounds, pa.array(v.astype(np.int32))) for v in (keys % len(known), times)]
                n = np.diff(first)
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), *held], ["doc_id", "n", "terms", "times"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n long, terms array<int>, times array<int>")


class Shard:
    """Impact-sorted lists over some documents, numbered from 0 in the order that settles ties."""

    def __init__(self, of: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n: int):
        self.n = n
        order = np.lexsort((of, -impacts, terms))
        self.docs, self.impacts = of[order], impacts[order]
        self.held, starts = np.unique(terms[order], return_index=True)
        self.starts = np.append(starts, len(terms))

    def lists(self, terms: np.ndarray, factors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Documents and scores of each term that the shard holds and that counts at all."""
        if not len(self.held):
            return []
        at = np.minimum(np.searchsorted(self.held, terms), len(self.held) - 1)
        there = (self.held[at] == terms) & (factors > 0)
        spans = [(self.starts[i], self.starts[i + 1], f) for i, f in zip(at[there], factors[there], strict=True)]
        return [(self.docs[low:high], self.impacts[low:high] * f) for low, high, f in spans]


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n: int, k: int, first_depth: int = FIRST_DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The k of n documents with the highest scores above 0, best first, equal ones by number; their scores."""
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # sums below 2**52 are exact in doubles, whose matrix products are faster
    exact = np.float64 if sum(int(s[0]) for _, s in lists) < 1 << 52 else np.int64
    lower, seen = np.zeros(n, exact), np.zeros((len(lists), n), exact)
    frontier = np.zeros(len(lists), exact)
    at, depth = 0, first_depth
    while True:
        for t, (docs, scores) in enumerate(lists):
            lower[docs[at:depth]] += scores[at:depth]
            seen[t, docs[at:depth]] = 1
            frontier[t] = scores[depth - 1] if depth < len(scores) else 0
        upper = lower + (frontier.sum() - frontier @ seen)
        members = np.argpartition(-lower, k - 1)[:k] if n > k else np.arange(n)
        bound = lower[members].min() if n > k else 0
        upper[members] = -1
        if upper.max() < bound or not frontier.any():
            break
        at, depth = depth, 4 * depth
    if not frontier.any():  # all is read: every score is final, equal ones go by number
        members = np.lexsort((np.arange(n), -lower))[:k]
    while frontier.any():  # who belongs is settled; the members' scores are not
        open_lists = np.flatnonzero((frontier > 0) & (seen[:, members] == 0).any(axis=1))
        if not len(open_lists):
            break
        inside = np.zeros(n, bool)
        inside[members] = True
        at, depth = depth, 4 * depth
        for t in open_lists:
            docs, scores = lists[t]
            mine = at + np.flatnonzero(inside[docs[at:depth]])
            lower[docs[mine]] += scores[mine]
            seen[t, docs[mine]] = 1
            frontier[t] = scores[depth - 1] if depth < len(scores) else 0
    members = members[np.lexsort((members, -lower[members]))]
    members = members[lower[members] > 0]
    return members, lower[members].astype(np.int64)


def _block(docs: DataFrame, items: list, k: int, shard_postings: int) -> DataFrame:
    spark = docs.sparkSession
    wanted = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in items]))
    rows = staged(counted(docs, wanted), "search-terms")
    total = rows.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["n"], total["terms"] or 0
    df = np.zeros(len(wanted), np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    asked = []
    for r in items:
        places = np.searchsorted(wanted, np.array(r["terms"], np.int64))
        asked.append((r["item_id"], places, weight[places] * np.array(r["times"], np.int64)))
    sent = spark.sparkContext.broadcast(asked)  # as large as the block of items

    def search(batches):
        best: list[list[tuple[int, int | None]]] = [[] for _ in sent.value]

        def searched(parts):
            shard = pa.Table.from_batches(parts).sort_by([("doc_id", "ascending")]).combine_chunks()  # null last
            ids = shard.column("doc_id").to_pylist()
            n = shard.column("n").to_numpy()
            terms, times = (shard.column(c).combine_chunks() for c in ("terms", "times"))
            of = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
            tf = times.flatten().to_numpy().astype(np.int64)
            m = 75 + (25 * n * n_docs) // n_terms
            index = Shard(of, terms.flatten().to_numpy(), (1_000_000_000 * tf) // (1000 * tf + 12 * m[of]), len(ids))
            for i, (_, places, factors) in enumerate(sent.value):
                found, scores = nra(index.lists(places, factors), index.n, k)
                both = best[i] + [(int(s), ids[d]) for d, s in zip(found, scores, strict=True)]
                best[i] = sorted(both, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]

        parts, held = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                parts.append(part)
                held += len(part.column("terms").flatten()) + part.num_rows
                if held >= shard_postings:
                    searched(parts)
                    parts, held = [], 0
        if held:
            searched(parts)
        group = TaskContext.get().partitionId() // MERGED
        out = [(i, group, sent.value[i][0], d, s) for i, b in enumerate(best) for s, d in b]
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "group", "item_id", "doc_id", "score"])

    found = rows.mapInArrow(search, "item long, group long, item_id long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = 1 << 20, shard_postings: int = 1 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents that score highest, above 0, for each item.

    Items are the stated query set: they are taken in blocks of about `block_terms` terms, which
    bound what reaches the driver and is broadcast; every block is run over all documents.
    `shard_postings` bounds a task's memory, to which one document of any length may add its
    distinct terms that items hold.

    A null or empty text has no terms: such documents are not found and don't count, such items
    have no rows. Equal items are ranked once; of equal scores the smaller doc_id comes first, a
    null one last. Rows with a repeated doc_id are documents of their own. Other columns are not
    read; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    block, held = [], 0
    for row in staged(item_terms(items), "search-items").toLocalIterator():
        block.append(row)
        held += len(row["terms"])
        if held >= block_terms:
            out = out.unionByName(_block(docs, block, k, shard_postings))
            block, held = [], 0
    return out.unionByName(_block(docs, block, k, shard_postings)) if block else out
