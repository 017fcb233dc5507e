"""Similarity join of documents on word n-grams, by T-occurrence search.

Two sets of sizes |x| >= |y| link when percent of their union is shared; then they differ in at most
D = (100 - percent) / (100 + percent) * (|x| + |y|) n-grams. Steps:

1. Equal sets are one from here on (the smallest doc_id stands for them), however many there are.
2. Candidates. Linked sizes are of one band or of neighbouring ones. In each band n-grams are dealt, by
   hash, into over D classes, so a linked pair has classes that hold the same n-grams; a signature stands
   for the n-grams of a class. Of each set the D + 1 signatures that fewest sets have are kept: the rarest
   one that a pair shares is among them. Sets with one signature are joined to the least of them, never
   all pairs. A signature is of several n-grams together: unlike single n-grams, it hardly becomes common
   as the table grows, and passages that many texts hold are left out, so that groups of unrelated
   documents do not grow together.
3. Each group is searched in one task by DivideSkip (see `linked`). A group of more than
   `group_ngrams` n-grams is dealt into blocks, and each pair of blocks is searched; in rounds, so that
   the texts copied for the pairs of a round are about as many as the table has.
4. What leaves a task is a row for each document: its number of links and one link towards the
   smallest document it is joined to. Components of these are the classes.

Staged rows and shuffle files are released when the next step has its own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cache, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifflume.llm.common import Words, mixed, ngram_hashes, released, ship, slices, staged
from tarifflume.llm.components import components

#: Weight of binary search against merging in the choice of the number of long lists.
PROBE_WEIGHT = 0.0085
#: Classes besides those that the differences of a pair can spoil, as a part of these.
SPARE = 0.3
_OF_CLASS, _OF_BAND, _EMPTY = (np.uint64(k) for k in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xD6E8FEB86659FD93))


def ngram_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words has all of them as one."""
    words = Words(data, bounds, lower=True)
    hashes, first = words.hashes(), words.first
    grams, out = ngram_hashes(hashes, n), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(ngram_hashes(hashes[a:b], b - a) ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


@cache
def size_bands(percent: int) -> np.ndarray:
    """The least size of each band: sizes that can link are of one band or of neighbours."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, 100 * (out[-1] - 1) // percent + 1) if percent < 100 else out[-1] << 25)
    return np.array([*out[::3], out[-1] + 1, out[-1] + 2])


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set, step, signature, and how many of the signatures of this set and step may be left out.

    A pair is looked for in the band of its larger size, so a set has signatures of its own band (step 0)
    and, where it may be the smaller, of the next (1). There it has `classes` classes and differs from what
    it links with in `differ` n-grams at most, so classes - differ of its classes are the other's too. If both
    leave out all but the last differ + 1 of theirs, in one order of all signatures, the last shared one stays.
    Empty classes are the first to go.
    """
    bands, sizes = size_bands(percent), np.array([len(s) for s in sets], np.int64)
    grams = np.concatenate([np.zeros(0, np.uint64), *sets])
    values, owner = mixed(grams ^ _OF_CLASS), np.repeat(np.arange(len(sets)), sizes)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for step in (0, 1):
        band = np.searchsorted(bands, sizes, "right") - 1 + step
        largest = np.minimum(bands[band + 1] - 1, 100 * sizes // percent)
        here = (sizes > 0) & (largest >= bands[band])
        differ = (100 - percent) * (sizes + largest) // (100 + percent)
        most = (100 - percent) * 2 * (bands[band + 1] - 1) // (100 + percent)
        classes = most + 1 + np.ceil(SPARE * most).astype(np.int64)
        mine = np.flatnonzero(here[owner])
        if not len(mine):
            continue
        # n-grams ascend, so those of a class stand together
        of, place = owner[mine], ((grams[mine] >> np.uint64(32)) * classes[owner[mine]].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        new = np.ones(len(mine), bool)
        new[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1])
        begin = np.flatnonzero(new)
        of, place = of[begin], place[begin]
        salt = mixed(band.astype(np.uint64) + _OF_BAND)
        spare = np.bincount(of, minlength=len(sets)) - differ - 1
        out.append((of, np.full(len(of), step), mixed(np.add.reduceat(values[mine], begin) ^ salt[of]), np.maximum(spare, 0)[of]))
        for k in np.flatnonzero(here & (spare < 0)):  # of a few small sets the empty classes count too
            empty = np.setdiff1d(np.arange(classes[k]), place[of == k])
            out.append((np.full(len(empty), k), np.full(len(empty), step), mixed(mixed(empty.astype(np.uint64) + _EMPTY) ^ salt[k]), np.zeros(len(empty), np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def linked(sets: list[np.ndarray], percent: int, side: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(x, all smaller or equal sized y before it that it links with), sets given by ascending size.

    DivideSkip: of x's inverted lists the L longest are set aside; the others are merged by a heap,
    which gives the sets that are in T - L of them; these are looked up in the long lists by binary
    search, and dropped as soon as they cannot reach T. With `side`, only pairs of two sides count.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    end = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")  # by n-gram, then set
    lists = owner[order]
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    begin = np.searchsorted(token[order], np.arange(len(order) and token.max() + 1))
    sides = None if side is None else np.array(side)
    for x in range(len(sets)):
        own = slice(end[x] - sizes[x], end[x])
        stop = place[own]  # of each list, what comes before x
        start = begin[token[own]]
        lengths = stop - start
        need = int(-(-percent * sizes[x] // 100))
        if np.count_nonzero(lengths) < need:
            continue
        low = int(np.searchsorted(sizes, need))  # smaller sets can't share so many
        by_length = np.argsort(lengths, kind="stable")
        n_long = min(need - 1, int(need / (PROBE_WEIGHT * math.log2(max(2, lengths.max())) + 1)))
        short, long = by_length[: len(lengths) - n_long], by_length[len(lengths) - n_long :]
        merged = heapq.merge(*(lists[start[k] : stop[k]].tolist() for k in short if lengths[k]))
        found = [(y, sum(1 for _ in run)) for y, run in groupby(merged) if y >= low]
        found = [f for f in found if f[1] >= need - n_long]
        if not found:
            continue
        candidates, shared = np.array(found, np.int64).T
        for left, k in zip(range(n_long, 0, -1), long, strict=True):
            alive = shared + left >= need
            if not alive.all():
                candidates, shared = candidates[alive], shared[alive]
                if not len(candidates):
                    break
            at = lists[start[k] : stop[k]]
            hit = np.searchsorted(at, candidates)
            shared = shared + ((hit < len(at)) & (at[np.minimum(hit, len(at) - 1)] == candidates))
        good = 100 * shared >= percent * (sizes[x] + sizes[candidates] - shared)
        if sides is not None:
            good &= sides[candidates] != sides[x]
        if good.any():
            yield x, candidates[good]


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _set_hash(own: np.ndarray) -> int:
    return int(mixed(own).sum().view(np.int64)) if len(own) else 0


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, size, hashes of the set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def build(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for a, _, data, bounds in slices(batch.column(1)):
                for i, own in enumerate(ngram_sets(data, bounds, n)):
                    rows.append((ids[a + i], len(own), _set_hash(own), _set_hash(own ^ np.uint64(0x5851F42D4C957F2D))))
            yield _rows(rows, schema)

    return docs.mapInArrow(build, "doc_id long, n_shingles long, h1 long, h2 long")


def _signature_rows(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """sign, set (h1 with the step as its last bit) and spare, the signatures of it that may be left out; equal sets of one task once."""

    def build(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, bounds in slices(batch.column(0)):
                sets, hashes = [], []
                for own in ngram_sets(data, bounds, n):
                    h1 = _set_hash(own)
                    if len(own) and h1 not in seen:
                        seen.add(h1)
                        sets.append(own)
                        hashes.append(h1)
                of, step, sign, spare = signatures(sets, percent)
                columns = [pa.array(sign.view(np.int64)), pa.array(np.array(hashes, np.int64)[of] & -2 | step), pa.array(spare.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["sign", "set", "spare"])

    return texts.mapInArrow(build, "sign long, set long, spare int")


def _candidates(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """x, y: h1, but for the last bit, of sets; who shares a kept signature is joined over some of these."""
    of_sign = Window.partitionBy("sign")
    rows = _signature_rows(texts, n, percent)
    counted = rows.withColumns({"n": F.count("*").over(of_sign), "low": F.min("set").over(of_sign), "high": F.max("set").over(of_sign)})
    shared = staged(counted.where("low < high").select("sign", "set", "spare", "n"), "shared")
    released(texts.sparkSession)
    # the commonest are left out; those that no other set has are rarer than all of these
    place = F.dense_rank().over(Window.partitionBy("set").orderBy(F.desc("n"), "sign"))
    kept = shared.withColumn("place", place).where("place > spare")
    heads = kept.select(F.col("set").bitwiseAND(-2).alias("x"), F.min("set").over(of_sign).bitwiseAND(-2).alias("head")).where("x <> head").distinct()
    # a set goes to the least of its heads, and so do the others of these, of which there are far fewer
    least = heads.withColumn("y", F.min("head").over(Window.partitionBy("x")))
    ends = F.explode(F.array("x", "head")).alias("x")
    found = staged(least.select(ends, "y").where("x <> y").distinct(), "candidates")
    released(texts.sparkSession, shared)
    return found


def _search(groups: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_links, root for the documents of each group that link within it."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_links", pa.int64()), ("root", pa.int64())])

    def solve(rows):
        text = pa.array([r[3] for r in rows], pa.large_string())
        sets = [s for _, _, data, bounds in slices(text) for s in ngram_sets(data, bounds, n)]
        order = sorted(range(len(rows)), key=lambda k: (len(sets[k]), rows[k][1]))
        rows, sets = [rows[k] for k in order], [sets[k] for k in order]
        across = rows[0][0][1] != rows[0][0][2]
        parent, n_links = list(range(len(rows))), [0] * len(rows)

        def root(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for x, ys in linked(sets, percent, [r[4] for r in rows] if across else None):
            for y in ys.tolist():
                n_links[x] += rows[y][2]
                n_links[y] += rows[x][2]
                a, b = root(x), root(y)
                if a != b:
                    a, b = (a, b) if rows[a][1] <= rows[b][1] else (b, a)
                    parent[b] = a
        return [(r[1], k, rows[root(i)][1]) for i, (r, k) in enumerate(zip(rows, n_links, strict=True)) if k]

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            out = []
            names = ("cluster", "low", "high", "doc_id", "copies", "text", "block")
            for cluster, low, high, doc_id, copies, text, block in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                key = (cluster, low, high)
                if group and group[0][0] != key:
                    out += solve(group)
                    group = []
                group.append((key, doc_id, copies, text, block))
            yield _rows(out, schema)
        if group:
            yield _rows(solve(group), schema)

    keys = ["cluster", "low", "high"]
    # many small tasks, so that large groups spread; Spark would join tasks of so few bytes
    tasks = 4 * int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(run, "doc_id long, n_links long, root long")


def _links(texts: DataFrame, rounds: int, n: int, percent: int) -> DataFrame:
    """The links of all groups, staged; the pairs of blocks are dealt over `rounds`, of which each releases its files."""
    spark = texts.sparkSession
    texts = staged(texts, "texts") if rounds > 1 else texts
    pairs = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("low"), F.greatest(k, "block").alias("high")))
    copied = texts.withColumn("pair", F.explode(pairs)).select("cluster", "pair.low", "pair.high", "doc_id", "copies", "text", "block")
    turn, parts = F.pmod(F.xxhash64("cluster", "low", "high"), F.lit(rounds)), []
    for k in range(rounds):
        parts.append(staged(_search(copied.where(turn == k) if rounds > 1 else copied, n, percent), "links"))
        released(spark)
    if rounds > 1:
        released(spark, texts)
    return reduce(DataFrame.unionByName, parts)


def similar(docs: DataFrame, n: int = 3, percent: int = 90, group_ngrams: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links for each row of `docs`.

    Words are runs of other than ASCII white space, A-Z in lower case; a document's set is its
    distinct n-word shingles, or all its words where it has fewer. Links join sets with 100 *
    shared >= percent * union; equal sets link, sets without words (null texts) link with nothing.
    n_links counts linked documents (by representative sets, times their copies). Rows of one
    doc_id are one document in all links; rows with null doc_id link with nothing and have a null
    component_id; an empty table gives no rows. N-grams are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = staged(_sets(rows, n), "sets")
    real = sets.where("doc_id is not null and n_shingles > 0")
    classes = staged(real.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    there = rows.where("doc_id is not null and text is not null")
    found = _candidates(there.select("text"), n, percent)
    hashed = classes.select(F.col("h1").bitwiseAND(-2).alias("h"), "rep")
    edges = found.join(hashed.select(F.col("h").alias("x"), F.col("rep").alias("a")), "x").join(hashed.select(F.col("h").alias("y"), F.col("rep").alias("b")), "y")
    # all texts of a doc_id are searched wherever one of them is
    several = real.groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("doc_id")
    own = real.join(several, "doc_id").join(classes, ["n_shingles", "h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    clusters = components(edges.select("a", "b").union(own))

    sized = clusters.select(F.col("node").alias("doc_id"), F.col("label").alias("cluster")).join(classes.select(F.col("rep").alias("doc_id"), "n_shingles", "copies"), "doc_id")
    blocks = sized.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / group_ngrams).cast("int").alias("n_blocks"))
    dealt = staged(sized.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int")), "dealt")
    released(spark, found)
    copied = dealt.agg(F.sum(F.col("n_shingles") * F.col("n_blocks"))).first()[0] or 0
    rounds = max(1, math.ceil(copied / max(1, classes.agg(F.sum("n_shingles")).first()[0] or 0)))
    links = _links(there.join(dealt.select("doc_id", "cluster", "block", "n_blocks", "copies"), "doc_id"), rounds, n, percent)

    labels = components(links.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("n_links").alias("n_links"))
    known = classes.select("n_shingles", "h1", "h2", "rep", "copies").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").join(counts, "rep", "left")
    known = known.select("n_shingles", "h1", "h2", F.coalesce("label", "rep").alias("label"), (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    joined = sets.join(known, ["n_shingles", "h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))


def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80, **settings) -> DataFrame:
    """The rows of `docs` but for those that link, over any number of links, with a smaller doc_id's."""
    found = similar(docs, n, percent, **settings)
    later = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti")
