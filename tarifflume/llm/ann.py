"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

Nodes are distinct vectors (scaled to length one, single precision); equal vectors are one node
with its smallest ids, since no query can need more of them. The graph starts from sorted
random-projection codes: neighbours within short runs of a few orders. Each round of NN-descent
introduces a node's neighbours, and those that have it as a neighbour, to each other: vectors
travel once to each such owner, all pairs of an owner are scored there in one matrix product, and
the best new pairs of each member (a quarter of `width`) come back. A node goes to `width` owners
a round at most, so no hub gathers more. The graph is a heuristic in these and in its number of
rounds; the search makes up for it, and the recall is tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifflume.llm.common import released, ship, staged

#: Vectors compared with each other at the start.
RUN = 256


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _lists(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _groups(batches: Iterator[pa.RecordBatch], solve: Callable, schema: pa.Schema, most: int = 1 << 60) -> Iterator[pa.RecordBatch]:
    """Runs `solve` on the rows (as one table) of each value of the first column, in runs of `most` at most."""
    rest: pa.Table | None = None

    def cut(table: pa.Table, last: bool):
        keys = table.column(0).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            while b - a >= most or (b > a and (b < len(keys) or last)):
                out += solve(table.slice(a, min(most, b - a)).combine_chunks())
                a += min(most, b - a)
            if b == len(keys) and not last:
                return out, table.slice(a)
        return out, None

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None and len(rest):
            table = pa.concat_tables([rest, table])
        if len(table):
            out, rest = cut(table, False)
            yield _lists(out, schema)
    if rest is not None and len(rest):
        yield _lists(cut(rest, True)[0], schema)


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """vec_id and vec (doubles): no null, non-finite or zero vectors, no null ids, of the most frequent length."""
    good = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vec"))
    fine = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    good = good.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).where(fine)
    sizes = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("vec") == (sizes[0]["n"] if sizes else 0))


def _merge(own_ids: np.ndarray, own_scores: np.ndarray, ids: np.ndarray, scores: np.ndarray, node: int, width: int):
    """The best `width` of both lists, and which of them are new."""
    all_ids, all_scores = np.concatenate((own_ids, ids)), np.concatenate((own_scores, scores))
    fresh = np.concatenate((np.zeros(len(own_ids), bool), np.ones(len(ids), bool)))
    _, first = np.unique(all_ids, return_index=True)  # an old entry comes before its repetition
    first = first[all_ids[first] != node]
    first = first[np.lexsort((all_ids[first], -all_scores[first]))][:width]
    return all_ids[first], all_scores[first], fresh[first]


GRAPH = pa.schema([("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32())), ("fresh", pa.list_(pa.bool_())), ("changed", pa.int32())])
FOUND = pa.schema([("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32()))])
_GRAPH = "node long, ids array<long>, scores array<float>, fresh array<boolean>, changed int"
_FOUND = "node long, ids array<long>, scores array<float>"


def _updated(graph: DataFrame | None, found: DataFrame, width: int) -> DataFrame:
    """The graph with what was found; entries that were not there before are fresh."""
    lists = found.groupBy("node").agg(F.flatten(F.collect_list("ids")).alias("more"), F.flatten(F.collect_list("scores")).alias("more_scores"))
    if graph is None:
        empty = [F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("scores"), F.array().cast("array<boolean>").alias("fresh")]
        joined = lists.select("node", *empty, "more", "more_scores")
    else:
        joined = graph.join(lists, "node", "left").select("node", "ids", "scores", "fresh", "more", "more_scores")

    def merge(batches):
        for batch in batches:
            rows = []
            for node, ids, scores, fresh, more, more_scores in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not more:
                    rows.append((node, ids, scores, [False] * len(ids), 0))
                    continue
                ids, scores, new = _merge(np.array(ids, np.int64), np.array(scores, np.float32), np.array(more, np.int64), np.array(more_scores, np.float32), node, width)
                rows.append((node, ids, scores, new, int(new.sum())))
            yield _lists(rows, GRAPH)

    return joined.mapInArrow(merge, _GRAPH)


def _start(nodes: DataFrame, trees: int, width: int) -> DataFrame:
    """Neighbours within runs of the nodes, sorted by `trees` random-projection codes."""

    def code(batches):
        for batch in batches:
            vec = _vectors(batch.column(1))
            for t in range(trees):
                planes = np.random.Generator(np.random.PCG64(1000 + t)).standard_normal((vec.shape[1], 16)).astype(np.float32)
                codes = ((vec @ planes) > 0) @ (1 << np.arange(16)[::-1])
                tree = pa.array(np.full(len(vec), t, np.int32))
                yield pa.RecordBatch.from_arrays([tree, pa.array(codes.astype(np.int64)), *batch.columns], ["tree", "code", "node", "vec"])

    def solve(table: pa.Table):
        ids, vec = table.column("node").to_numpy(), _vectors(table.column("vec").combine_chunks())
        scores = vec @ vec.T
        np.fill_diagonal(scores, -2)
        k = min(width, len(ids) - 1)
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), int)
        return [(int(i), ids[b], scores[r, b]) for r, (i, b) in enumerate(zip(ids, best, strict=True))]

    coded = nodes.mapInArrow(code, "tree int, code long, node long, vec array<float>")
    runs = coded.repartitionByRange("tree", "code", "node").sortWithinPartitions("tree", "code", "node").select("tree", "node", "vec")
    return runs.mapInArrow(lambda batches: _groups(batches, solve, FOUND, RUN), _FOUND)


def _introduced(graph: DataFrame, nodes: DataFrame, width: int, best: int) -> DataFrame:
    """For pairs of nodes that share an owner, one of them fresh there: scores that better a list."""
    forward = graph.select(F.col("node").alias("owner"), F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("owner", F.col("e.ids").alias("member"), F.col("e.fresh").alias("fresh"))
    # of those that have a node as a neighbour, fresh ones first, `width` at most
    turn = F.row_number().over(Window.partitionBy("member").orderBy(F.desc("fresh"), F.xxhash64("owner", "member")))
    edges = forward.withColumn("turn", turn).where(F.col("turn") <= width).select("owner", "member", "fresh")
    both = edges.union(edges.select(F.col("member").alias("owner"), F.col("owner").alias("member"), "fresh"))
    worst = F.when(F.size("scores") >= width, F.element_at("scores", -1)).otherwise(F.lit(-2.0).cast("float"))
    members = nodes.join(graph.select("node", worst.alias("worst")), "node").select(F.col("node").alias("member"), "vec", "worst")
    sent = both.join(members, "member").select("owner", "member", "fresh", "worst", "vec")

    def solve(table: pa.Table):
        fresh = table.column("fresh").to_numpy()
        if not fresh.any() or len(fresh) < 2:
            return []
        ids, worst = table.column("member").to_numpy(), table.column("worst").to_numpy()
        vec = _vectors(table.column("vec").combine_chunks())
        scores = vec @ vec.T
        open_pairs = (fresh[:, None] | fresh[None, :]) & (scores > worst[:, None]) & (ids[:, None] != ids[None, :])
        scores = np.where(open_pairs, scores, -3)
        k = min(best, len(ids))
        top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        out = []
        for r, row in enumerate(top):
            row = row[scores[r, row] > -3]
            if len(row):
                out.append((int(ids[r]), ids[row], scores[r, row]))
        return out

    return sent.repartition("owner").sortWithinPartitions("owner").mapInArrow(lambda batches: _groups(batches, solve, FOUND), _FOUND)


class Index:
    """nodes (node, unit vector), members (node, vec_id: its smallest ids) and the neighbour graph."""

    def __init__(self, nodes: DataFrame, members: DataFrame, vectors: DataFrame, graph: DataFrame):
        self.nodes, self.members, self.vectors, self.graph = nodes, members, vectors, graph


def build(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", width: int = 32, trees: int = 8, rounds: int = 6, settled: float = 0.01, members: int = 6) -> Index:
    """NN-descent over all usable rows, until less than `settled` of all list entries change or `rounds` are done.

    `members`: ids kept for each distinct vector (the smallest); it must exceed the neighbours that
    are asked for. Repeated ids of one vector count once. Rows that take no part: see `usable`.
    """
    spark = vectors.sparkSession
    ship(spark)
    good = staged(usable(vectors, id_column, column).distinct(), "vectors")
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    kept = good.withColumn("rank", rank).where(F.col("rank") <= members)
    # squares of the components over the largest one neither overflow nor vanish
    scaled = F.transform("vec", lambda x: x / F.col("largest"))
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform("scaled", lambda x: (x / F.col("norm")).cast("float"))
    grouped = staged(kept.groupBy("vec").agg(F.min("vec_id").alias("node"), F.collect_list("vec_id").alias("ids")), "distinct")
    # rows of one id and several vectors: the id stands for each of them
    largest = F.array_max(F.transform("vec", F.abs))
    units = grouped.withColumn("largest", largest).withColumn("scaled", scaled).withColumn("norm", norm)
    nodes = staged(units.groupBy("node").agg(F.first(unit).alias("vec")), "nodes")
    of = grouped.select("node", F.explode("ids").alias("vec_id")).distinct()
    n = nodes.count()
    graph = staged(_updated(None, _start(nodes, trees, width), width), "graph")
    for _ in range(rounds):
        if n <= RUN:  # one run has compared all
            break
        graph = staged(_updated(graph, _introduced(graph, nodes, width, max(4, width // 4)), width), "graph")
        released(spark)
        if graph.agg(F.sum("changed")).first()[0] <= settled * n * width:
            break
    return Index(nodes, staged(of, "members"), good, graph)


STATE = pa.schema([("query", pa.int64()), ("vec", pa.list_(pa.float32())), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32())), ("expanded", pa.list_(pa.bool_())), ("seen", pa.list_(pa.int64())), ("next", pa.list_(pa.int64()))])
_STATE = "query long, vec array<float>, ids array<long>, scores array<float>, expanded array<boolean>, seen array<long>, next array<long>"


def greedy_search(index: Index, queries: DataFrame, beam: int = 192, step: int = 48) -> DataFrame:
    """query, ids: the best nodes met from each (query, vec, entry: nodes to begin at).

    Best first: each round opens the `step` best unopened nodes of a query's `beam` best, scores
    their neighbours not seen before, and ends for a query whose beam is all opened.
    """
    graph, nodes = index.graph.select(F.col("node").alias("c"), "ids"), index.nodes.select(F.col("node").alias("c"), F.col("vec").alias("cvec"))

    def advance(batches):
        for batch in batches:
            rows = []
            cids, cvecs = batch.column("cids"), batch.column("cvecs")
            columns = [batch.column(c).to_pylist() for c in ("query", "vec", "ids", "scores", "expanded", "seen")]
            for r, (query, vec, ids, scores, opened, seen) in enumerate(zip(*columns, strict=True)):
                ids, scores, opened = np.array(ids, np.int64), np.array(scores, np.float32), np.array(opened, bool)
                if cids[r].is_valid and len(cids[r]):
                    more = cids[r].values.to_numpy()
                    matrix = _vectors(cvecs[r].values)
                    ids, scores = np.concatenate((ids, more)), np.concatenate((scores, matrix @ np.array(vec, np.float32)))
                    opened = np.concatenate((opened, np.zeros(len(more), bool)))
                    best = np.lexsort((ids, -scores))[:beam]
                    ids, scores, opened = ids[best], scores[best], opened[best]
                    seen = np.concatenate((np.array(seen, np.int64), more))
                todo = np.flatnonzero(~opened)[:step]
                opened[todo] = True
                rows.append((query, vec, ids, scores, opened, seen, ids[todo]))
            yield _lists(rows, STATE)

    def grown(state: DataFrame, fresh: DataFrame) -> DataFrame:
        """State with the vectors of its new candidates."""
        near = fresh.join(nodes, "c").groupBy("query").agg(F.collect_list("c").alias("cids"), F.collect_list("cvec").alias("cvecs"))
        return state.drop("next").join(near, "query", "left").mapInArrow(advance, _STATE)

    empty = [F.array().cast(t).alias(c) for c, t in (("ids", "array<long>"), ("scores", "array<float>"), ("expanded", "array<boolean>"), ("seen", "array<long>"), ("next", "array<long>"))]
    state = queries.select("query", "vec", *empty)
    state = staged(grown(state, queries.select("query", F.explode(F.array_distinct("entry")).alias("c"))), "search")
    done = []
    while True:
        done.append(state.where(F.size("next") == 0).select("query", "ids"))
        state = state.where(F.size("next") > 0)
        if state.isEmpty():
            break
        opened = state.select("query", F.explode("next").alias("c")).join(graph, "c")
        around = opened.groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("near"))
        fresh = state.join(around, "query").select("query", F.explode(F.array_except("near", "seen")).alias("c"))
        state = staged(grown(state, fresh), "search")
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors over the power of two of their largest component: the same cosines, to the bit, without overflow."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, initial=0))[1][:, None])


def nearest(index: Index, which, k: int = 5, beam: int = 192, step: int = 48) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each indexed row that `which` (a condition on vec_id) picks.

    Score: cosine of the original vectors in double precision. Searches begin at the row's own
    node and its neighbours; the row itself is no candidate, its copies are. Ties go to the
    smaller vec_id. Rows that take no part in the index have no result.
    """
    own = index.vectors.where(which).select(F.col("vec_id").alias("query"), "vec")
    of = index.vectors.join(own.select(F.col("query"), F.col("vec")), "vec").groupBy("query").agg(F.min("vec_id").alias("node"))
    start = of.join(index.nodes, "node").join(index.graph.select("node", "ids"), "node", "left")
    begin = F.concat(F.array("node"), F.coalesce("ids", F.array().cast("array<long>")))
    met = greedy_search(index, start.select("query", "vec", begin.alias("entry")), max(beam, 2 * k), step)
    pairs = met.select("query", F.explode(F.slice("ids", 1, 4 * k)).alias("node")).join(index.members, "node").where("vec_id <> query")
    wanted = pairs.select("query", "vec_id").distinct()
    scored = wanted.join(index.vectors.withColumnRenamed("vec", "b"), "vec_id").join(own.withColumnRenamed("vec", "a"), "query")

    def exact(batches):
        for batch in batches:
            a, b = _scaled(_vectors(batch.column("a"))), _scaled(_vectors(batch.column("b")))
            dots = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("vec_id"), pa.array(dots)], ["query_id", "vec_id", "score"])

    found = scored.mapInArrow(exact, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
