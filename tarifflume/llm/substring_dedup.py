"""Removal of word sequences that an earlier document holds too.

No suffix tree is built: windows of exactly `length` words are compared, grouped by a minimizer.

1. Anchors. Every window has one anchor: the run of `prefix` words in it with the
   least hash. Equal windows have equal anchors at equal places, and neighbouring windows mostly
   share theirs, so a text has an anchor for some five words only. Windows whose anchor occurs
   nowhere else are unique.
2. Spans. Around each anchor that occurs again, the words of its windows; equal spans become one
   with the smallest doc_id, before and after the shuffle, so copies and common passages, however
   frequent, are one leaf each.
3. Groups. Spans of one anchor are a group; its windows are sorted, and equal ones get the smallest
   doc_id. The spans of an anchor with more than `group_spans` go to one plain aggregation by window.
4. Windows of two documents or more go back to the places of their spans: a join that Spark may
   split where a span is frequent.

Each step writes its rows to the shared folder; the shuffle files behind it are then released.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifflume.llm.common import ngram_hashes, released, ship, staged, word_slices

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prefix_words(length: int) -> int:
    return max(1, (length - 3) // 2)


def anchors(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: text, first window, number of windows, hash of the anchor's words."""
    prefix = prefix_words(length)
    grams = ngram_hashes(hashes, prefix)
    n = len(hashes) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    least, place = grams[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, length - prefix + 1):
        better = grams[k : k + n] < least
        least[better] = grams[k : k + n][better]
        place[better] = k
    counts = np.diff(first)
    each = np.maximum(counts - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), each)
    start = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    at = start + first[:-1][text]
    anchor = at + place[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    return text[begin], start[begin], np.diff(np.append(begin, len(at))), grams[anchor[begin]]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a doc_id; `version` keeps texts of one doc_id apart."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("version"), "text")


def _anchor_rows(docs: DataFrame, length: int, places: bool) -> DataFrame:
    def find(batches):
        for batch in batches:
            for a, b, words in word_slices(batch.column("text")):
                text, start, n, key = anchors(words.hashes(), words.first, length)
                columns, names = [pa.array(key.view(np.int64))], ["key"]
                if places:
                    rows = pa.array(text + a)
                    columns += [batch.column("doc_id").take(rows), batch.column("version").take(rows), pa.array(start << 16 | n)]
                    names += ["doc_id", "version", "run"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(find, "key long" + ", doc_id long, version int, run long" * places)


def _spans(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """key, run, doc_id, version and the words of the span for each run."""

    def build(batches):
        for batch in batches:
            rows = []
            for doc_id, version, text, own, keys in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text", "runs", "keys")), strict=True):
                words = _WORD.findall(text)
                for run, key in zip(own, keys, strict=True):
                    start = run >> 16
                    rows.append((key, run, doc_id, version, " ".join(words[start : start + (run & 65535) - 1 + length])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "run", "doc_id", "version", "span"])

    # a set, so that equal rows of one doc_id count once
    per_doc = runs.groupBy("doc_id", "version").agg(F.collect_set(F.struct("run", "key")).alias("r")).select("doc_id", "version", F.col("r.run").alias("runs"), F.col("r.key").alias("keys"))
    rows = docs.join(per_doc, ["doc_id", "version"]).mapInArrow(build, "key long, run long, doc_id long, version int, span string")
    return rows.withColumns({"h1": F.xxhash64("span"), "h2": F.xxhash64(F.lit(1), "span")})


def equal_windows(spans: list[list[str]], length: int) -> list[list[tuple[int, int]]]:
    """For each distinct window of `length` words, the (span, window) places that hold it."""
    windows = sorted((words[i : i + length], j, i) for j, words in enumerate(spans) for i in range(len(words) - length + 1))
    places: list[list[tuple[int, int]]] = []
    last: list[str] | None = None
    for words, j, i in windows:
        if words != last:
            places.append([])
        places[-1].append((j, i))
        last = words
    return places


def _grouped(spans: DataFrame, length: int) -> DataFrame:
    """h1, h2, firsts (smallest doc_id of each window) of the spans of each key, one group at a time."""

    def solve(group):
        firsts = [[r[4]] * (len(r[3]) - length + 1) for r in group]
        for node in equal_windows([r[3] for r in group], length):
            if len(node) > 1:
                low = min(group[j][4] for j, _ in node)
                for j, i in node:
                    firsts[j][i] = low
        return [(r[1], r[2], f) for r, f in zip(group, firsts, strict=True)]

    def build(batches):
        group, out = [], []

        def rows():
            columns = list(zip(*out, strict=True)) or [[]] * 3
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["h1", "h2", "firsts"])

        for batch in batches:
            for key, h1, h2, span, low in zip(*(batch.column(c).to_pylist() for c in ("key", "h1", "h2", "span", "low")), strict=True):
                if group and group[0][0] != key:
                    out += solve(group)
                    group = []
                if group and group[-1][1:3] == (h1, h2):
                    continue  # a repeated row of the document that the span is taken from
                group.append((key, h1, h2, span.split(" "), low))
            yield rows()
            out = []
        if group:
            out += solve(group)
            yield rows()

    columns = spans.select("key", "h1", "h2", "span", "low")
    return columns.repartition("key").sortWithinPartitions("key", "h1", "h2").mapInArrow(build, "h1 long, h2 long, firsts array<long>")


def _by_window(spans: DataFrame, length: int) -> DataFrame:
    """The same for the spans of overfull keys: each window is a group of its own."""
    words = F.split("span", " ")
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (length - 1)), lambda i: F.array_join(F.slice(words, i, length), " "))
    each = spans.select("h1", "h2", "low", F.posexplode(windows).alias("i", "window"))
    first = each.groupBy("window").agg(F.min("low").alias("first"))
    back = each.join(first, "window").groupBy("h1", "h2").agg(F.array_sort(F.collect_set(F.struct("i", "first"))).alias("w"))
    return back.select("h1", "h2", F.col("w.first").alias("firsts"))


def repeated_windows(docs: DataFrame, length: int, group_spans: int = 20_000) -> DataFrame:
    """doc_id, version, starts: the windows of each text that also start in a smaller doc_id's text."""
    spark = docs.sparkSession
    ship(spark)
    keyed = _keyed(docs)
    texts = keyed.where("text is not null")
    shared = staged(_anchor_rows(texts, length, False).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "anchors")
    released(spark)
    runs = staged(_anchor_rows(texts, length, True).join(shared, "key", "left_semi"), "runs")
    released(spark, shared)
    spans = staged(_spans(texts, runs, length).drop("span"), "spans")
    released(spark, runs)
    place = F.min(F.struct("doc_id", "version", "run")).alias("place")
    distinct = staged(spans.groupBy("key", "h1", "h2").agg(place, F.max("doc_id").alias("high")), "leaves")
    released(spark)
    groups = distinct.groupBy("key").agg(F.count("*").alias("n"), F.min("place.doc_id").alias("from"), F.max("high").alias("to")).where("from < to")
    leaves = staged(distinct.join(groups.select("key", "n"), "key").select("key", "n", "h1", "h2", "place.*"), "leaves")
    released(spark, distinct)
    alone = leaves.where("n = 1").select("h1", "h2", F.array_repeat("doc_id", F.col("run").bitwiseAND(65535).cast("int")).alias("firsts"))
    # words only of leaves that are not alone, from the first document of each
    worded = lambda which: _spans(texts, leaves.where(which).select("doc_id", "version", "run", "key"), length).withColumn("low", F.col("doc_id"))
    some = _grouped(worded(f"n between 2 and {group_spans}"), length)
    many = _by_window(worded(f"n > {group_spans}"), length)
    firsts = staged(alone.unionByName(some).unionByName(many), "nodes")
    released(spark, leaves)
    start = F.shiftright("run", 16)
    starts = F.filter(F.transform("firsts", lambda low, i: F.when(low < F.col("doc_id"), start + i)), lambda s: s.isNotNull())
    hits = spans.select("h1", "h2", "doc_id", "version", "run").join(firsts, ["h1", "h2"]).select("doc_id", "version", starts.alias("own")).where(F.size("own") > 0)
    return hits.groupBy("doc_id", "version").agg(F.flatten(F.collect_set("own")).alias("starts"))


def _gone(n_words: int, starts, length: int) -> np.ndarray:
    depth = np.zeros(n_words + 1, np.int64)
    for s in starts or ():
        depth[s] += 1
        depth[s + length] -= 1
    return np.cumsum(depth)[:-1] > 0


def remove_repeats(docs: DataFrame, length: int = 13, keep_text: bool = True, group_spans: int = 20_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept text, removed word spans) for each row of `docs`.

    A word goes when a window of `length` words that covers it also starts in a document with a
    smaller doc_id; windows are those of the input. Words are runs of other than ASCII white space;
    kept words are joined by one space. A null text has no words. Rows of one doc_id don't remove
    each other's words, and equal ones cost their number and no more; rows with null doc_id keep all theirs and remove none; an empty table
    gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("version"), "text")
    found = repeated_windows(docs, length, group_spans)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string(), pa.list_(pa.list_(pa.int64()))] * keep_text]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["text", "removed"] * keep_text]

    def apply(batches):
        for batch in batches:
            out = []
            for doc_id, text, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts")), strict=True):
                words = _WORD.findall(text or "")
                gone = _gone(len(words), starts, length)
                if gone.any():
                    kept = " ".join([words[i] for i in np.flatnonzero(~gone)])
                else:
                    kept = " ".join(words)
                row = [doc_id, len(words), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()]
                if keep_text:
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                    row += [kept if gone.any() else text, edges.reshape(-1, 2).tolist()]
                out.append(row)
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string, removed array<array<long>>" * keep_text
    return rows.join(found, ["doc_id", "version"], "left").mapInArrow(apply, schema)


def without_repeats(docs: DataFrame, length: int = 50, group_spans: int = 20_000) -> DataFrame:
    """The rows of `docs`, all columns, without the words that `remove_repeats` removes.

    A text that loses words has the kept ones joined by one space; any other stays as it is.
    `n_chars`, where there is one, follows the text. Rows stay, also when no word is left.
    """
    found = repeated_windows(docs, length, group_spans).select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("starts").alias("__starts"))
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.hash("text") == F.col("__version"))
    joined = docs.join(found, same, "left").drop("__id", "__version")
    names = docs.columns

    def apply(batches):
        for batch in batches:
            columns = {c: batch.column(c) for c in names}
            texts, starts = columns["text"].to_pylist(), batch.column("__starts").to_pylist()
            sizes = columns["n_chars"].to_pylist() if "n_chars" in columns else None
            for k, own in enumerate(starts):
                if own:
                    words = _WORD.findall(texts[k])
                    texts[k] = " ".join([words[i] for i in np.flatnonzero(~_gone(len(words), own, length))])
                    if sizes is not None:
                        sizes[k] = len(texts[k])
            columns["text"] = pa.array(texts, columns["text"].type)
            if sizes is not None:
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return joined.mapInArrow(apply, docs.schema)
