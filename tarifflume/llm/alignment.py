"""Alignment of two tokenizers: groups of tokens that end together, as fragments that compose.

A fragment is what is known of the tokens of a byte range: those before the first place where a
token of A and one of B end together (open prefix), the groups between such places (closed) and
those after the last (open suffix). Fragments compose: the open suffix of one and the open prefix
of the next make one group; where a fragment has no common end, all of it is open. Composing is
associative, so ranges of one document can be worked on in different tasks and reduced as a tree.
Only open ends travel through the tree; closed groups stay with their range, and groups that a
composition closes are rows of their own beside them.

Texts are cut into ranges before single spaces that follow a printable ASCII character: no token of
A crosses such a place (its pre-tokens end there) and none of B, if no piece of its vocabulary has a
space behind another character. Where a vocabulary isn't of this kind, texts are not cut.

How often a pair of ids is linked is counted by blocks of ranges first, so frequent pairs are one
row a block; each block then gets the counts of its own pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarifflume.llm.common import ship, staged
from tarifflume.llm.vocabulary import _byte_letters, _pairs, prove

#: Open ends that one step of the tree composes.
FAN = 32
#: How byte-level vocabularies cut texts (a fixed value of that format).
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CONTROLS = [chr(c) for c in range(32) if c not in (9, 10, 13)] + ["\x7f"]
_UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f]")


# --- fragments --------------------------------------------------------------------------


@dataclass(frozen=True)
class Ends:
    """The open ends of a byte range: ids of A and of B. `closes` is the range that holds the first common end, None without one."""

    prefix: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())
    closes: int | None = None
    suffix: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())


def composed(left: Ends, right: Ends) -> tuple[Ends, tuple | None]:
    """The open ends of two neighbouring ranges together, and the group that this closes: (range, ids of A, ids of B)."""
    if left.closes is None:
        return Ends((left.prefix[0] + right.prefix[0], left.prefix[1] + right.prefix[1]), right.closes, right.suffix), None
    between = (left.suffix[0] + right.prefix[0], left.suffix[1] + right.prefix[1])
    if right.closes is None:
        return Ends(left.prefix, left.closes, between), None
    return Ends(left.prefix, left.closes, right.suffix), (right.closes, *between)


def fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the tokens that end in a byte range (ids, ends): how many of A, and of B, end up to each common end."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return np.searchsorted(a_ends, common, "right"), np.searchsorted(b_ends, common, "right")


# --- the tokenizers ---------------------------------------------------------------------


class Pair:
    """Both tokenizers of a worker: ids and bytes of A (a byte-level file) and B (a piece model)."""

    def __init__(self, content: str, proven: bool, model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        parsed, letters = json.loads(content), _byte_letters()
        vocabulary = parsed["model"]["vocab"] | {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
        self.a = Tokenizer.from_str(content)
        self.a.encode_special_tokens = True
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token if c in letters)
        plain = (parsed.get("normalizer"), parsed.get("pre_tokenizer")) == (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
        self.core = None
        if proven and plain:
            ranks = {self.a_bytes[i]: i for i in parsed["model"]["vocab"].values()}
            self.core = tiktoken.Encoding("bytes", pat_str=_CUT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))
        self.modulus = len(self.b_bytes)  # a pair of ids is one number: that of A times this plus that of B
        self.kind = np.dtype("<u4" if len(self.a_bytes) * self.modulus < 1 << 32 else "<i8")
        self.cuttable = plain and not any("▁" in p.lstrip("▁") for p in pieces)
        # the strings of the digest, by 3 * id + what follows (",", "|" or ";")
        self.words = [f"{i}{s}".encode() for i in range(max(len(self.a_bytes), len(self.b_bytes))) for s in ",|;"]

    def cuts(self, raw: bytes, size: int) -> list[int]:
        """Where ranges of a text (that begins with a space) of about `size` bytes begin, and the text's end."""
        out = [0]
        if self.cuttable:
            data = np.frombuffer(raw, np.uint8)
            # not before a last space: alone it is a text without tokens of B
            safe = np.flatnonzero((data[1:-1] == 0x20) & (data[:-2] > 0x20) & (data[:-2] < 0x7F)) + 1
            while (k := int(np.searchsorted(safe, out[-1] + size))) < len(safe):
                out.append(int(safe[k]))
        return [*out, len(raw)]

    def coded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B of each text, which begin with a space; None where the tokens' bytes are not the text's."""
        out = []
        # the two routes of A cut alike where character classes are old and plain
        easy = [self.core is not None and _plain(t) for t in texts]
        hard = iter(self.a.encode_batch_fast([t for t, e in zip(texts, easy, strict=True) if not e], add_special_tokens=False))
        for text, e, b in zip(texts, easy, self.b.encode([t[1:] for t in texts], num_threads=1), strict=True):
            a = self.core.encode_ordinary(text) if e else next(hard).ids
            raw = text.encode()
            same = b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if same else None)
        return out

    def cut_groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return fragment(a, np.cumsum(self.a_lengths[a]), b, np.cumsum(self.b_lengths[b]))

    def digest(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> bytes:
        """The groups of tokens that all are in groups, as text; `to_a`, `to_b`: tokens up to each group's end."""
        if not len(to_a):
            return b""
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        words = np.empty(len(a) + len(b), np.int64)
        place_a = np.arange(len(a)) + np.repeat(to_b - n_b, n_a)
        place_b = np.arange(len(b)) + np.repeat(to_a, n_b)
        words[place_a], words[place_b] = 3 * a, 3 * b
        words[place_a[to_a - 1]] += 1
        words[place_b[to_b - 1]] += 2
        table = self.words
        return b"".join([table[i] for i in words.tolist()])[:-1]


def _plain(text: str) -> bool:
    """Only tab, line ends, printable ASCII and Latin letters and signs, whose classes no version of a table changed."""
    if text.isascii():
        return not any(c in text for c in _CONTROLS)
    return not _UNUSUAL.search(text)


_PAIRS: dict[str, Pair] = {}


class SharedPair:
    """The two vocabulary files, sent to the executors (of fixed size)."""

    def __init__(self, spark: SparkSession, a_path: str | None, b_path: str | None):
        import public_tokenizers

        with open(a_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            content = f.read()
        with open(b_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
            model = f.read()
        vocabulary = json.loads(content)["model"]
        in_order = all(vocabulary["vocab"].get(x + y) == 256 + k for k, (x, y) in enumerate(_pairs(vocabulary)))
        proven = in_order and len(prove(content)) == len(vocabulary["vocab"])
        self.key = hashlib.sha256(content.encode() + model).hexdigest()
        self.sent = spark.sparkContext.broadcast((content, proven, model))

    def pair(self) -> Pair:
        if self.key not in _PAIRS:
            _PAIRS[self.key] = Pair(*self.sent.value)
        return _PAIRS[self.key]


# --- jobs -------------------------------------------------------------------------------

_UNIT = "block long, doc_id long, uid long, chunk int, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pairs array<long>, times array<long>"
_OPEN = "uid long, node int, closes int, prefix_a array<int>, prefix_b array<int>, suffix_a array<int>, suffix_b array<int>"
_RANGE = f"doc_id long, chunk int, ok boolean, n_a long, n_b long, n_closed long, body binary, links binary, {_OPEN}"
_BRIDGE = "range int, a array<int>, b array<int>"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _groups_of(texts: Iterable[str], pair: Pair) -> Iterator[tuple | None]:
    """(ids of A, ids of B, tokens up to each common end) of texts, a megabyte at a time; None as in `coded`."""
    some, held = [], 0

    def found():
        for code in pair.coded(some):
            yield None if code is None else (*code, *pair.cut_groups(*code))

    for text in texts:
        some.append(text)
        held += len(text)
        if held >= 1 << 20:
            yield from found()
            some, held = [], 0
    yield from found()


def blocked(rows: Iterable[tuple], kind: np.dtype, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Units from (doc_id, uid, chunk, n_a, n_b, n_groups, sha, links): each block ends with a row of its pairs."""
    schema, part = _arrow(_UNIT), TaskContext.get().partitionId()
    out, held, block = [], 0, part << 24

    def flushed():
        links = np.concatenate([np.frombuffer(r[8], kind) for r in out])
        pairs, times = np.unique(links, return_counts=True)
        summary = (block, *[None] * 8, pairs.astype(np.int64), times)
        return _batch([*out, summary], schema)

    for row in rows:
        out.append((block, *row, None, None))
        held += len(row[-1]) + 64
        if held >= block_bytes:
            yield flushed()
            out, held, block = [], 0, block + 1
    if out:
        yield flushed()


def _short_units(docs: DataFrame, shared: SharedPair, block_bytes: int) -> DataFrame:
    def units(batches):
        pair = shared.pair()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            groups = _groups_of((" " + t for t in texts if t), pair)
            for doc_id, text in zip(ids, texts, strict=True):
                found = next(groups) if text else None
                if found is None:
                    yield doc_id, None, 0, 0, 0, 0, "", b""
                    continue
                a, b, to_a, to_b = found
                links = a[to_a - 1] * pair.modulus + b[to_b - 1]
                yield doc_id, None, 0, len(a), len(b), len(to_a), hashlib.sha256(pair.digest(a, b, to_a, to_b)).hexdigest(), links.astype(pair.kind).tobytes()

    return docs.mapInArrow(lambda batches: blocked(units(batches), shared.pair().kind, block_bytes), _UNIT)


def _ranges(docs: DataFrame, shared: SharedPair, range_bytes: int) -> DataFrame:
    """Long documents (uid, doc_id) as ranges of their text, which begins with a space."""
    schema = _arrow("uid long, doc_id long, chunk int, text string")

    def cut(batches):
        pair, uid = shared.pair(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = b" " + text.encode()
                at, out, held = pair.cuts(raw, range_bytes), [], 0
                for k, (low, high) in enumerate(zip(at, at[1:], strict=False)):
                    out.append((uid, doc_id, k, raw[low:high].decode()))
                    held += high - low
                    if held > 1 << 22:
                        yield _batch(out, schema)
                        out, held = [], 0
                yield _batch(out, schema)
                uid += 1

    return docs.mapInArrow(cut, "uid long, doc_id long, chunk int, text string")


def _fragments(ranges: DataFrame, shared: SharedPair) -> DataFrame:
    schema = _arrow(_RANGE)

    def fragments(batches):
        pair = shared.pair()
        for batch in batches:
            rows = batch.to_pylist()
            for low in range(0, len(rows), 16):
                some, out = rows[low : low + 16], []
                for r, found in zip(some, _groups_of([r["text"] for r in some], pair), strict=True):
                    head, uid, chunk = (r["doc_id"], r["chunk"]), r["uid"], r["chunk"]
                    if found is None:
                        out.append((*head, False, 0, 0, 0, b"", b"", uid, chunk, None, [], [], [], []))
                        continue
                    a, b, to_a, to_b = found
                    if not len(to_a):
                        out.append((*head, True, len(a), len(b), 0, b"", b"", uid, chunk, None, a.tolist(), b.tolist(), [], []))
                        continue
                    (a0, a1), (b0, b1) = to_a[[0, -1]], to_b[[0, -1]]
                    body = pair.digest(a[a0:a1], b[b0:b1], to_a[1:] - a0, to_b[1:] - b0)
                    links = a[to_a[1:] - 1] * pair.modulus + b[to_b[1:] - 1]
                    open_ends = [x.tolist() for x in (a[:a0], b[:b0], a[a1:], b[b1:])]
                    out.append((*head, True, len(a), len(b), len(links), body, links.astype(pair.kind).tobytes(), uid, chunk, chunk, *open_ends))
                yield _batch(out, schema)

    return ranges.mapInArrow(fragments, _RANGE)


def _reduced(ends: DataFrame, ranges: int) -> DataFrame:
    """uid, range, a, b: the groups that composing all ranges of each document closes, the first one included."""
    schema = _arrow(f"{_OPEN}, {_BRIDGE}")

    def ends_of(r) -> Ends:
        return Ends((tuple(r["prefix_a"]), tuple(r["prefix_b"])), r["closes"], (tuple(r["suffix_a"]), tuple(r["suffix_b"])))

    def step(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["node"])
        uid, bridges = rows[0]["uid"], []

        def joined(left: Ends, right: Ends) -> Ends:
            both, bridge = composed(left, right)
            if bridge:
                bridges.append((uid, *[None] * 6, *bridge))
            return both

        e = reduce(joined, map(ends_of, rows))
        return pa.Table.from_batches([_batch([(uid, rows[0]["node"] // FAN, e.closes, *e.prefix, *e.suffix, None, None, None), *bridges], schema)])

    found = []
    while True:
        level = staged(ends.groupBy("uid", F.expr(f"node div {FAN}")).applyInArrow(step, f"{_OPEN}, {_BRIDGE}"), "ends")
        found.append(level.where("range is not null").select("uid", "range", "a", "b"))
        ends = level.where("range is null").select(*_arrow(_OPEN).names)
        ranges = -(-ranges // FAN)
        if ranges <= 1:
            break
    # a document begins and ends with a common end: its first group is the prefix of all of it
    first = ends.where("closes is not null").select("uid", F.col("closes").alias("range"), F.col("prefix_a").alias("a"), F.col("prefix_b").alias("b"))
    return reduce(DataFrame.unionByName, found, first)


def _long_units(docs: DataFrame, shared: SharedPair, range_bytes: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Units of long documents, and uid, groups_sha256 of each."""
    spark = docs.sparkSession
    ranges = staged(_ranges(docs, shared, range_bytes), "ranges")
    parts = staged(_fragments(ranges.repartition("uid", "chunk"), shared), "fragments")
    most = parts.agg(F.max("chunk")).first()[0]
    bad = parts.where("not ok").select("uid").distinct()
    good = parts.join(bad, "uid", "left_anti")
    groups = staged(_reduced(good.select(*_arrow(_OPEN).names), (most or 0) + 1), "bridges")

    text = F.concat(F.array_join(F.col("a").cast("array<string>"), ","), F.lit("|"), F.array_join(F.col("b").cast("array<string>"), ","))
    bridge = groups.select("uid", F.col("range").alias("chunk"), F.lit(0).alias("turn"), F.encode(text, "utf-8").alias("body"))
    body = good.where("n_closed > 0").select("uid", "chunk", F.lit(1).alias("turn"), "body")

    def hashed(batches):
        uid, digest = None, None
        for batch in batches:
            out = []
            for r in batch.select(["uid", "body"]).to_pylist():
                if r["uid"] != uid:
                    if digest:
                        out.append((uid, digest.hexdigest()))
                    uid, digest = r["uid"], hashlib.sha256(r["body"])
                else:
                    digest.update(b";")
                    digest.update(r["body"])
            yield _batch(out, _arrow("uid long, groups_sha256 string"))
        if digest:
            yield _batch([(uid, digest.hexdigest())], _arrow("uid long, groups_sha256 string"))

    ordered = bridge.unionByName(body).repartition("uid").sortWithinPartitions("uid", "chunk", "turn")
    digests = ordered.mapInArrow(hashed, "uid long, groups_sha256 string")

    rows = [
        good.selectExpr("doc_id", "uid", "chunk", "n_a", "n_b", "n_closed as n_groups", "links", "null as a", "null as b"),
        groups.selectExpr("null as doc_id", "uid", "range as chunk", "0L as n_a", "0L as n_b", "1L as n_groups", "null as links", "a", "b"),
        parts.join(bad, "uid", "left_semi").selectExpr("doc_id", "uid", "chunk", "0L as n_a", "0L as n_b", "0L as n_groups", "X'' as links", "null as a", "null as b"),
    ]

    def units(batches):
        pair = shared.pair()
        for batch in batches:
            for r in batch.to_pylist():
                links = r["links"] if r["a"] is None else np.array([r["a"][-1] * pair.modulus + r["b"][-1]], pair.kind).tobytes()
                yield r["doc_id"], r["uid"], r["chunk"], r["n_a"], r["n_b"], r["n_groups"], None, links

    all_rows = reduce(DataFrame.unionByName, rows)
    return all_rows.mapInArrow(lambda batches: blocked(units(batches), shared.pair().kind, block_bytes), _UNIT), digests


def _counted(units: DataFrame, modulus: int, kind: np.dtype) -> DataFrame:
    """The units with n_links, n_best and count_sum."""
    own = units.where("pairs is not null").select("block", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    total = own.groupBy("pair").agg(F.sum("times").alias("total"))
    # partners of an id of B are bounded by the vocabulary of A
    ranked = total.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy(F.col("pair") % modulus)))
    known = own.select(F.col("block").alias("of"), "pair").join(ranked, "pair")
    kept = units.where("pairs is null").drop("pairs", "times")
    added = f"{_UNIT.removesuffix(', links binary, pairs array<long>, times array<long>')}, n_links long, n_best long, count_sum long"

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")
        pairs, total = right.column("pair").to_numpy(), right.column("total").to_numpy()
        best = right.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
        lists = [np.frombuffer(x, kind) for x in left.column("links").to_pylist()]
        lengths = np.array([len(x) for x in lists], np.int64)
        place = np.searchsorted(pairs, np.concatenate(lists).astype(np.int64))
        at = np.concatenate(([0], np.cumsum(lengths)))
        out = left.drop_columns(["links"]).append_column("n_links", pa.array(lengths))
        for name, values in (("n_best", best), ("count_sum", total)):
            sums = np.concatenate(([0], np.cumsum(values[place])))
            out = out.append_column(name, pa.array(sums[at[1:]] - sums[at[:-1]], pa.int64()))
        return out

    return kept.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(summed, added)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, range_bytes: int = 1 << 18, block_bytes: int = 1 << 22) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    `range_bytes`: longer documents are cut into ranges of about so many bytes, which are spread
    over tasks; a range without a place to cut is longer. `block_bytes`: links (4 bytes each) whose
    pairs are counted, and looked up, together. Neither changes the result. The digest of a long
    document is a sha256 of its groups in order, so one task reads them, in a stream.

    Null and empty texts, and texts that the joined tokens of A or B don't reproduce, have zeros
    and an empty digest. Rows with null or repeated doc_id are documents of their own; other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = SharedPair(spark, a_path, b_path)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.octet_length("text") >= range_bytes, F.lit(False))
    short = staged(_short_units(texts.where(~is_long), shared, block_bytes), "units")
    long_units, digests = _long_units(texts.where(is_long), shared, range_bytes, block_bytes)
    # blocks of long documents have negative numbers
    units = short.unionByName(staged(long_units, "long-units").withColumn("block", -1 - F.col("block")))
    counted = staged(_counted(units, shared.pair().modulus, shared.pair().kind), "aligned")
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    by_uid = counted.where("uid is not null").groupBy("uid").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in sums])
    long_rows = by_uid.join(digests, "uid", "left").select("doc_id", *sums, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return counted.where("uid is null").select("doc_id", *sums, "groups_sha256").unionByName(long_rows)
