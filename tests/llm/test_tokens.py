import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarifflume.llm import packing, token_counts, token_files
from tarifflume.llm.common import shared_folder
from tarifflume.llm.vocabulary import Coder, default_path, prove

LIBRARY = Tokenizer.from_file(default_path())
ODD = [
    None, "", " \n\t", "It's <|endoftext|>x don't 'some <|ENDOFTEXT|> <|startoftext|>", "ÀÉ²½ x y\x85z w İI ΣΑΣ \x1cab 漢字", "éte a_b--c '' ''s I'LL",
    "x" * 5000, "ﬁ Å K ½a ªº µß × ÷ \xad soft\xadhy", "a1b22c ÑñÜ×÷¿¡ß ÿÿ Þþ", "<|endoftext|>", "́ é", "word " * 3000, "same text", "same text",
]


def ids_of(text, end=None):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])


@pytest.fixture(scope="module")
def coder():
    content = open(default_path(), encoding="utf-8").read()
    return Coder(content, prove(content))


def coded(coder, texts):
    out = []
    for a, b, ids, at in coder.ids(pa.array(texts, pa.string())):
        out += [ids[at[i] : at[i + 1]].tolist() for i in range(b - a)]
    return out


def test_ids_are_those_of_the_library(coder):
    assert coded(coder, ODD) == [ids_of(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F, exclude_categories=["Cs"]), st.sampled_from("aet .,'<|>\ń Σ")), max_size=40), max_size=4))
def test_any_text_is_coded_as_by_the_library(coder, texts):
    assert coded(coder, texts) == [ids_of(t) for t in texts]


def test_a_small_memory_and_unproven_merges_change_nothing(coder):
    content = open(default_path(), encoding="utf-8").read()
    small = Coder(content, frozenset(list(prove(content))[:9000]), remembered=12_000)
    assert small.core is None
    assert coded(small, ODD) == [ids_of(t) for t in ODD]


def test_every_vocabulary_string_is_whole():
    content = open(default_path(), encoding="utf-8").read()
    assert len(prove(content)) == len(LIBRARY.get_vocab(with_added_tokens=False))


def test_token_counts(spark, make_docs):
    docs = make_docs(ODD + [(None, "no id"), (3, "id again")], n_tokens=7)
    got = Counter(tuple(r) for r in token_counts.token_counts(docs, limit=5).collect())
    rows = [*enumerate(ODD), (None, "no id"), (3, "id again")]
    assert got == Counter((i, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 5) for i, t in rows)
    assert token_counts.token_counts(make_docs([])).collect() == []


def test_token_files_round_trip(spark, make_docs):
    rng = random.Random(3)
    rows = [*enumerate(ODD), *((100 - k, " ".join(rng.choices("a bee sea of the end".split(), k=rng.randint(0, 400)))) for k in range(60))]
    path = shared_folder(spark, "files")
    token_files.write_token_files(make_docs(rows), path, end_id=2, block_ids=500, run=16)
    got = {r["doc_id"]: r for r in token_files.read_token_files(spark, path).collect()}
    start = 0
    for i, text in sorted(rows):
        ids = ids_of(text, 2)
        assert got[i]["ids"] == ids and got[i]["start"] == start and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == len(rows)


def test_token_files_of_nothing_and_of_null_ids(spark, make_docs):
    path = shared_folder(spark, "files")
    token_files.write_token_files(make_docs([]), path)
    assert token_files.read_token_files(spark, path).collect() == []
    path = shared_folder(spark, "files")
    token_files.write_token_files(make_docs([(None, "a"), (1, "b"), (1, "c d"), (0, None)]), path)
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in token_files.read_token_files(spark, path).collect()), key=str)
    assert got == [(0, 1), (1, 2), (1, 3), (None, 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=40), st.integers(6, 12))
def test_code_lengths_are_a_full_code_within_the_limit(counts, limit):
    lengths = token_files.code_lengths(np.array(counts), limit)
    used = lengths[lengths > 0].astype(float)
    assert (lengths > 0).tolist() == [c > 0 for c in counts] and lengths.max(initial=0) <= limit
    if len(used) > 1:
        assert (2.0**-used).sum() == 1


def test_code_lengths_are_huffmans_where_the_limit_is_far():
    import heapq

    rng = np.random.default_rng(0)
    counts = rng.integers(1, 1000, 200)
    heap, total = sorted(counts.tolist()), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    assert (token_files.code_lengths(counts, 20) * counts).sum() == total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_plan_is_that_of_one_by_one_best_fit(lengths, size):
    plan = packing.best_fit_plan(Counter(lengths), size)
    used, placed = defaultdict(list), Counter()
    for length, _, n, first, offset in plan.tolist():
        placed[length] += n
        for k in range(n):
            used[first + k].append((offset, length))
    assert placed == Counter(lengths)
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    assert len(used) == brute.best_fit(lengths, size)


def test_pack(spark, make_docs):
    rows = [*enumerate(ODD), (None, "no id"), (3, "id again")]
    got = packing.pack(make_docs(rows, length="x"), size=64, with_ids=True).collect()
    expected = Counter()
    for i, text in rows:
        ids = ids_of(text, 0)
        expected.update((i, k // 64, k, tuple(ids[k : k + 64])) for k in range(0, len(ids), 64))
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == brute.best_fit([r["length"] for r in got], 64)
    assert packing.pack(make_docs([])).collect() == []
