import hashlib
import random
from collections import Counter
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarifflume.llm import alignment
from tarifflume.llm.alignment import Ends, SharedPair, composed, fragment
from tarifflume.llm.vocabulary import _byte_letters

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
LETTERS = _byte_letters()


def bytes_a(i):
    return bytes(LETTERS[c] for c in A.id_to_token(i))


def bytes_b(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def groups(text):
    """The groups of a text, one token after the other; None where the bytes differ."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw = (" " + text).encode()
    if b"".join(map(bytes_a, a)) != raw or b"".join(map(bytes_b, b)) != raw:
        return None
    out, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            at_a += len(bytes_a(a[i]))
            out[-1][0].append(a[i])
            i += 1
        else:
            at_b += len(bytes_b(b[j]))
            out[-1][1].append(b[j])
            j += 1
        if at_a == at_b:
            out.append(([], []))
    return out[:-1]


def plain(docs):
    cut = [(i, groups(t)) for i, t in docs]
    count = Counter((a[-1], b[-1]) for _, g in cut if g for a, b in g)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for i, g in cut:
        g = g or []
        links = [(a[-1], b[-1]) for a, b in g]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        sizes = (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links))
        out.append((i, *sizes, sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


rng = random.Random(8)
WORDS = "the of and unbelievable tokenization Straße größer déjà vu l'été naïveté 12345 x_y don't I'll ☃ 漢字 ... -- \n \t".split(" ")
DOCS = [
    *[(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 40)))) for i in range(60)],
    (100, None), (101, ""), (102, " "), (103, "▁ lower block"), (104, "<|endoftext|> <s> </s> <unk>"), (105, "a\x00b \x07"), (106, "ﬁ½\u3000x\xa0y"), (107, "  two  spaces  "),
    (108, "no_place_to_cut" * 60), (109, "the unbelievable tokenization of x " * 120), (110, "the ▁ " * 100), (111, "\u0378ꟁ🜚 \U0001fae8" * 9), (112, "漢字" * 300 + " x"), (None, "null id"),
]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize(("range_bytes", "block_bytes"), [(1 << 18, 1 << 22), (24, 512), (300, 1)])
def test_groups_and_counts_are_those_of_a_token_by_token_walk(spark, make_docs, range_bytes, block_bytes):
    df = make_docs(DOCS, uid=4, block=1, n_a="x").repartition(3)
    rows = alignment.align(df, range_bytes=range_bytes, block_bytes=block_bytes).select(*COLUMNS).collect()
    assert sorted(map(tuple, rows), key=str) == plain(DOCS)


def test_repeated_rows_and_empty_table(spark, make_docs):
    docs = [(1, "same text here"), (1, "same text here"), (1, "another")]
    assert sorted(map(tuple, alignment.align(make_docs(docs)).select(*COLUMNS).collect()), key=str) == plain(docs)
    assert alignment.align(make_docs([])).collect() == []


ENDS = st.builds(
    lambda p, q, c, s, t: Ends((tuple(p), tuple(q)), c, (tuple(s), tuple(t)) if c is not None else ((), ())),
    *[st.lists(st.integers(0, 9), max_size=3)] * 2, st.none() | st.integers(0, 99), *[st.lists(st.integers(0, 9), max_size=3)] * 2,
)


def total(parts):
    """Composed from the left: the ends, and all groups closed."""
    closed = []

    def both(x, y):
        e, bridge = composed(x, y)
        closed.extend([bridge] if bridge else [])
        return e

    return reduce(both, parts), closed


@given(st.lists(ENDS, min_size=3, max_size=8), st.data())
def test_composition_is_associative(parts, data):
    k = data.draw(st.integers(1, len(parts) - 1))
    left, closed_left = total(parts[:k])
    right, closed_right = total(parts[k:])
    both, closed = total([left, right])
    want, closed_want = total(parts)
    assert both == want and Counter(closed + closed_left + closed_right) == Counter(closed_want)
    assert total([Ends(), *parts, Ends()]) == (want, closed_want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.lists(st.integers(1, 5), min_size=1, max_size=30), st.lists(st.integers(0, 150), max_size=6))
def test_any_byte_ranges_give_the_groups_of_the_whole(a_lengths, b_lengths, cuts):
    gap = sum(a_lengths) - sum(b_lengths)
    (b_lengths if gap > 0 else a_lengths).extend([1] * abs(gap))
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    a, b = np.arange(len(a_ends)), np.arange(len(b_ends))
    want = [(x.tolist(), y.tolist()) for x, y in zip(*(np.split(t, e[:-1]) for t, e in zip((a, b), fragment(a, a_ends, b, b_ends), strict=True)), strict=True)]
    bounds = [0, *sorted(c for c in cuts if c < a_ends[-1]), int(a_ends[-1])]
    parts, closed = [], []
    for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        mine_a, mine_b = (a_ends > low) & (a_ends <= high), (b_ends > low) & (b_ends <= high)
        x, y = a[mine_a], b[mine_b]
        to_x, to_y = fragment(x, a_ends[mine_a], y, b_ends[mine_b])
        if not len(to_x):
            parts.append(Ends((tuple(x), tuple(y))))
            continue
        parts.append(Ends((tuple(x[: to_x[0]]), tuple(y[: to_y[0]])), k, (tuple(x[to_x[-1] :]), tuple(y[to_y[-1] :]))))
        closed += [(tuple(x[i:j]), tuple(y[p:q])) for i, j, p, q in zip(to_x, to_x[1:], to_y, to_y[1:], strict=False)]
    whole, bridges = total(parts)
    closed += [(p, q) for _, p, q in bridges] + [whole.prefix]
    assert whole.suffix == ((), ()) and sorted((list(map(int, p)), list(map(int, q))) for p, q in closed) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab  's\n▁é.1")), min_size=1, max_size=60))
def test_ids_are_those_of_the_libraries_however_texts_are_cut(pair, text):
    whole = pair.coded([" " + text])[0]
    want = groups(text)
    assert (whole is None) == (want is None)
    raw = (" " + text).encode()
    at = pair.cuts(raw, 5)
    parts = pair.coded([raw[x:y].decode() for x, y in zip(at, at[1:], strict=False)])
    if whole is None:
        assert None in parts
    else:
        assert whole[0].tolist() == [i for a, _ in want for i in a] and whole[1].tolist() == [i for _, b in want for i in b]
        assert all(np.array_equal(np.concatenate([p[k] for p in parts]), whole[k]) for k in (0, 1))


def test_a_last_space_is_not_cut_off(pair):
    for text in ("0000 ", "0000  ", "one two ", "a ", " "):
        raw = (" " + text).encode()
        whole = pair.coded([" " + text])[0]
        for size in range(1, 8):
            at = pair.cuts(raw, size)
            parts = pair.coded([raw[x:y].decode() for x, y in zip(at, at[1:], strict=False)])
            assert (whole is None) == (None in parts), (text, size)
            assert whole is None or all(np.array_equal(np.concatenate([p[k] for p in parts]), whole[k]) for k in (0, 1))


@pytest.fixture(scope="module")
def pair(spark):
    found = SharedPair(spark, None, None).pair()
    assert found.core is not None and found.cuttable
    return found
