import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tarifflume.llm import retrieval_packing
from tarifflume.llm.retrieval_packing import Shard, Windows, best_first, saturated, term_counts, weights
from tarifflume.llm.vocabulary import default_path

LIBRARY = Tokenizer.from_file(default_path())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def held(rows, docs, size):
    """All of the contract that does not depend on which neighbours were chosen."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == {i for i, _ in docs}
    for i, text in docs:
        ids, at = ids_of(text), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0
    return by_sequence


TOPICS = ["red green blue colour paint brush", "ship sea harbour sail storm wave", "bread flour oven yeast dough salt"]


def made(n, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(TOPICS[i % 3].split(), k=rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize(("size", "shard_tokens", "task_tokens"), [(64, 1 << 20, 1 << 22), (64, 500, 2000), (32, 1, 3000), (256, 300, 1 << 22)])
def test_every_id_is_in_one_piece_and_windows_are_full(spark, make_docs, size, shard_tokens, task_tokens):
    docs = [*made(90), (1000, None), (1001, ""), (1002, "sail " * 700), (1003, "漢字 <|endoftext|> x" * 30), *[(2000 + k, "the same words in all of these rows") for k in range(120)]]
    rows = retrieval_packing.pack(make_docs(docs, sequence_id=7, tail="x", kind=1), size=size, shard_tokens=shard_tokens, task_tokens=task_tokens).collect()
    held(rows, docs, size)


def test_windows_hold_neighbours_of_their_seed(spark, make_docs):
    docs = [(i, t) for i, t in made(150) if t]
    rows = retrieval_packing.pack(make_docs(docs), size=256).collect()
    alike = total = 0
    for pieces in held(rows, docs, 256).values():
        topics = [r.doc_id % 3 for r in pieces]
        alike += sum(max(topics.count(k) for k in range(3)) for _ in [0])
        total += len(topics)
    assert alike > 0.8 * total


def test_repeated_and_null_ids_and_empty_table(spark, make_docs):
    rows = retrieval_packing.pack(make_docs([(None, "a b"), (5, "a b c"), (5, "a b c"), (None, None)]), size=8).collect()
    assert sum(r.length for r in rows) == 3 + 4 + 4 + 1
    assert retrieval_packing.pack(make_docs([])).collect() == []


def test_scores_are_those_of_a_plain_bm25():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 30, rng.integers(1, 40)) for _ in range(25)]
    df = np.array([sum(t in x for x in texts) for t in range(30)], float)
    mean = np.mean([len(x) for x in texts])
    of, terms, counts = term_counts(np.repeat(np.arange(25), [len(x) for x in texts]), np.concatenate(texts), 30)
    lengths = np.array([len(x) for x in texts])
    shard = Shard(of, terms, weights(df, 25)[terms] * saturated(counts, lengths[of], mean), 25)
    for q in range(25):
        plain = [
            sum(np.log(1 + (25 - df[t] + 0.5) / (df[t] + 0.5)) * (x == t).sum() * 2.2 / ((x == t).sum() + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in set(texts[q].tolist()))
            for x in texts
        ]
        assert np.allclose(shard.scored(shard.query_of(q)), plain)


def test_best_first_is_a_stable_sort():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 3000):
        scores = rng.integers(-1, 6, n).astype(float)
        want = [i for i in np.argsort(-scores, kind="stable") if scores[i] >= 0]
        assert list(best_first(scores)) == want


def test_an_open_window_is_cut_at_powers_of_two():
    windows = Windows(64, 0)
    for n in (5, 30, 16):
        windows.add({"doc_id": n, "start": 0, "doc_tokens": n, "length": n, "tail": np.arange(n, dtype="<u4").tobytes()}, 0)
    lengths = defaultdict(int)
    for piece in windows.cut():
        lengths[piece[5]] += piece[2]
    assert list(lengths.values()) == [32, 16, 2, 1]
