import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tarifflume.llm import lexical_search
from tarifflume.llm.lexical_search import nra, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """docs, items: (id, text). (item_id, rank, doc_id, score)."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(terms(text)).items() if t in c)
            scores.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(s for s in scores if s[0] < 0)[:k], 1)]
    return sorted(out, key=str)


def ranked(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


def made(n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(n)]


ODD = [(900, None), (901, ""), (902, " -;\n"), (903, "Straße ÄÖ x_y x-y don't"), (904, "w1 " * 5000), (905, "İ漢字 w2\x85w3 ﬁ"), (None, "w5 w6 w7"), (907, "w1W1,w1")]
COPIES = [(2000 + i, "w3 w4 copies of one text w5 w5") for i in range(80)]
ITEMS = [(1, "w3 w4 w5 copies"), (2, "w1 w1 w2 strasse Straße x y"), (3, None), (4, "nowhere found"), (5, "漢字 İ漢字"), (6, "w7 w8 w9 w10 w11 w12 w1"), (6, "w7 w8 w9 w10 w11 w12 w1"), (7, "one")]


@pytest.mark.parametrize(("k", "block_terms", "shard_postings"), [(20, 1 << 20, 1 << 20), (5, 3, 200), (1, 1, 1 << 20), (300, 1 << 20, 50)])
def test_ranks_are_those_of_scoring_every_document(spark, make_docs, k, block_terms, shard_postings):
    docs = made(300, 1) + ODD + COPIES
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = make_docs(docs, score=1, rank=2, item_id=3).repartition(5)
    assert ranked(lexical_search.search(df, items, k, block_terms, shard_postings)) == plain(docs, ITEMS, k)


def test_repeated_ids_are_documents_of_their_own_and_empty_tables_give_nothing(spark, make_docs):
    docs = [(1, "a b"), (1, "a b"), (1, "a c"), (2, "b")]
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked(lexical_search.search(make_docs(docs), items)) == plain(docs, [(1, "a b")], 20)
    assert ranked(lexical_search.search(make_docs([]), items)) == []
    assert ranked(lexical_search.search(make_docs(docs), items.limit(0))) == []
    assert ranked(lexical_search.search(make_docs([(1, None)]), items)) == []


def test_nra_resolves_ties_and_scores_at_every_depth():
    rng = np.random.default_rng(4)
    for trial in range(200):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        lists, total = [], np.zeros(n, np.int64)
        for _ in range(rng.integers(1, 7)):
            docs = rng.permutation(n)[: rng.integers(1, n + 1)]
            scores = np.sort(rng.integers(0, 5 if trial % 2 else 100, len(docs)))[::-1].astype(np.int64)
            lists.append((docs, scores))
            total[docs] += scores
        want = [i for i in np.lexsort((np.arange(n), -total)) if total[i] > 0][:k]
        for depth in (1, 2, 256):
            found, scores = nra(lists, n, k, depth)
            assert found.tolist() == want and scores.tolist() == total[want].tolist()
        big = [(d, s * (1 << 45)) for d, s in lists]
        assert nra(big, n, k, 1)[0].tolist() == want


def test_terms_are_those_of_the_pattern():
    for text in [t for _, t in ODD]:
        n = sum(len(h) for _, _, h, _ in terms_of(pa.array([text], pa.string())))
        assert n == len(terms(text))
