import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarifflume.llm import decontaminate, ngram_join, substring_dedup


def some_docs(seed, n_words=60, groups=8):
    """Unrelated texts, exact copies, near copies, common passages, short and empty ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of", "And"] * 30
    words = lambda n: rng.choices(vocabulary, k=n)
    passage = words(25)
    texts = [None, "", "  \n", "one", "One two", "one two", "A b c", "a  b\nc"]
    for _ in range(groups):
        base = words(n_words)
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = base[:]
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        texts.append(" ".join(words(20) + passage + words(5)))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, n, percent, group", [(1, 3, 90, 4_000_000), (2, 5, 80, 4_000_000), (3, 3, 90, 300)])
def test_similar_is_that_of_all_pairs(make_docs, seed, n, percent, group):
    docs = some_docs(seed)
    label, links = brute.components(docs, n, percent)
    got = ngram_join.similar(make_docs(docs, component_id=1), n, percent, group_ngrams=group).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == {i: (len(brute.shingles(t, n)), label[i], links[i]) for i, t in docs}


def test_similar_with_hot_group_null_and_repeated_ids(make_docs):
    rng = random.Random(5)
    base = [f"w{rng.randrange(1000)}" for _ in range(80)]
    docs = [(k, " ".join(base)) for k in range(40)] + [(100 + k, " ".join([*base[:40], f"x{k}", *base[41:]])) for k in range(40)]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.similar(make_docs([*docs, (None, " ".join(base)), (7, "other words of that id")])).collect()}
    assert got == {(i, 0) for i, _ in docs} | {(None, None)}
    assert ngram_join.similar(make_docs([])).collect() == []
    kept = ngram_join.first_of_each(make_docs([*docs, (None, " ".join(base))])).select("doc_id").collect()
    assert sorted((r[0] for r in kept), key=str) == [0, None]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.sampled_from([50, 80, 90, 100]), st.floats(0, 1), st.floats(0, 1))
def test_sets_that_link_keep_a_common_signature(seed, small, percent, a, b):
    large = small + int(a * (100 * small // percent - small))
    least = -(-percent * (small + large) // (100 + percent))
    shared = min(small, least + int(b * (small - least + 1)))
    if shared < least or shared == large:
        return  # no link, or equal sets
    grams = np.random.default_rng(seed).integers(0, 2**64 - 1, 3 * large + 3, np.uint64, endpoint=True)
    sets = [np.unique(grams[:small]), np.unique(np.concatenate([grams[:shared], grams[small : small + large - shared]]))]
    of, step, sign, spare = ngram_join.signatures(sets, percent)
    common = set(sign[of == 0].tolist()) & set(sign[of == 1].tolist())
    kept = [set(), set()]
    for k in (0, 1):
        for s in {*step[of == k].tolist()}:
            mine = (of == k) & (step == s)
            order = sorted(sign[mine].tolist(), key=lambda x: (x not in common, x))  # worst: the common ones go first
            kept[k] |= set(order[int(spare[mine][0]) :])
    assert kept[0] & kept[1]


def searched(monkeypatch):
    """Rows and words of each search, as they are made."""
    calls, real = [], ngram_join._search

    def search(groups, *more):
        calls.append(groups.agg(F.count("*"), F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0))).first())
        return real(groups, *more)

    monkeypatch.setattr(ngram_join, "_search", search)
    return calls


def test_unrelated_texts_of_common_words_are_not_searched_together(make_docs, monkeypatch):
    """N-grams that many texts hold, a passage, and a few links: only what may link is searched."""
    rng = random.Random(3)
    words = lambda n: rng.choices("the of and to in a is that".split(), k=n)
    passage = words(25)
    texts = [words(rng.randint(60, 160)) for _ in range(300)]
    for t in texts[::3]:
        t[10:10] = passage
    texts += [[*t[:30], "new", *t[31:]] for t in texts[:12]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    calls = searched(monkeypatch)
    label, links = brute.components(docs, 5, 80)
    got = ngram_join.similar(make_docs(docs), 5, 80, group_ngrams=1000).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_links"]) for r in got} == {i: (label[i], links[i]) for i, _ in docs}
    assert sum(c[0] for c in calls) <= 150


def test_blocks_of_a_large_group_are_copied_in_rounds(make_docs, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10_000)}" for _ in range(100)]
    docs = [(k, " ".join([*base[:50], f"x{k}", *base[51:]])) for k in range(60)]
    calls = searched(monkeypatch)
    got = ngram_join.similar(make_docs(docs), 5, 80, group_ngrams=500).collect()
    assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in got} == {(k, 0, 59) for k in range(60)}
    assert len(calls) > 4 and max(c[1] for c in calls) <= 3 * 60 * 100


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=10), min_size=1, max_size=14), st.sampled_from([50, 80, 90]))
def test_divide_skip_finds_all_links(sets, percent):
    arrays = sorted((np.array(sorted(s), np.uint64) for s in sets), key=len)
    got = {(x, int(y)) for x, ys in ngram_join.linked(arrays, percent) for y in ys}
    expected = set()
    for x in range(len(arrays)):
        for y in range(x):
            a, b = set(arrays[x].tolist()), set(arrays[y].tolist())
            if 100 * len(a & b) >= percent * len(a | b):
                expected.add((x, y))
    assert got == expected


@pytest.mark.parametrize("seed, length, group", [(1, 13, 20_000), (2, 5, 1), (3, 20, 20_000)])
def test_remove_repeats_is_that_of_all_windows(make_docs, seed, length, group):
    docs = some_docs(seed)
    expected = brute.without_repeats(docs, length)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(make_docs(docs, starts=1, key="k"), length, group_spans=group).collect()}
    for i, text in docs:
        words = brute.WORD.findall(text or "")
        assert got[i]["n_words"] == len(words) and got[i]["n_removed"] == len(words) - len(expected[i])
        assert brute.WORD.findall(got[i]["text"] or "") == expected[i]
        assert sum(b - a for a, b in got[i]["removed"]) == got[i]["n_removed"]
    kept = {r["doc_id"]: r for r in substring_dedup.without_repeats(make_docs(docs), length, group).collect()}
    assert all(brute.WORD.findall(kept[i]["text"] or "") == expected[i] and kept[i]["n_chars"] == len(kept[i]["text"] or "") for i, _ in docs)


def test_remove_repeats_with_null_repeated_ids_and_nothing(make_docs):
    text = " ".join(f"w{k}" for k in range(30))
    got = substring_dedup.remove_repeats(make_docs([(1, text), (1, text), (1, text + " more"), (2, text), (None, text), (0, None)]), 13).collect()
    assert sorted(((r["doc_id"], r["n_removed"]) for r in got), key=str) == [(0, 0), (1, 0), (1, 0), (1, 0), (2, 30), (None, 0)]
    assert substring_dedup.remove_repeats(make_docs([])).collect() == []


@pytest.mark.parametrize("group", [1, 20_000])
def test_many_repeated_rows(make_docs, group):
    """1,000 equal rows cost 1,000 rows, in groups of spans and in whole windows alike."""
    text = " ".join(f"w{k * k % 211}x{k % 17}" for k in range(200))
    near = "other " + text.replace("w4x2 ", "changed ") + " tail"
    docs = [(1, text), *[(2, near)] * 1000, (3, "a " + text), (3, "a " + text)]
    got = substring_dedup.remove_repeats(make_docs(docs), 13, group_spans=group).collect()
    once = [(1, text), (2, near), (3, "a " + text)]
    kept = brute.without_repeats(once, 13)
    assert len(got) == 1003
    assert {(r["doc_id"], r["n_removed"], r["text"]) for r in got} == {(d, len(t.split()) - len(kept[d]), " ".join(kept[d])) for d, t in once}


def test_contaminated_is_that_of_all_pairs(spark, make_docs):
    rng = random.Random(9)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(n)]
    items = [(k, " ".join(words(n))) for k, n in enumerate([3, 5, 6, 9, 16, 17, 33, 60, 200])] + [(20, None), (21, ""), (22, "..."), (23, "Été, àÉ b c d e f!")]
    docs = [(k, " ".join(words(300))) for k in range(6)] + [(10, None), (11, ""), (12, items[0][1]), (13, items[0][1] + " z")]
    for k, (i, text) in enumerate(items):
        if text:
            own = text.split()
            docs.append((100 + k, " ".join(words(200) + own + words(90))))
            cut = own[: max(1, int(len(own) * 0.85))]
            docs.append((200 + k, " ".join(words(50) + [w.upper() + "," for w in cut] + words(700))))
            half = own[: len(own) // 2]
            docs.append((300 + k, " ".join(words(30) + half + words(30))))
    docs += [(400, docs[0][1] + " " + items[6][1]), (400, docs[1][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_item_shingles"], r["n_shared"]) for r in decontaminate.contaminated(make_docs([*docs, (None, items[6][1])], item_id=5), table).collect()}
    assert got == brute.contained(docs, items)
    kept = decontaminate.without_contaminated(make_docs([*docs, (None, items[6][1])]), table)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {d for d, _ in got} | {None}


def test_contaminated_of_empty_tables(spark, make_docs):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.contaminated(make_docs([]), items).collect() == []
    assert decontaminate.contaminated(make_docs(["a b c d e f g"]), items.where("false")).collect() == []
    one = decontaminate.contaminated(make_docs(["a b c d e f g"]), items.union(items)).select("doc_id", "item_id", F.round("containment", 3)).collect()
    assert [tuple(r) for r in one] == [(0, 1, 1.0)]
