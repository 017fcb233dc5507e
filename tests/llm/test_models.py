import base64
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarifflume.llm import ann, html_text, language_id, sharding
from tarifflume.llm.common import shared_folder, slices


# --- sharding ---------------------------------------------------------------------------


def test_shards_are_near_equal_and_gapless(spark, make_docs):
    rng = random.Random(1)
    rows = [(k, "x" * rng.choice((0, 10, 300, 5000))) for k in range(600)] + [(None, None), (5, "again"), (5, "again"), (7, "é" * 10)]
    path = shared_folder(spark, "map")
    got = sharding.shard(make_docs(rows, slot=1, shard="x"), shards=6, map_path=path).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    places, sizes = defaultdict(list), Counter()
    for r in got:
        places[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) == set(range(6))
    assert max(sizes.values()) - min(sizes.values()) < 100
    versions = [[r["shard"] for r in sharding.read_map(spark, path, v).orderBy("slot").collect()] for v in (0, 1)]
    assert versions[0] == sharding.even_map(sharding.SLOTS, 6) and len(versions[1]) == sharding.SLOTS
    assert sharding.shard(make_docs([])).collect() == []


def test_rebalancing_moves_nothing_where_all_is_even():
    even = sharding.even_map(64, 4)
    assert sharding.rebalanced(even, [10] * 64, 4) == even
    skewed = sharding.rebalanced(even, [100] * 8 + [10] * 56, 4)
    load = [sum((100 if s < 8 else 10) for s in range(64) if skewed[s] == k) for k in range(4)]
    assert max(load) - min(load) <= 10


def test_written_shards_hold_all_rows(spark, make_docs):
    docs = make_docs([f"text {k}" for k in range(40)])
    path = shared_folder(spark, "shards")
    sharding.write_shards(docs, sharding.shard(docs, shards=3), path)
    assert spark.read.parquet(path).select("doc_id", "text").count() == 40


# --- language identification --------------------------------------------------------------


def test_presence_counts_each_ngram_once():
    data = np.frombuffer("aaXa".encode() + "Éé".encode() + b"aa", np.uint8)
    there = language_id.presence(data, np.array([0, 4, 8, 10]))
    assert np.array_equal(there[0] & there[2], there[2])  # 'aa' in 'aaXa'
    assert there[2].sum() == 2
    same = language_id.presence(np.frombuffer("ÉÉéé".encode(), np.uint8), np.array([0, 4, 8]))
    assert np.array_equal(same[0], same[1])


def test_languages_of_held_out_texts(spark):
    rng = random.Random(4)
    parts = {"aa": ["ka", "to", "mi", "ru", "shi", "no"], "bb": ["sch", "ein", "ung", "ver", "ich", "mit"], "cc": ["é", "eau", "ou", "tion", "que", "la"]}
    text = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(k, text(lang, rng.randint(3, 60)), lang) for k in range(300) for lang in [rng.choice(list(parts))]]
    odd = [(900, None, "aa"), (901, "", None), (902, "123 !!", "bb"), (None, text("aa", 9), None), (903, text("cc", 5000), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = language_id.train(docs.where(~language_id.held_out()), sample=200, n_landmarks=40)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()]
    found = {i: (p, s) for i, p, s in got}
    out = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([found[i][0] == lang for i, lang in out]) > 0.97
    assert all(found[i] == ("und", 0.0) for i in (900, 901, 902)) and found[None][0] == "aa" and found[903][0] == "cc"
    assert all(0 <= s <= 1 for _, _, s in got) and len(got) == len(rows) + len(odd)
    kept = {r["doc_id"] for r in language_id.with_language(docs, model).collect()}
    assert kept == {i for i, _, _ in rows} | {None, 903}
    assert language_id.with_language(docs, model).columns == docs.columns


def unknown_texts(rng):
    """Texts in no language of the tests: foreign scripts, letters at random, base64."""
    letters = ["абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x5600))), "bcdefghijklmnopqrstuvwxyzBCDEFGHJKLMNPQRSTUVWXYZ"]
    texts = [" ".join("".join(rng.choices(a, k=rng.randint(3, 9))) for _ in range(n)) for a in letters for n in (12, 60, 3000)]
    return texts + [base64.b64encode(rng.randbytes(n)).decode() for n in (300, 5000)]


def test_texts_in_no_known_language_are_rejected(spark, make_docs):
    rng = random.Random(9)
    parts = {"aa": ["ka", "to", "mi", "ru", "shi", "no"], "bb": ["sch", "ein", "ung", "ver", "ich", "mit"], "cc": ["é", "eau", "ou", "tion", "que", "la"]}
    text = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(n))
    known = [text(lang, n) for lang in parts for n in (1, 2, 3, 10, 100, 20000)] + [text("aa", 50) + " " + text("cc", 50)]
    unknown = unknown_texts(rng)
    for labelled in (["aa", "bb", "cc"], ["aa"]):
        rows = [(k, text(lang, rng.randint(3, 60)), lang) for k in range(200) for lang in [rng.choice(labelled)]]
        rows.append((200, unknown[0], "aa"))  # one wrong label teaches nothing
        model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=300, n_landmarks=40)
        right = known if len(labelled) == 3 else known[:6]
        kept = [r["doc_id"] for r in language_id.with_language(make_docs(right + unknown), model).collect()]
        assert sorted(kept) == list(range(len(right)))


def test_one_labelled_text_rejects_nothing(spark, make_docs):
    docs = make_docs(["some words", "other text", "αβγ"])
    assert language_id.with_language(docs, language_id.train(docs.limit(1))).count() == 3


def test_no_labelled_rows_no_model(spark, make_docs):
    docs = make_docs(["some words", None]).withColumn("lang", F.lit(None).cast("string"))
    assert language_id.train(docs) is None
    assert [tuple(r) for r in language_id.identify(docs, None).orderBy("doc_id").collect()] == [(0, "und", 0.0), (1, "und", 0.0)]


def test_kernel_is_shared_ngrams_over_the_root_of_the_product():
    rng = np.random.default_rng(0)
    there = rng.random((30, 1 << language_id.PLACES)) < 0.01
    model = language_id.fit(np.packbits(there, axis=1), ["a", "b", "c"] * 10, n_landmarks=12)
    kernel = model.kernel(there[:4])
    marks = model.landmarks.T.astype(bool)
    expected = [[(x & m).sum() / np.sqrt(x.sum() * m.sum()) for m in marks] for x in there[:4]]
    assert np.allclose(kernel, expected, atol=1e-5)


# --- nearest neighbours -------------------------------------------------------------------


def recall(spark, vectors, k=5, **settings):
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    index = ann.build(table, **settings)
    got = defaultdict(list)
    for r in ann.nearest(index, F.col("vec_id") % 50 == 0, k).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in (i for i in vectors if i % 50 == 0):
        best = brute.nearest(vectors, q, k)
        assert len(got[q]) == len(best) and q not in dict(got[q])
        hits += sum(s >= best[-1][1] - 1e-12 for _, s in got[q])
        total += len(best)
    return hits / total


def test_recall_over_several_runs_and_rounds(spark):
    rng = np.random.default_rng(2)
    vectors = {k: rng.standard_normal(24).tolist() for k in range(1500)}
    assert recall(spark, vectors, width=16, rounds=4) >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    same = [1.0, 2.0, 3.0]
    rows = [(k, same) for k in range(0, 40)] + [(100 + k, rng.standard_normal(3).tolist()) for k in range(20)]
    odd = [(200, None), (250, [0.0, 0.0, 0.0]), (300, [1.0, None, 2.0]), (350, [1.0, float("nan"), 2.0]), (400, [1.0, float("inf"), 2.0]), (450, [1.0]), (500, []), (None, same)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    index = ann.build(table)
    got = defaultdict(list)
    for r in ann.nearest(index, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    assert set(got) == {0, 100}
    assert got[0] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    exact = brute.nearest(dict(rows), 100, 5)
    assert [v for _, v in got[100]] == [v for v, _ in exact]


def test_very_small_and_very_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(20, 4)))]
    rows += [(50, [1e-200] * 4), (51, [1e200, 1e200, 1.0, 1.0]), (52, [1e200, 1e200, 1.0, 1.1]), (53, [5e-324, 0.0, 0.0, 0.0]), (54, [1.7e308, 1.7e308, -1.7e308, 1.0]), (55, [1.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(ann.build(table), F.lit(True)).collect()
    best = {r["query_id"]: (r["vec_id"], r["score"]) for r in got if r["rank"] == 1}
    assert len(best) == len(rows) and len(got) == 5 * len(rows) and all(abs(r["score"]) <= 1 + 1e-12 for r in got)
    assert best[50] == (55, pytest.approx(1.0)) and best[51] == (52, pytest.approx(1.0)) and best[52][0] == 51


def test_short_texts_are_taken_some_at_a_time():
    texts = pa.array(["", "a", None, "bc"] * 300)
    got = [(a, b, len(bounds)) for a, b, _, bounds in slices(texts, 256)]
    assert [x[:2] for x in got] == [(0, 256), (256, 512), (512, 768), (768, 1024), (1024, 1200)]
    assert np.array_equal(np.concatenate([language_id.presence(d, t) for _, _, d, t in slices(texts, 7)]), np.concatenate([language_id.presence(d, t) for _, _, d, t in slices(texts)]))


def test_the_fit_is_a_ridge_regression_on_whitened_landmark_kernels():
    texts = ["the cat sat on the mat", "a dog and the cat", "le chat est sur le tapis", "un chien et le chat", "der hund ist hier", "die katze und der hund"]
    langs = ["en", "en", "fr", "fr", "de", "de"]
    (_, _, data, bounds), *_ = slices(pa.array(texts))
    there = language_id.presence(data, bounds)
    model = language_id.fit(np.packbits(there, axis=1), langs, n_landmarks=6, ridge=0.01)
    x = there.astype(float)
    kernel = (x @ x.T) / np.sqrt(np.outer(x.sum(1), x.sum(1)))
    # ridge in the space of the kernel, with a free constant: alpha (K + n ridge) = centred targets
    target = np.where(np.array(langs)[:, None] == np.array(["de", "en", "fr"]), 1.0, -1.0)
    h = np.eye(6) - 1 / 6
    alpha = np.linalg.solve(h @ kernel @ h + 0.06 * np.eye(6), h @ target)
    plain = h @ kernel @ h @ alpha + target.mean(0)
    assert np.allclose(model.scores(there), plain, atol=1e-3)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    table = spark.createDataFrame([(50 * k, [float(k), 1.0]) for k in range(n)], "vec_id long, embedding array<float>")
    got = ann.nearest(ann.build(table), F.lit(True)).collect()
    assert len(got) == n * max(0, n - 1)


# --- main text of pages ------------------------------------------------------------------


@pytest.fixture(scope="module")
def trees():
    return html_text.trained()


def test_held_out_training_pages(trees):
    kept = lost = extra = 0
    for page, main in html_text.training_pages(150, seed=77):
        got = {w for w in html_text.main_text(page, trees).split() if re.fullmatch(r"q\d+z", w)}
        kept, lost, extra = kept + len(got & main), lost + len(main - got), extra + len(got - main)
    assert kept / (kept + lost) > 0.97 and kept / (kept + extra) > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a>News</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this now, it is cheap.</div><article><h1>A  title &amp; more</h1><p><b>Bold first.<br><p>Second&nbsp;paragraph
with <a href="/x">a link</a>, caf&eacute; &#233; and more words to read.</p><p>Short.</p><p>1 &lt; 2</article><div class="comments"><p>I like this article, and will say so at some length here.</p></div>
<footer>&copy; x &middot; All rights.</footer></body></html>"""


def test_a_page(trees):
    assert html_text.main_text(PAGE, trees) == "A title & more Bold first. Second paragraph with a link, café é and more words to read. Short. 1 < 2"


def test_decoding_keeps_no_node_under_a_dropped_one(trees):
    for page, _ in html_text.training_pages(30, seed=3):
        nodes = html_text.parse(page)
        rng = np.random.default_rng(len(page))
        kept = html_text.decode(nodes, rng.standard_normal(len(nodes)) * 3)
        assert all(kept[n.parent] for n, k in zip(nodes, kept, strict=True) if k and n.parent >= 0)


def test_extract(spark, trees):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", "<p>"), (3, "w", "plain words, no markup at all"), (4, "x", "<div>" * 3000 + "deep" + "<p>x" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(pages, trees).collect()
    assert Counter((r["page_id"], r["url"]) for r in got) == Counter((a, b) for a, b, _ in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] in (2, None)} == {""}
    assert html_text.extract(pages.where("false"), trees).collect() == []


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("<a " * 350_000, 1), ('x<a "' * 200_000, 1), ("<b>" * 170_000 + "</i>" * 130_000, 1), ("<thead>" * 100_000 + "<div></div>" * 50_000, 150_001),
        ("<i><div>" + "<b>" * 150_000 + "</i>" * 150_000, 2), ("<script>" + "</script " * 100_000, 1), ('<a "' * 200_001 + "'>", 1), ("<p>" * 100_000, 100_001),
    ],
)
def test_malformed_pages_take_linear_time(page, blocks):
    start = time.monotonic()
    assert len(html_text.parse(page)) == blocks
    assert time.monotonic() - start < 30  # hours with steps that read a page again for each tag


def test_tag_ends_against_a_plain_scan():
    def plain(page, at):
        quote = ""
        for k in range(at, len(page)):
            if quote:
                quote = "" if page[k] == quote else quote
            elif page[k] == ">":
                return k + 1
            elif page[k] in "\"'":
                quote = page[k]
        return -1

    rng = np.random.default_rng(8)
    for _ in range(300):
        page = "".join(rng.choice(list("<>a \"'"), int(rng.integers(0, 60)), p=[0.2, 0.05, 0.3, 0.25, 0.1, 0.1]))
        ends = html_text._TagEnds(page)
        assert [ends.after(k) for k in range(len(page) + 1)] == [plain(page, k) for k in range(len(page) + 1)]


def test_references_out_of_range():
    node = html_text.parse("<p>&#" + "9" * 6000 + "; &#" + "0" * 6000 + "65; &amp;</p>")[1]
    assert "".join(t for t, _ in node.runs) == "� A &"


def test_decoding_against_all_choices():
    """On small trees: no set of nodes closed under parents has a greater total."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 10))
        nodes = [html_text.Node("html", -1, 0)]
        for i in range(1, n):
            up = int(rng.integers(0, i))
            nodes.append(html_text.Node("p", up, nodes[up].depth + 1))
        scores = rng.normal(size=n)
        kept = html_text.decode(nodes, scores)
        total = lambda chosen: sum(s for s, c in zip(scores, chosen) if c)
        closed = lambda chosen: all(not c or node.parent < 0 or chosen[node.parent] for c, node in zip(chosen, nodes))
        choices = ([bool(bits >> i & 1) for i in range(n)] for bits in range(2**n))
        assert closed(kept) and total(kept) == pytest.approx(max(total(c) for c in choices if closed(c)))


def test_questions_in_slices_and_long_flat_pages():
    page = "<body><ul>" + "<li>x</li>" * 90 + "<p>end</p></ul></body>"
    nodes = html_text.parse(page)
    whole = html_text.questions(nodes)
    assert (np.concatenate([html_text.questions(nodes, a, min(a + 7, len(nodes))) for a in range(0, len(nodes), 7)]) == whole).all()
    items = [n for n in nodes if n.tag == "li"]
    assert [n.place for n in items] == list(range(90)) and {n.same for n in items} == {89}
    assert nodes[-1].tag == "p" and nodes[-1].place == 90 and nodes[-1].same == 0
