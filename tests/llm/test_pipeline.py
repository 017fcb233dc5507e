import random

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from tarifflume.llm.queries import ORACLE, QUERIES


def test_names():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "decontamination", "packing"]


def test_stages_against_brute_force(spark, make_docs, tmp_path):
    rng = random.Random(8)
    words = lambda n: [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(500)}x" for _ in range(n)]
    passage, item = words(55), words(30)
    base = words(120)
    texts = [" ".join(words(150)) for _ in range(10)]
    texts += [" ".join(base), " ".join([*base[:50], "new", *base[51:]]), " ".join(words(40) + passage + words(40)), " ".join(words(60) + passage), " ".join(words(80) + item + words(10)), "123 456", None, " ".join(words(4000))]
    docs = make_docs(list(enumerate(texts)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(i, t) for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    label, _ = brute.components(kept, 5, 80)
    kept = [(i, t) for i, t in kept if label[i] == i]
    without = brute.without_repeats(kept, 50)
    kept = [(i, " ".join(without[i])) for i, t in kept]
    bad = {d for d, _ in brute.contained(kept, [(1, " ".join(item))])}
    expected = {i: t for i, t in kept if i not in bad}

    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = current.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, current, str(tmp_path)).write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        assert current.columns == columns, name
    assert {r["doc_id"]: r["text"] for r in current.collect()} == expected
    assert 11 not in expected and 14 not in expected and len(expected[13].split()) == 60
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(expected)


def test_pipeline_without_texts_in_no_known_language(spark, make_docs, tmp_path):
    rng = random.Random(12)
    words = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(n))
    known = [words("aeiourstlnm", n) for n in [2, 3, 5] + [rng.randint(20, 200) for _ in range(57)]]
    unknown = [words(a, n) for a in ("абвгдежзийклмнопрстуф", "αβγδεζηθικλμνξοπ", "bcdfghjkpqvwxyz") for n in (20, 400)]
    docs = make_docs(known + unknown).withColumn("lang", F.when(F.col("doc_id") < len(known), F.col("lang")))
    name, stage = corpus_pipeline.STAGES[0]
    stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / name)).collect()) == list(range(len(known)))
