"""Language identification by string kernels.

The kernel of two texts is the number of byte n-grams (of `LENGTHS`, blended) present in both,
over the root of the product of their numbers. A Nyström map through landmark texts turns it into
a few hundred features; one-versus-rest kernel ridge regression on them gives a score for each
language. A batch of texts is scored by two matrix products: presence x landmarks, then weights.

The scores compare languages with each other: over C languages their regression values sum to 2 - C
for any text, so some language always has 1/C or more. Whether a text is in the winner's language
at all is told by its n-grams: how many of them several labelled texts of that language hold too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflume.llm.common import ship, slices

#: Lengths of the n-grams, and log2 of the places that they are hashed to.
LENGTHS, PLACES = (1, 2, 3, 4), 14
#: Texts that are taken at once, however short: a row of presence takes 5 bytes a place with its floats.
ROWS = 256
#: Share of a language's labelled texts, and number, that make an n-gram one of the language.
COMMON, SEVERAL = 0.005, 2
#: A text is rejected under `NEAR` (with the n-grams of all languages, `NEAR_ALL`) of what all but
#: `STRAY` of the winner's labelled texts reach.
NEAR, NEAR_ALL, STRAY = 0.6, 0.85, 0.05

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def presence(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts x places: whether an n-gram of the place occurs. ASCII letters in lower case; other ASCII is space."""
    folded = _FOLD[data].astype(np.uint64)
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F)) + 1 if len(data) > 1 else np.zeros(0, int)
    folded[upper] += np.uint64(0x20)
    out = np.zeros((len(bounds) - 1, 1 << PLACES), bool)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    code = np.zeros(len(data), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        code = (code[: len(data) - n + 1] << np.uint64(8)) | folded[n - 1 :] if len(data) >= n else code[:0]
        if n in LENGTHS and len(code):
            inside = text[: len(code)] == text[n - 1 :]
            place = ((code + np.uint64(n << 40)) * _MIX) >> np.uint64(64 - PLACES)
            out[text[: len(code)][inside], place[inside].astype(np.int64)] = True
    return out


def has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    classes: list[str]
    landmarks: np.ndarray  # places x landmarks, 0 or 1
    roots: np.ndarray  # root of each landmark's number of n-grams
    weights: np.ndarray  # landmarks x classes
    bias: np.ndarray
    common: np.ndarray  # classes x places: whether the n-gram is one of the language
    usual: np.ndarray  # by class, the affinity that its labelled texts have at least; -inf if they share nothing

    def kernel(self, there: np.ndarray) -> np.ndarray:
        x = there.astype(np.float32)
        return (x @ self.landmarks) / (np.sqrt(np.maximum(x.sum(1), 1))[:, None] * self.roots)

    def kernel_of(self, bits: np.ndarray) -> np.ndarray:
        """The kernel of texts given as packed bits, some at a time."""
        parts = [self.kernel(np.unpackbits(bits[a : a + 128], axis=1)) for a in range(0, len(bits), 128)]
        return np.concatenate(parts)

    def scores(self, there: np.ndarray) -> np.ndarray:
        return self.kernel(there) @ self.weights + self.bias

    def rejects(self, there: np.ndarray, winner: np.ndarray) -> np.ndarray:
        """Whether each text is too far from the language that won, and from all of them together (as texts in two are not)."""
        usual = self.usual[winner]
        return (affinity(there, self.common[winner]) < NEAR * usual) & (affinity(there, self.common.any(0)) < NEAR_ALL * usual)


def affinity(there: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The share of a text's n-grams that are in `common`, beyond chance: 1 if all are, about 0 for n-grams at random.

    It does not fall with the length of a text, as the kernel's values do. `common` has a row for each text, or one row.
    """
    chance = np.minimum(common.mean(-1), 0.99)
    return ((there & common).sum(1) / np.maximum(there.sum(1), 1) - chance) / (1 - chance)


def ranges(bits: np.ndarray, of: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """`common` and `usual` of the classes: each labelled text is measured by the others of its language.

    A language whose texts share nothing, as one with a single text, rejects nothing.
    """
    common, usual = np.zeros((n_classes, bits.shape[1] * 8), bool), np.full(n_classes, -np.inf)
    for c in range(n_classes):
        own = bits[of == c]
        parts = [own[a : a + 128] for a in range(0, len(own), 128)]
        counts = sum(np.unpackbits(part, axis=1).sum(0, dtype=np.int64) for part in parts)
        needed = lambda n: max(SEVERAL, int(np.ceil(COMMON * n)))
        common[c] = counts >= needed(len(own))
        values = []
        for part in parts:
            there = np.unpackbits(part, axis=1).astype(bool)
            values.append(affinity(there, counts - there >= needed(len(own) - 1)))
        low = np.quantile(np.concatenate(values), STRAY)
        if low > 0:
            usual[c] = low
    return common, usual


def fit(bits: np.ndarray, langs: list[str], n_landmarks: int = 256, ridge: float = 1e-3) -> Model:
    """Rows of presence, packed to bits, and their languages. Landmarks are dealt evenly over the languages."""
    classes = sorted(set(langs))
    of = np.array([classes.index(x) for x in langs])
    turn = np.zeros(len(of), np.int64)
    for c in range(len(classes)):
        turn[of == c] = np.arange(int((of == c).sum()))
    marks = np.lexsort((of, turn))[:n_landmarks]
    chosen = np.unpackbits(bits[marks], axis=1).astype(np.float32)
    roots = np.sqrt(np.maximum(chosen.sum(1), 1)).astype(np.float32)
    model = Model(classes, np.ascontiguousarray(chosen.T), roots, np.zeros((len(marks), len(classes)), np.float32), np.zeros(len(classes), np.float32), *ranges(bits, of, len(classes)))
    values, vectors = np.linalg.eigh(model.kernel_of(bits[marks]).astype(np.float64))
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    features = model.kernel_of(bits).astype(np.float64) @ whiten
    target = np.where(of[:, None] == np.arange(len(classes)), 1.0, -1.0)
    # every language weighs the same, however many texts it has
    weight = (len(of) / (len(classes) * np.bincount(of, minlength=len(classes))))[of][:, None]
    mean, center = (weight * features).sum(0) / weight.sum(), (weight * target).sum(0) / weight.sum()
    f, t = features - mean, target - center
    beta = np.linalg.solve(f.T @ (weight * f) + ridge * weight.sum() * np.eye(f.shape[1]), f.T @ (weight * t))
    model.weights = (whiten @ beta).astype(np.float32)
    model.bias = (center - mean @ beta).astype(np.float32)
    return model


def train(labelled: DataFrame, sample: int = 4000, n_landmarks: int = 256, ridge: float = 1e-3) -> Model | None:
    """Fits on `sample` distinct (text, lang) at most, those of least hash.

    Rows without language or letters are left out; without any row there is no model. What
    reaches the driver is a bit for each place of each sampled text, not the texts.
    """
    ship(labelled.sparkSession)

    def build(batches):
        for batch in batches:
            texts, langs, bits = batch.column(0), batch.column(1).to_pylist(), []
            for _, _, data, bounds in slices(texts, ROWS):
                bits += [np.packbits(row).tobytes() for row in presence(data, bounds)]
            good = [i for i, t in enumerate(texts.to_pylist()) if has_letters(t)]
            yield pa.RecordBatch.from_arrays([pa.array([bits[i] for i in good], pa.binary()), pa.array([langs[i] for i in good], pa.string())], ["bits", "lang"])

    rows = labelled.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("text", "lang").alias("h"))
    last = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    least = rows.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).select("text", "lang")
    found = sorted((r["lang"], bytes(r["bits"])) for r in least.mapInArrow(build, "bits binary, lang string").collect())
    if not found:
        return None
    bits = np.frombuffer(b"".join(b for _, b in found), np.uint8).reshape(len(found), -1)
    return fit(bits, [lang for lang, _ in found], n_landmarks, ridge)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for each row of `docs`, from the whole text alone.

    The score is the winner's regression value, brought from -1..1 to 0..1 and clipped; ties go to
    the first language by name. A text that is null or has no letters is `und` with score 0, as
    is every text where there is no model. Null and repeated doc_ids are rows like any other.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # places x landmarks floats at most

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = batch.column(1)
            letters = np.array([has_letters(t) for t in texts.to_pylist()], bool)
            langs, scores = np.full(len(letters), "und", object), np.zeros(len(letters))
            for a, b, data, bounds in slices(texts, ROWS):
                some = np.flatnonzero(letters[a:b])
                if own is None or not len(some):
                    continue
                found = own.scores(presence(data, bounds)[some])
                langs[a + some] = np.array(own.classes, object)[found.argmax(1)]
                scores[a + some] = np.clip((found.max(1) + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its doc_id, as text, leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def with_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of `docs`, all columns, but for those that `identify` calls `und` or that are in no known language
    (`Model.rejects`). Where there is no model, only texts without letters go.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = batch.column(at)
            kept = np.array([has_letters(t) for t in texts.to_pylist()], bool)
            for a, b, data, bounds in slices(texts, ROWS):
                if own is not None:
                    there = presence(data, bounds)
                    kept[a:b] &= ~own.rejects(there, own.scores(there).argmax(1))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
