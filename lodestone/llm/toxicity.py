"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on at most; every document is scored.
SAMPLE = 4000
SENTENCE, WORD = re.compile(r"[^.!?\n]+"), re.compile(r"[^\W\d_]+")
#: A word's features are itself and its first letters, as some languages build a word from a stem.
PREFIXES = range(3, 8)
#: Words whose features or weights are remembered, texts held as strings at once, and documents counted at once.
REMEMBERED, SLICE, BLOCK = 50_000, 512, 256


def features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in PREFIXES if n < len(word)]]


def _code(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace"))


def remembered(of: Callable[[str], object]) -> Callable[[str], object]:
    """of, with a store of a bounded number of words."""
    return lru_cache(REMEMBERED)(of)


@dataclass
class Model:
    """A sentence's log-odds are the bias plus the weights of the features of its distinct words."""

    weights: dict[str, float]
    bias: float

    def _weight(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def scorer(self) -> Callable[[str], tuple[float, list[tuple[int, int, float]]]]:
        """score() with a store of words of its own, which goes with it."""
        weight = remembered(self._weight)
        return lambda text: self.score(text, weight)

    def sentences(self, text: str, weight: Callable[[str], float] | None = None) -> list[tuple[int, int, float]]:
        """Start, end and log-odds of each sentence."""
        weight, found = weight or self._weight, []
        for m in SENTENCE.finditer(text):
            words = set(WORD.findall(m[0].lower()))
            if words:
                found.append((m.start(), m.end(), self.bias + math.fsum(map(weight, words))))
        return found

    def score(self, text: str, weight: Callable[[str], float] | None = None) -> tuple[float, list[tuple[int, int, float]]]:
        """The probability that some sentence is toxic, and the spans of those likelier toxic than not; if only their sum is, of the likeliest."""
        z = self.sentences(text, weight)
        total = sum(v + math.log1p(math.exp(-v)) if v > 0 else math.log1p(math.exp(v)) for *_, v in z)
        chance = -math.expm1(-total)
        least = min(0.0, max(v for *_, v in z)) if chance >= 0.5 else 0.0
        return chance, [(a, b, 1 / (1 + math.exp(-v))) for a, b, v in z if v > 0 or v == least < 0]


def document_counts(texts: list[str], toxic: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of all features in order, and in how many documents and toxic documents each is."""
    codes_of = remembered(lambda w: [_code(f) for f in features(w)])
    code, total, hits = np.zeros(0, np.uint32), np.zeros(0), np.zeros(0)
    for at in range(0, len(texts), BLOCK):
        own, bad = [], []
        for text, mark in zip(texts[at : at + BLOCK], toxic[at : at + BLOCK]):
            own.append(np.unique(np.array([c for w in set(WORD.findall(text.lower())) for c in codes_of(w)], np.uint32)))
            bad.append(np.full(len(own[-1]), float(mark)))
        ones = np.ones(sum(map(len, own)))
        code, place = np.unique(np.concatenate([code, *own]), return_inverse=True)
        total = np.bincount(place, np.concatenate([total, ones]), len(code))
        hits = np.bincount(place, np.concatenate([hits, *bad]), len(code))
    return code, total, hits


def fit(texts: list[str], toxic: list[int], epochs: int = 300, rate: float = 0.2, decay: float = 2e-5, link: float = 20.0, cap: float = 30.0) -> Model:
    """Maximises the likelihood of the document labels under noisy-or over sentences, by Adam on all documents at once.

    Words are features if their chi-square with the label is at least `link`. The pull of a toxic document
    that no sentence explains is bounded by `cap`, so that wrong labels don't dominate.
    """
    bias, y = -8.0, np.array(toxic, float)
    if y.min(initial=1) == y.max(initial=0):
        return Model({}, bias)
    code, total, hits = document_counts(texts, toxic)
    share, n = y.mean(), len(y)
    chi = (hits - share * total) ** 2 / (share * (1 - share) * total * np.maximum(1 - total / n, 1 / n))
    named = {int(c): i for i, c in enumerate(code[chi >= link])}
    # the bags: of each sentence the chosen features only, so that memory doesn't grow with the texts' words
    vocabulary: dict[str, int] = {}
    word, of_sentence, of_doc = array("i"), array("i"), array("i")

    def chosen(w: str) -> list[int]:
        found = {f: named[c] for f in features(w) if (c := _code(f)) in named}
        vocabulary.update(found)
        return list(found.values())

    chosen = remembered(chosen)
    for d, text in enumerate(texts):
        for sentence in SENTENCE.findall(text):
            if own := set(WORD.findall(sentence.lower())):
                of_word = [i for w in sorted(own) for i in chosen(w)]
                word.extend(of_word)
                of_sentence.extend([len(of_doc)] * len(of_word))
                of_doc.append(d)
    if not vocabulary:
        return Model({}, bias)
    word, of_sentence, of_doc = (np.frombuffer(x, np.int32) for x in (word, of_sentence, of_doc))
    theta = np.zeros(len(named) + 1)
    theta[-1] = bias
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        z = theta[-1] + np.bincount(of_sentence, theta[word], len(of_doc))
        total = np.bincount(of_doc, np.logaddexp(0, z), len(y))
        pull = np.where(y == 1, -np.minimum(1 / np.expm1(np.maximum(total, 1e-9)), cap), 1.0)
        g = pull[of_doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(word, g[of_sentence], len(named)), g.sum())
        grad[:-1] += decay * len(y) * theta[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    kept = {w: float(theta[i]) for w, i in vocabulary.items() if abs(theta[i]) > 0.02}
    return Model(kept, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled documents whose crc32(doc_id as text) mod 5 is not 0, in an order that a hash fixes.

    One task fits on that bounded sample; only the weights reach the driver. Labels without a toxic mark, and
    documents without text, are left out. If ids repeat, rows above `sample` are left out in the order of a hash.
    """
    usable = labels.where(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    chosen = usable.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "toxic").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")
    rows = rows.select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id", "text"), "toxic").limit(sample)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "toxic": []}), *batches])
        got = got.sort_values(["doc_id", "toxic", "text"], kind="stable")
        model = fit(got["text"].tolist(), got["toxic"].astype(int).tolist())
        yield pd.DataFrame({"feature": ["", *model.weights], "weight": [model.bias, *model.weights.values()]})

    learnt = rows.repartition(1).mapInPandas(learn, "feature string, weight double").collect()
    weights = {r["feature"]: r["weight"] for r in learnt}
    return Model(weights, weights.pop("", -8.0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences (start, end, probability) of every document.

    Null and empty texts have no sentence and score 0. Repeated rows are scored alike; a null doc_id counts
    as not held out. An empty table, or labels of one kind only, give scores near 0. Only doc_id and text
    are read, and doc_id is no input of the score.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = model.scorer()
        for part in _slices(batches):
            found = [measure(t or "") for t in part.column("text").to_pylist()]
            spans = [[{"start": a, "end": b, "probability": p} for a, b, p in s] for _, s in found]
            cols = [part.column("doc_id"), part.column("held_out"), pa.array([p for p, _ in found], pa.float64()), pa.array(spans, SPANS)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "offending"])

    kind = dict(docs.dtypes)["doc_id"]
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out)
    schema = f"doc_id {kind}, held_out boolean, score double, offending array<struct<start int, end int, probability double>>"
    return rows.mapInArrow(each, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, with the columns of docs.

    Null and empty texts score 0 and stay; repeated rows stay or go together; a null doc_id, and other columns, have
    no part in it. An empty table gives an empty one.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = model.scorer()
        for part in _slices(batches):
            yield part.filter(pa.array([measure(t or "")[0] < threshold for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
