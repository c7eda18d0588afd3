"""An inverted index in blocks of documents, and exact top-k search that passes over blocks which can't enter.

A block is one row: its documents, its terms, and for each term the documents that hold it, how often, and the largest impact that it has
there. Blocks are made where documents lie, so neither building nor searching shuffles texts, postings or scores: a task answers
all questions on its blocks and sends the best of each question. New documents are new blocks; statistics are sums over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions import text as T
from lodestone.operators.parsing import spread
from lodestone.storage import landed

# The customary parameters of BM25 Okapi.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents and tokens of a block; bytes of questions that go to the tasks at once.
DOCUMENTS, TOKENS, QUESTIONS = 1024, 1 << 19, 8 << 20
#: Blocks of a file of a landed index; a block can have some MB.
FILE = 8
#: Places to which scores are rounded, so that order doesn't hang on the order of sums.
PLACES = 9


def build(docs: DataFrame, label: Column | None = None) -> DataFrame:
    """Blocks of docs (doc_id, text): doc_ids, labels, lengths (tokens), terms, sizes (documents of each term), places, counts.

    label groups documents for searches that want the best of each group; null is a group too. A null text has no tokens.
    """
    doc_id = dict(docs.dtypes)["doc_id"]
    label = F.lit(None).cast("string") if label is None else label.cast("string")
    rows = spread(docs.select("doc_id", F.col("text").cast("string").alias("text"), label.alias("label")))
    rows = rows.select("doc_id", "label", F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = batch["tokens"]
        lengths = np.diff(tokens.offsets.to_numpy())
        coded = tokens.flatten().dictionary_encode()
        place = np.repeat(np.arange(len(lengths)), lengths)
        pairs, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * max(1, len(lengths)) + place, return_counts=True)
        term, place = np.divmod(pairs, max(1, len(lengths)))
        arrays = {"doc_ids": batch["doc_id"], "labels": batch["label"], "lengths": pa.array(lengths, pa.int32()), "terms": coded.dictionary, "sizes": pa.array(np.bincount(term, minlength=len(coded.dictionary)), pa.int32()),
                  "places": pa.array(place, pa.int32()), "counts": pa.array(counts, pa.int32())}
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays.values()], list(arrays))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch["tokens"].offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                to = min(at + DOCUMENTS, max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS, "right")) - 1))
                yield block(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(at, to - at)]) for c in batch.columns], names=batch.schema.names))
                at = to

    schema = f"doc_ids array<{doc_id}>, labels array<string>, lengths array<int>, terms array<string>, sizes array<int>, places array<int>, counts array<int>"
    return rows.mapInArrow(each, schema)


def built(docs: DataFrame, label: Column | None = None, name: str = "text-index") -> DataFrame:
    """The blocks, landed for several passes."""
    return landed(build(docs, label), name, FILE)


def statistics(index: DataFrame) -> DataFrame:
    """One row: n documents and their mean length in tokens."""
    own = index.select(F.size("doc_ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("tokens"))
    return own.agg(F.sum("n").cast("double").alias("n"), (F.sum("tokens") / F.sum("n")).alias("avgdl"))


def frequencies(index: DataFrame) -> DataFrame:
    """term, df, idf: negative values become EPSILON times the mean of all."""
    df = index.select(F.inline(F.arrays_zip("terms", "sizes"))).groupBy(F.col("terms").alias("term")).agg(F.sum("sizes").alias("df"))
    raw = df.join(F.broadcast(statistics(index).select("n"))).withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


class Questions:
    """Weights of terms in questions; terms are numbered."""

    def __init__(self, rows: list[tuple]) -> None:
        self.number: dict[str, int] = {}
        of: dict[object, tuple[list[int], list[float]]] = {}
        for qid, term, weight in rows:
            terms, weights = of.setdefault(qid, ([], []))
            terms.append(self.number.setdefault(term, len(self.number)))
            weights.append(weight)
        self.qids = list(of)
        self.terms = [np.array(t) for t, _ in of.values()]
        self.weights = [np.array(w) for _, w in of.values()]


class Best:
    """The k best (score, id) of a question and label so far: higher scores, then smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.ids = k, np.zeros(0), []

    def floor(self) -> float:
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: list) -> None:
        score, ids = np.concatenate([self.score, score]), [*self.ids, *ids]
        order = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[: self.k]
        self.score, self.ids = score[order], [ids[i] for i in order]


def _parts(asked: DataFrame, weighted: DataFrame) -> Iterator[Broadcast]:
    """Questions with their weights, as many at once as QUESTIONS bytes hold."""
    size = weighted.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    n = max(1, -(-size // QUESTIONS))
    for i in range(n):
        # bounded: questions are dealt by a hash
        rows = weighted.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i).collect()
        # plain rows, as an object of a class could only be read where this package is installed
        yield asked.sparkSession.sparkContext.broadcast([(r.qid, r.term, r.weight) for r in rows])


def search(index: DataFrame, asked: DataFrame, k: int, overlap: bool = False) -> DataFrame:
    """qid, label, doc_id, score, rank: of each question (qid, question) the k best documents of each label, by BM25, ties to the smaller id.

    A term that a question names twice counts twice. With overlap the score is the number of the question's distinct terms that a document holds.
    Only positive scores count, so a question without a known term has no row. Documents without an id are not returned.
    """
    spark = asked.sparkSession
    terms = asked.select("qid", F.explode(T.tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qn"))
    if overlap:
        weighted, avgdl = terms.select("qid", "term", F.lit(1.0).alias("weight")), 1.0
    else:
        weighted = terms.join(frequencies(index), "term").select("qid", "term", (F.col("qn") * F.col("idf")).alias("weight"))
        avgdl = statistics(index).first().avgdl or 1.0
    qid, doc_id = dict(asked.dtypes)["qid"], dict(index.dtypes)["doc_ids"][6:-1]
    kinds = (to_arrow_type(asked.schema["qid"].dataType), pa.string(), to_arrow_type(index.schema["doc_ids"].dataType.elementType), pa.float64())
    found: DataFrame | None = None
    for part in _parts(asked, weighted):

        def each(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            q, best = Questions(part.value), {}
            for batch in batches:
                for row in range(batch.num_rows):
                    get = lambda c: batch[c].slice(row, 1).flatten()  # noqa: B023, E731
                    _answer(q, best, k, avgdl, overlap, *map(get, ("doc_ids", "labels", "lengths", "terms", "sizes", "places", "counts")))
            rows = [(q.qids[i], label, d, s) for (i, label), b in best.items() for s, d in zip(b.score.tolist(), b.ids, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["qid", "label", "doc_id", "score"])

        one = index.mapInArrow(each, f"qid {qid}, label string, doc_id {doc_id}, score double")
        found = one if found is None else found.unionByName(one)
    own = Window.partitionBy("qid", "label").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def _answer(q: Questions, best: dict, k: int, avgdl: float, overlap: bool, doc_ids: pa.Array, labels: pa.Array, lengths: pa.Array, terms: pa.Array, sizes: pa.Array, places: pa.Array, counts: pa.Array) -> None:
    """All questions on one block."""
    n = len(doc_ids)
    at = {q.number[t]: i for i, t in enumerate(terms.to_pylist()) if t in q.number}
    if not at:
        return
    ends = np.cumsum(sizes.to_numpy())
    place, tf = places.to_numpy(), counts.to_numpy().astype(float)
    dl = lengths.to_numpy()[place]
    impact = np.ones(len(place)) if overlap else tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
    ids = doc_ids.to_pylist()
    coded = labels.dictionary_encode()
    names, kind = [*coded.dictionary.to_pylist(), None], coded.indices.fill_null(len(coded.dictionary)).to_numpy()
    kinds = np.unique(kind).tolist()
    of = {t: slice(int(ends[i] - sizes[i].as_py()), int(ends[i])) for t, i in at.items()}
    most = {t: float(impact[s].max()) for t, s in of.items()}
    scores = np.zeros(n)
    named = np.array([i is not None for i in ids])
    for number, (own, weights) in enumerate(zip(q.terms, q.weights, strict=True)):
        have = [(t, w) for t, w in zip(own.tolist(), weights.tolist(), strict=True) if t in of]
        if not have:
            continue
        limit = sum(max(0.0, w * most[t]) for t, w in have)
        if limit <= 0 or len(kinds) == 1 and (b := best.get((number, names[kinds[0]]))) and limit + 1e-7 < b.floor():
            continue  # nothing of this block can enter
        scores[:] = 0
        for t, w in have:
            scores[place[of[t]]] += w * impact[of[t]]
        rounded = np.round(scores, PLACES)
        for c in kinds:
            own_best = best.setdefault((number, names[c]), Best(k))
            may = np.flatnonzero((kind == c) & named & (rounded > 0) & (rounded >= own_best.floor()))
            if len(may) > k:
                least = np.partition(rounded[may], len(may) - k)[len(may) - k]
                above, level = may[rounded[may] > least], may[rounded[may] == least]
                level = sorted(level.tolist(), key=lambda i: ids[i])[: k - len(above)]
                may = np.concatenate([above, np.array(level, np.int64)])
            if len(may):
                own_best.add(rounded[may], [ids[i] for i in may.tolist()])
