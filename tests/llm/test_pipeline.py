"""The pipeline's stages against plain Python: on tables with nulls, repeats, empties and clashing columns, and on the smallest given table."""

from collections import Counter

import pytest

import corpus_pipeline
from lodestone.llm import exact_dedup, mixing, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, fp string"
TEXTS = [" ".join(f"{w}{i}" for w in ("sun", "moon", "tree", "lake", "road", "hill", "rain")) for i in range(12)]
ROWS = [
    (1, TEXTS[0], "a"), (2, TEXTS[0].upper(), "b"), (3, TEXTS[1], "a"), (4, None, "a"), (5, "", None), (None, TEXTS[2], "a"), (None, TEXTS[3], "a"), (None, TEXTS[4], "a"),
    (7, TEXTS[5], "b"), (7, TEXTS[6], "b"), (8, TEXTS[7], None), (8, TEXTS[7], None), (9, "word " * 30_000, "b"), (10, TEXTS[8], "c"), (11, TEXTS[9], "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "r", "s", "f") for i, t, s in ROWS], SCHEMA).repartition(3)


def shown(rows):
    return sorted((str(r.doc_id), (r.text or "").lower()) for r in rows)


def test_exact_stage_keeps_one_row_of_each_text(docs):
    want = {}
    for i, t, _ in ROWS:
        key = (t or "").lower()
        want[key] = max([x for x in (want.get(key), i) if x is not None], default=None)
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns and shown(got.collect()) == sorted((str(i), t) for t, i in want.items())


def test_near_stage_keeps_one_row_of_each_component(docs):
    once = exact_dedup.deduplicate(docs)
    prints = {(str(r.doc_id), r.text): simhash.fingerprint((r.text or "").encode()) for r in once.collect()}
    assert min((a ^ b).bit_count() for i, a in enumerate(prints.values()) for b in list(prints.values())[:i]) > 3
    got = simhash.deduplicate(once)
    assert got.columns == docs.columns and shown(got.collect()) == shown(once.collect())


def test_mix_returns_the_words_that_it_plans(docs):
    plan = mixing.mix(docs).collect()
    planned, targets, got = Counter(), {r.source: r.target for r in plan}, Counter()
    for r in plan:
        planned[r.source] += r.taken
    mixed = mixing.mixed_documents(docs)
    texts = {" ".join((t or "").split()) for _, t, _ in ROWS}
    for r in mixed.collect():
        words = r.text.split()
        got[r.source] += len(words)
        assert r.n_chars == len(r.text) and any(t.startswith(" ".join(words)) for t in texts)
    assert mixed.columns == docs.columns and got == planned
    assert all(abs(got[s] - t) <= 1 for s, t in targets.items())


def test_toxic_stage_rejects_by_score_alone(docs):
    model = toxicity.Model({"word": 20.0, "lake": 0.01}, -8.0)
    got = toxicity.reject(docs, model)
    assert got.columns == docs.columns
    assert shown(got.collect()) == sorted((str(i), (t or "").lower()) for i, t, _ in ROWS if "word" not in (t or ""))


def test_each_stage_takes_an_empty_table(docs):
    model = toxicity.Model({}, -8.0)
    for stage in (lambda d: toxicity.reject(d, model), exact_dedup.deduplicate, simhash.deduplicate, mixing.mixed_documents):
        assert stage(docs.where("false")).collect() == []


def test_run(spark, data):
    """run() equals the stages one after the other on tables in memory, and no stage drops what it should keep."""
    docs = now = spark.read.parquet(f"{data}/documents.parquet")
    n = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, data).cache()
        assert now.columns == docs.columns
        n[name] = now.count()
    toxic = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic = 1").collect()}
    assert docs.count() - n["toxicity"] <= max(5, 2 * len(toxic))
    digests = corpus_pipeline.STAGES[-1][1](spark, now, data)
    assert sorted(map(str, digests.collect())) == sorted(map(str, corpus_pipeline.run(spark, data).collect()))
