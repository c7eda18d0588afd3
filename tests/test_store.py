"""Stores of vectors and metadata filters."""

import pytest
from pyspark.sql import functions as F

from lodestone.sources import filters, store

SCHEMA = "chunk_id string, fiscal_quarter int, text string, embedding array<double>"


@pytest.fixture
def rows(spark):
    return lambda *given: spark.createDataFrame([(k, q, t, [1.0, float(len(t))]) for k, q, t in given], SCHEMA)


def held(spark, root, version=None):
    return sorted((r.chunk_id, r.fiscal_quarter, r.text) for r in store.read(spark, root, version).collect())


def test_an_upsert_twice_is_one(spark, rows, tmp_path):
    root = f"{tmp_path}/s"
    store.upsert(rows(("a", None, "one"), ("b", 3, "two")), root)
    store.upsert(rows(("b", 4, "three"), ("c", None, "x"), ("c", None, "x")), root)
    again = store.upsert(rows(("b", 4, "three"), ("c", None, "x")), root)
    assert again["version"] == 3 and again["rows"] == store.count(spark, root) == 3
    assert held(spark, root) == held(spark, root, 2) == [("a", None, "one"), ("b", 4, "three"), ("c", None, "x")]
    assert held(spark, root, 1) == [("a", None, "one"), ("b", 3, "two")] and store.count(spark, root, 1) == 2
    assert store.upsert(rows(), root)["version"] == 3


def test_the_latest_of_a_key_stays(spark, rows, tmp_path):
    given = rows(("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid"))
    store.upsert(given, f"{tmp_path}/s", order="fiscal_quarter")
    assert held(spark, f"{tmp_path}/s") == [("a", 3, "new")]


def test_a_killed_commit_leaves_the_old_version(spark, rows, tmp_path, monkeypatch):
    root = f"{tmp_path}/s"
    store.upsert(rows(("a", 1, "one")), root)
    for at in ("current", "manifest-2.json"):
        real = store.swap_text
        monkeypatch.setattr(store, "swap_text", lambda s, path, text, at=at, real=real: 1 / 0 if path.endswith(at) else real(s, path, text))
        with pytest.raises(ZeroDivisionError):
            store.upsert(rows(("a", 2, "lost")), root)
        monkeypatch.setattr(store, "swap_text", real)
        assert held(spark, root) == [("a", 1, "one")] and store.manifest(spark, root)["version"] == 1
    store.upsert(rows(("b", 2, "kept")), root)
    assert held(spark, root) == [("a", 1, "one"), ("b", 2, "kept")]


def test_guards(spark, rows, tmp_path):
    root = f"{tmp_path}/s"
    with pytest.raises(FileNotFoundError):
        store.read(spark, root)
    assert store.count(spark, root) == 0
    store.append(rows(("a", 1, "one")), root)
    for bad, said in ((rows(("a", 1, "two")), "already"), (rows(("b", 1, "x"), ("b", 1, "y")), "twice")):
        with pytest.raises(ValueError, match=said):
            store.append(bad, root)
    wide = rows(("d", 1, "x")).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    with pytest.raises(ValueError, match="expected 2-dimensional vectors, got 3"):
        store.upsert(wide, root)
    with pytest.raises(ValueError, match="without a key"):
        store.upsert(rows((None, 1, "x")), root)
    with pytest.raises(ValueError, match="1 chunks but 2 vectors"):
        store.paired(rows(("a", 1, "x")).drop("embedding"), rows(("a", 1, "x"), ("b", 1, "y")).select("chunk_id", "embedding"))
    assert held(spark, root) == [("a", 1, "one")]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(i, i % 7 or None, "xyz"[i % 3]) for i in range(50)], "id long, year int, form string").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    every = [(r.id, r.year, r.form) for r in rows.collect()]
    cases = [
        ({"form": "x"}, lambda i, y, f: f == "x"), ({"year": None}, lambda i, y, f: y is None), ({"year": {"$gte": 2, "$lt": 5}}, lambda i, y, f: y and 2 <= y < 5), (None, lambda *_: True), ({}, lambda *_: True),
        ({"form": "y", "year": {"$ne": 3}}, lambda i, y, f: f == "y" and y != 3), ({"$or": [{"year": {"$in": [1, 6]}}, {"id": {"$gt": 44}}]}, lambda i, y, f: y in (1, 6) or i > 44),
        ({"$and": [{"form": {"$nin": ["x"]}}, {"year": {"$nin": [1, 2]}}, {"id": {"$lte": 30}}]}, lambda i, y, f: f != "x" and y not in (1, 2) and i <= 30),
    ]
    for where, test in cases:
        assert sorted(r.id for r in rows.where(filters.compiled(where)).collect()) == [e[0] for e in sorted(every) if test(*e)], where
    plan = rows.where(filters.compiled({"$and": [{"year": {"$gte": 2}}, {"form": {"$in": ["x", "y"]}}]}))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(year,2)" in plan and "In(form, [x,y])" in plan
    for bad in ({"$not": []}, {"year": {"$like": 1}}, {"$and": []}, {"year": {}}):
        with pytest.raises(ValueError):
            filters.compiled(bad)
