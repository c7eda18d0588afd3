"""Listings of companies and the stream of their filings."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import listings as L
from lodestone.streaming import ingest as I


def page(*rows):
    return {a: [r[i] for r in rows] for i, a in enumerate(L.ARRAYS)}


@pytest.fixture
def landed(tmp_path):
    new = page(("0-1", "10-Q", "2024-05-01", "2024-03-31", "q.htm"), ("0-2", "8-K", "2024-04-01", "2024-04-01", "k.htm"), ("0-3", "10-K", "2023-01-05", "", "x.htm"))
    files = [{"name": "p1.json", "filingFrom": "2021-01-01", "filingTo": "2022-12-31"}, {"name": "p2.json", "filingFrom": "2000-01-01", "filingTo": "2019-01-01"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"cik": "0000042", "name": "Ark", "fiscalYearEnd": "0930", "filings": {"recent": new, "files": files}}, indent=1))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"cik": 7, "name": "Bow", "filings": {"recent": page(("1-1", "10-K", "2018-02-01", "2017-12-31", "b.htm")), "files": files}}))
    (tmp_path / "in" / "c.json").write_text(json.dumps({"cik": 9, "name": "New", "fiscalYearEnd": None, "filings": {"recent": page(), "files": []}}))
    (tmp_path / "p1.json").write_text(json.dumps(page(("0-4", "10-K", "2022-03-01", "2021-12-31", "o.htm"), ("0-5", "10-Q", "2021-01-01", "2020-12-31", "p.htm"))))
    return tmp_path


def accessions(rows):
    return [r.accession for r in rows.orderBy("filing_date", "accession").collect()]


def test_listings(spark, landed):
    listed = L.listings(spark, f"{landed}/in")
    assert sorted(map(tuple, L.companies(listed).collect())) == [(7, "Bow", ""), (9, "New", ""), (42, "Ark", "0930")]
    take = lambda since, *forms: L.filings(spark, listed, str(landed), forms, since)
    assert accessions(take("2021-06-01", "10-K", "10-Q")) == ["0-4", "0-1"]  # p2.json does not exist and is not asked for
    assert accessions(take("2023-01-05", "10-K", "10-Q")) == ["0-1"]  # no page: the recent ones reach that day
    assert accessions(take("2021-01-01", "10-Q", "8-K")) == ["0-5", "0-2", "0-1"]
    row = take("2024-01-01", "10-Q").first()
    assert row.source_url == "https://www.sec.gov/Archives/edgar/data/42/01/q.htm" and str(row.report_date) == "2024-03-31"


def test_company_list_and_user_agents(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 42, "ticker": "ark", "title": "Ark"}, "1": {"cik_str": 7, "ticker": "BOW", "title": "Bow"}}))
    assert sorted(map(tuple, L.lookup(spark, f"{tmp_path}/t.json").collect())) == [("ARK", 42, "Ark"), ("BOW", 7, "Bow")]
    assert L.check_user_agent(" Ship Research ann@ships.net ") == "Ship Research ann@ships.net"
    for bad in ("", "Ship Research", "me@example.com", "your-email@ships.net"):
        with pytest.raises(ValueError):
            L.check_user_agent(bad)


def test_a_stream_takes_each_file_once_and_only_what_changes(spark, tmp_path):
    schema = "k string, v long, t string"
    run = lambda: I.ingest(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/cp", "k", "v", "t").awaitTermination()
    put = lambda *rows: spark.createDataFrame(list(rows), schema).write.mode("append").parquet(f"{tmp_path}/in")
    have = lambda: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    put(("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), (None, 1, "n"))
    run()
    first = [("a", 2, "y", False), ("b", 1, "", False), (None, 1, "n", False)]
    assert have() == sorted(first, key=str)
    run()  # nothing came
    put(("a", 1, "late"), ("b", 2, ""), ("c", 5, "z"))
    run()
    assert have() == sorted([*first, ("c", 5, "z", False)], key=str)
    put(("b", 3, "now"), ("a", 2, "same age"))
    run()
    assert have() == sorted([*first, ("c", 5, "z", False), ("b", 3, "now", True)], key=str)


def test_changed_against_a_store(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "k int, t string")
    old = spark.createDataFrame([(1, "a"), (2, "x"), (4, "q")], "k int, t string")
    assert sorted(r.k for r in I.changed(new, old, "k", "t").collect()) == [2, 3, 4]
    assert I.changed(new.where(F.lit(False)), old, "k", "t").count() == 0
