"""One answer whatever the plan: nulls and ties in the order, constant columns, tied split keys, ragged vectors; and names, payloads, limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import ordered
from tabulon.operators import clean, features, ml, retrieval, stats
from tabulon.sources import readers, writers


@pytest.mark.parametrize("chunks", [1, 3, 7])
def test_rows_without_an_order_value_come_first(spark, chunks):
    rows = [(1, None, 7.0), (1, 1, None), (1, 2, None), (1, 3, 5.0), (1, 4, None), (1, float("nan"), None), (2, None, None), (2, 5, 2.0), (2, 6, None), (2, 9, 8.0)]
    df = spark.createDataFrame([(a, None if b is None else float(b), c) for a, b, c in rows], "k int, t double, v double")
    values = lambda d: [r["v"] for r in d.orderBy("k", "t").collect()]
    assert values(ordered.carry_forward(df, ["v"], "t", ["k"], backfill=True, chunks=chunks)) == [7, 7, 7, 5, 5, 5, 2, 2, 2, 8]
    assert values(ordered.interpolate(df, ["v"], "t", ["k"], chunks=chunks)) == [7, pytest.approx(19 / 3), pytest.approx(17 / 3), 5, 5, 5, None, 2, 5, 8]


@pytest.mark.parametrize("wide", [0, 10**6])
def test_a_constant_has_no_correlation(spark, monkeypatch, wide):
    monkeypatch.setattr(stats, "WIDE_PAIRS", wide)
    rng = np.random.default_rng(1)
    rows = [(1e8 / 3, float(x), float(x + rng.normal()), 1e8 / 3 if k % 3 else None, float(k) if k % 3 == 0 else 2.5) for k, x in enumerate(rng.normal(size=500))]
    df = spark.createDataFrame(rows, "c double, x double, y double, d double, e double").repartition(5)
    r = {(p["variable1"], p["variable2"]): p["correlation"] for p in stats.pearson(df, ["c", "x", "y", "d", "e"]).collect()}
    assert r["c", "x"] is None and r["c", "d"] is None and r["x", "d"] is None
    assert r["d", "e"] is None  # e varies only where d is missing
    assert r["x", "y"] == pytest.approx(np.corrcoef([a[1] for a in rows], [a[2] for a in rows])[0, 1])


def test_tied_keys_are_split_alike(spark):
    df = spark.createDataFrame([(k, k % 2, k // 6) for k in range(120)] + [(1000 + k, 1, 77) for k in range(20)], "id int, label int, key int")
    sides = [sorted(r["id"] for r in ml.with_split(df, "label", ["id"], key=F.col("key"), sliced=s).where("is_test").collect()) for s in (False, True)]
    assert sides[0] == sides[1] and sides[0]


@pytest.mark.parametrize("block", [1, 2000])
def test_ragged_vectors_are_an_error_that_names_the_row(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    docs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (3, [1.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 1.0]), (8, [0.0, 1.0])], "query_id long, query_vector array<double>")
    with pytest.raises(Exception, match="numbers, not 2"):
        retrieval.nearest(docs, asked, 1).collect()


def test_names_are_unique():
    assert clean.clean_names(["a", "A", "a_2", "$$", "column_4", " a b "]) == ["a", "a_3", "a_2", "column_4", "column_4_2", "a_b"]


def test_payloads_lose_nothing(spark):
    df = spark.createDataFrame([("e", '{"a": 5, "it\'s": 3}'), ("e", '{"a": {"b": 1}}'), ("e", '[{"a": [1, 2]}]')], "endpoint string, body string")
    rows = readers.normalise_payloads(df, "endpoint", "body").collect()
    assert sorted(str(r["a"]) for r in rows) == ["5", "None", "[1,2]"]
    assert sorted(str(r["a.b"]) for r in rows) == ["1.0", "None", "None"] and sorted(str(r["it's"]) for r in rows) == ["3.0", "None", "None"]


def test_given_columns_are_all_used(spark):
    df = spark.createDataFrame([tuple(float(k) for k in range(7))], [f"c{k}" for k in range(7)])
    assert len(features.pairwise_products(df, df.columns).columns) == 7 + 21 and len(features.pairwise_products(df).columns) == 7 + 10
    many = spark.range(150).select(F.concat(F.lit("v"), F.col("id")).alias("t"))
    assert len(features.dummy_columns(many, ["t"]).columns) == 150
    with pytest.raises(ValueError):
        features.dummy_columns(many, ["t"], max_levels=100)


def test_documents_of_white_space_are_not_added(spark):
    have = spark.createDataFrame([(1, "a document")], "id long, content string")
    new = spark.createDataFrame([(2, "\n" * 12), (3, "z" * 12), (3, "b" * 12), (1, "c" * 12)], "id long, content string")
    assert sorted(map(tuple, retrieval.add_documents(have, new).collect())) == [(1, "a document"), (3, "b" * 12)]


def test_last_rows_and_transcripts(spark):
    log = spark.createDataFrame([(k, 1, "q") for k in range(20)], "id long, at int, text string")
    assert [r["id"] for r in retrieval.last_queries(log, "at", 3).collect()] == [0, 1, 2]
    talk = spark.createDataFrame([(1, 0, "user", "one\r\ntwo\nthree")], "conv_id long, turn int, role string, text string")
    assert writers.transcript_lines(talk).first()["value"] == "[0] User: one\\ntwo\\nthree"


def test_search_within_metadata(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0], {"lang": "en"}), (2, [1.0, 0.1], {"lang": "fr"}), (3, [0.0, 1.0], {"lang": "fr"}), (4, [1.0, 0.0], None)], "id long, embedding array<double>, metadata map<string,string>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query_vector array<double>")
    hits = lambda **kw: [r["id"] for r in retrieval.nearest(docs, asked, 5, **kw).orderBy("rank").collect()]
    assert hits() == [1, 4, 2, 3] and hits(filters={"lang": "fr"}) == [2, 3] and hits(filters={"lang": "xx"}) == []
    assert hits(filters={"id": 3}, metadata="none") == [3]
