"""Exact search for many queries: cells that are skipped, and the same answers as the plain scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tabulon.operators import retrieval as R

DIMS = 8


def clustered(spark, n, seed, zero=0, first=0):
    """`n` vectors around twelve centres that lie far apart; the first `zero` have no length."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(7).normal(0, 3, (12, DIMS))
    v = centres[rng.integers(0, 12, n)] + rng.normal(0, 0.05, (n, DIMS))
    v[:zero] = 0
    return spark.createDataFrame([(first + i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>").repartition(4)


def kind(name):
    return T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("distance", T.DoubleType())])


@pytest.mark.parametrize("metric", R.METRICS)
def test_same_as_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(R, "QUERY_BLOCK", 40)
    monkeypatch.setattr(R, "BLOCK_NUMBERS", 64 * DIMS)
    docs, asked = clustered(spark, 700, 1, zero=3), clustered(spark, 90, 2, zero=2, first=5000)
    copies = docs.where("id % 50 = 7").select((F.col("id") + 1000).alias("id"), "v")  # ties go by id
    docs = docs.unionByName(copies)
    found = R.search_cells(docs, asked.withColumnRenamed("id", "query_id"), 6, metric, kind(metric), DIMS, 30).collect()
    mine = {}
    for r in found:
        mine.setdefault(r["query_id"], []).append((r["distance"], r["id"]))
    d_rows, q_rows = docs.collect(), asked.collect()
    x, q = np.array([r["v"] for r in d_rows]), np.array([r["v"] for r in q_rows])
    d = R._distances(x, q, metric)
    for j, r in enumerate(q_rows):
        want = sorted((float(d[i, j]), d_rows[i]["id"]) for i in range(len(d_rows)))[:6]
        got = sorted(mine[r["id"]])[:6]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([a for a, _ in got], [a for a, _ in want])


def test_clusters_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 25)
    docs, asked = clustered(spark, 1200, 3), clustered(spark, 200, 4).withColumnRenamed("id", "query_id")
    pivots = np.array([r["v"] for r in docs.orderBy(F.xxhash64("id")).limit(40).collect()])
    held = R._sorted_into_cells(docs, pivots, "l2sq", DIMS)
    cells = R._described_cells(held, pivots, "l2sq", DIMS)
    assert cells.counts.sum() == 1200
    visits = R._visits(asked.select("query_id", "v", F.lit(1.0).alias("edge")), cells, 5, DIMS)
    left, right = R._sides(held, visits, cells, DIMS)
    everything = 1200 * (200 // 25)
    assert left.count() < everything / 4
    assert right.count() < 200 * len(pivots) / 4


def test_fewer_documents_than_asked_for(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 10)
    docs, asked = clustered(spark, 4, 5), clustered(spark, 30, 6).withColumnRenamed("id", "query_id")
    found = R.search_cells(docs, asked, 9, "l2sq", kind(""), DIMS, 3)
    assert found.count() == 30 * 4


def test_nearest_takes_the_cells(spark, monkeypatch):
    docs, asked = clustered(spark, 500, 8), clustered(spark, 120, 9).withColumnRenamed("id", "query_id").withColumnRenamed("v", "query_vector")
    docs = docs.withColumnRenamed("v", "embedding")
    plain = {(r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in R.nearest(docs, asked, 4).collect()}
    monkeypatch.setattr(R, "QUERY_BLOCK", 20)
    monkeypatch.setattr(R, "FEW_BLOCKS", 0)
    monkeypatch.setattr(R, "CELL_ROWS", 25)
    assert {(r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in R.nearest(docs, asked, 4).collect()} == plain


def test_blocks_where_cells_skip_little(spark, monkeypatch):
    """Vectors without clusters aren't sent to cell after cell; clustered ones still are."""
    monkeypatch.setattr(R, "QUERY_BLOCK", 100)
    monkeypatch.setattr(R, "FEW_BLOCKS", 0)
    monkeypatch.setattr(R, "CELL_ROWS", 25)
    taken = []
    search = R.search_cells
    monkeypatch.setattr(R, "search_cells", lambda *a: taken.append(1) or search(*a))
    rng = np.random.default_rng(11)
    v = rng.normal(0, 1, (600, 24))
    v[500:] = v[:100] * 3.0  # as near as their originals, but for rounding
    v[400:450] = v[0]
    loose = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<double>")
    asked = loose.where("id < 300").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = R.nearest(loose, asked, 5, metric="cosine").collect()
    d = R._distances(v, v[:300], "cosine")
    want = {(j, r + 1, int(i)) for j in range(300) for r, i in enumerate(np.lexsort((np.arange(600), d[:, j]))[:5])}
    assert {(r["query_id"], r["rank"], r["id"]) for r in found} == want and not taken
    R.nearest(clustered(spark, 1500, 3).withColumnRenamed("v", "embedding"), clustered(spark, 200, 4).selectExpr("id AS query_id", "v AS query_vector"), 5).count()
    assert taken


def test_a_row_is_sent_once_for_each_block_of_the_other_side():
    for n in (13_000, 69_000, 830_000):
        parts, chunks = R._block_counts(n, n, 64, 12)
        assert n / parts <= R.BLOCK_NUMBERS / 64 >= n / chunks and parts + chunks <= max(15, 2 + n * 64 * 2 // R.BLOCK_NUMBERS)
        assert parts * chunks >= 36
