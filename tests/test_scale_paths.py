"""The plans for large or skewed data give what the small plans give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.functions import ordered, quantiles as QU
from tabulon.functions.distributions import beta_cdf, f_tail
from tabulon.operators import ml as M, retrieval as R, stats as S


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(11)
    n = 4000
    pdf = pd.DataFrame({
        "id": np.arange(n), "g": np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 9, n).astype(str)),
        "x": np.where(rng.random(n) < 0.35, 3.0, np.round(rng.exponential(5, n), 2)), "y": rng.normal(0, 1e6, n), "z": rng.integers(0, 3, n).astype(float)})
    pdf.loc[rng.random(n) < 0.1, "y"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))


@pytest.mark.parametrize("sliced", [False, True])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_equal_numpy(skewed, by, sliced):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.993, 1.0]
    got = {tuple(r[b] for b in by) + (r["column"],): r for r in QU.quantiles(df, ["x", "y", "z"], probs, by, sliced=sliced).collect()}
    groups = pdf.groupby(by) if by else [((), pdf)]
    for key, part in groups:
        for c in ("x", "y", "z"):
            r = got[(*(key if isinstance(key, tuple) else (key,)), c)]
            v = part[c].dropna()
            assert r["n"] == len(v)
            np.testing.assert_allclose(r["q"], np.quantile(v, probs), rtol=1e-12)


def test_sliced_describe_equals_plain(skewed):
    _, df = skewed
    a = S.describe(df, ["x", "y"], ["g"], sliced=False).orderBy("g", "variable").toPandas()
    b = S.describe(df, ["x", "y"], ["g"], sliced=True).orderBy("g", "variable").toPandas()
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


@pytest.mark.parametrize("chunks", [1, 6, 50])
def test_running_total(spark, chunks):
    df = spark.createDataFrame([(k, float(i), i) for k in ("a", "b", None) for i in range(40)], "k string, o double, n int")
    got = ordered.running_total(df, ["k"], "o", "n", "t", chunks).collect()
    assert len(got) == 120 and all(r["t"] == r["n"] * (r["n"] + 1) // 2 for r in got)


@pytest.mark.parametrize("chunks", [None, 9])
def test_spearman_equals_pandas(skewed, chunks):
    pdf, df = skewed
    got = {(r["variable1"], r["variable2"]): r["correlation"] for r in S.spearman(df, ["x", "y", "z"], chunks=chunks).collect()}
    ranks = lambda p: p.rank().corr()  # noqa: E731  scipy is not needed for the definition
    for (a, b), r in got.items():
        both = pdf[[a, b]].dropna()
        assert r == pytest.approx(ranks(both).iloc[0, 1], abs=1e-12)
    assert len(got) == 3


def test_matrix_correlation_equals_aggregate(skewed, monkeypatch):
    pdf, df = skewed
    df = df.repartition(5).withColumn("const", F.lit(2.0)).withColumn("far", F.col("x") + 1e7)
    cols = ["x", "y", "z", "const", "far"]
    plain = {(r[0], r[1]): r[2] for r in S.pearson(df, cols).collect()}
    monkeypatch.setattr(S, "WIDE_PAIRS", 0)
    wide = {(r[0], r[1]): r[2] for r in S.pearson(df, cols).collect()}
    assert plain.keys() == wide.keys()
    for k, v in plain.items():
        assert (v is None and wide[k] is None) or wide[k] == pytest.approx(v, abs=1e-7), k


@pytest.mark.parametrize("share", [0.1, 0.2, 0.5])
def test_split_by_counting_equals_split_by_sorting(skewed, share):
    _, df = skewed
    a = {r["id"]: r["is_test"] for r in M.with_split(df, "g", ["id"], share, sliced=False).collect()}
    b = {r["id"]: r["is_test"] for r in M.with_split(df, "g", ["id"], share, sliced=True).collect()}
    assert a == b
    n = df.groupBy("g").count().collect()
    took = {r["g"]: r["c"] for r in M.with_split(df, "g", ["id"], share, sliced=True).filter("is_test").groupBy("g").agg(F.count("*").alias("c")).collect()}
    assert all(took[r["g"]] == int(r["count"] * share + 0.5) for r in n)


def test_auc_with_ties_and_chunks(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 500), np.round(rng.random(500), 1)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "probability": s}))
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    for chunks in (None, 5):
        assert M.roc_auc(df, chunks=chunks).first()[0] == pytest.approx(want, abs=1e-12)


def brute(docs, queries, k, metric):
    out = set()
    for qid, q in queries:
        d = []
        for i, v in docs:
            v, w = np.array(v), np.array(q)
            if metric == "l2sq":
                x = ((v - w) ** 2).sum()
            else:
                n = np.linalg.norm(v) * np.linalg.norm(w)
                x = 1 - (v @ w / n if n else 0.0)
            d.append((round(x, 9), i))
        out |= {(qid, r + 1, i) for r, (_, i) in enumerate(sorted(d)[:k])}
    return out


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("blocks", [False, True])
def test_nearest_equals_brute_force(spark, monkeypatch, metric, blocks):
    rng = np.random.default_rng(2)
    docs = [(int(i), rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(300)]
    docs += [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(150)] + [(2000, [0.0] * 6)]  # a third are copies, and a zero vector
    queries = [(f"q{i}", rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(7)] + [("copy", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    if blocks:
        monkeypatch.setattr(R, "QUERY_BLOCK", 3)
        monkeypatch.setattr(R, "BLOCK_NUMBERS", 600)
        monkeypatch.setattr(R, "STRIP", 2)
    d = spark.createDataFrame(docs, "id long, embedding array<double>").repartition(6)
    q = spark.createDataFrame(queries, "query_id string, query_vector array<double>")
    got = {(r["query_id"], r["rank"], r["id"]) for r in R.nearest(d, q, 4, metric=metric).collect()}
    assert got == brute(docs, queries, 4, metric)


def test_distributions():
    assert float(f_tail(3.8060930424, 1, 5)) == pytest.approx(0.1085420751, abs=1e-9)
    assert float(beta_cdf(2, 3, 0.5)) == pytest.approx(0.6875)  # a polynomial for whole parameters
    assert float(f_tail(4.0, 2, 10)) == pytest.approx((10 / (10 + 8)) ** 5)
    assert np.isnan(f_tail(np.nan, 1, 5)) and float(f_tail(np.inf, 1, 5)) == 0.0


def test_sub_slices_are_even_with_far_values(spark):
    """One value far from the rest must not send the rest into one part of its slice."""
    df = spark.range(20000).select(F.lit("x").alias("column"), F.lit(0).alias("slice"), F.when(F.col("id") == 7, F.lit(1e200)).otherwise(F.col("id").cast("double")).alias("value"))
    parts = QU.sub_slices(df, ["column", "slice"]).groupBy("_sub").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("_sub").collect()
    assert sum(p["n"] for p in parts) == 20000 and max(p["n"] for p in parts) < 400
    assert all(a["hi"] < b["lo"] for a, b in zip(parts, parts[1:]))
    found = QU.quantiles(df, ["value"], [0.25, 0.5, 1.0], sliced=True).first()
    values = sorted(r["value"] for r in df.select("value").collect())
    # interpolated as 0-based ranks 4999.75, 9999.5, 19999
    assert found["n"] == 20000 and list(found["q"]) == [values[4999] + 0.75 * (values[5000] - values[4999]), (values[9999] + values[10000]) / 2, 1e200]
    by = QU.quantiles(df.withColumn("g", F.when(F.col("value") < 1e199, F.lit("a"))), ["value"], [0.5], ["g"], sliced=True).collect()
    assert {(r["g"], r["n"]): list(r["q"]) for r in by} == {(None, 1): [1e200], ("a", 19999): [sorted(values[:-1])[9999]]}


@pytest.mark.parametrize("chunks", [None, 3])
def test_rank_patterns_cut_and_sort_counts_once(spark, monkeypatch, chunks):
    from tabulon.functions import ordered
    from tabulon.operators import stats

    made, cut = [], ordered.with_chunks
    monkeypatch.setattr(ordered, "with_chunks", lambda *a, **kw: made.append(1) or cut(*a, **kw))
    rows = [(float(k * 7 % 11), None if k % 3 == 1 else float(k * 5 % 13), None if k % 4 == 2 else float(k % 6)) for k in range(60)]
    got = {(r[0], r[1]): r[2] for r in stats.spearman(spark.createDataFrame(rows, "a double, b double, c double"), chunks=chunks).collect()}
    assert len(made) == 1
    frame = pd.DataFrame(rows, columns=["a", "b", "c"])
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        both = frame[[x, y]].dropna().rank()
        assert got[x, y] == pytest.approx(both[x].corr(both[y]))
