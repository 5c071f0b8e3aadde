"""Statistics of many columns: no aggregate is too wide to be compiled, and the answers are those of each column alone."""

import numpy as np
import pandas as pd
import pytest

from tabulon.functions import quantiles as QU
from tabulon.functions.columns import COMPILED_FIELDS, column_groups
from tabulon.operators import stats as S


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def widest_aggregate(df):
    """Most fields (keys and buffers) that an aggregate of the plan hands on."""
    return max(p.output().size() for p in nodes(df._jdf.queryExecution().sparkPlan()) if "Aggregate" in p.nodeName())


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({f"c{i}": rng.normal(i, 1 + i, 300) for i in range(18)})
    pdf["y"] = rng.integers(0, 2, 300)
    return pdf, spark.createDataFrame(pdf), [f"c{i}" for i in range(18)]


def test_groups_hold_every_column_once():
    names = [f"c{i}" for i in range(18)]
    for fields in (1, 6, 8, 12, 17, 500):
        groups = column_groups(names, fields)
        assert sum(groups, []) == names and all(len(g) == 1 or len(g) * fields <= COMPILED_FIELDS for g in groups)
    assert column_groups([], 17) == [[]]


@pytest.mark.parametrize("made", [lambda d, n: S.describe(d, n), lambda d, n: S.describe(d, n, shape=False), lambda d, n: S.t_tests(d, "y", n), lambda d, n: S.anova(d, "y", n)])
def test_aggregates_of_many_columns_compile(wide, made):
    _, df, names = wide
    assert widest_aggregate(made(df, names)) <= 100
    assert sorted(r["variable"] for r in made(df, names).select("variable").collect()) == sorted(names)


def test_many_columns_are_described_like_pandas(wide):
    pdf, df, names = wide
    got = S.describe(df, names).toPandas().set_index("variable").loc[names]
    for field, want in (("mean", pdf[names].mean()), ("std", pdf[names].std()), ("min", pdf[names].min()), ("median", pdf[names].median())):
        np.testing.assert_allclose(got[field], want, rtol=1e-9)
    found = {r["variable"]: r["mutual_information"] for r in S.mutual_information(df, "y", names).collect()}
    alone = {c: S.mutual_information(df, "y", [c]).first()["mutual_information"] for c in ("c0", "c5", "c17")}
    assert len(found) == 18 and all(found[c] == pytest.approx(v) for c, v in alone.items())


def test_sliced_quantiles_of_many_columns_take_them_in_groups(wide, monkeypatch):
    pdf, df, names = wide
    asked, groups = [], QU.column_groups
    monkeypatch.setattr(QU, "column_groups", lambda cols, fields: asked.append(groups(cols, fields)) or asked[-1])
    got = {r["column"]: r for r in QU.quantiles(df, names, [0.25, 0.5, 0.75], sliced=True).collect()}
    assert len(asked) == 1 and len(asked[0]) > 1 and set(got) == set(names)
    for c in names:
        np.testing.assert_allclose(got[c]["q"], np.quantile(pdf[c], [0.25, 0.5, 0.75]), rtol=1e-12)
