"""Registered queries: they cover the inventory, match their SQL on the smallest tables, and the package ships itself."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from tabulon.plans import chains
from tabulon.workload.tables import workforce

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
INVENTORY = {"SRC": [1, 2, 3, 4, 5], "SNK": [1, 2, 4, 5], "CLN": range(1, 8), "VAL": range(1, 7), "QLT": [1, 2, 3, 4, 5, 6, 8], "IMP": range(1, 10), "OUT": range(1, 4),
             "FE": range(1, 19), "SEL": range(1, 4), "ST": [*range(1, 12), 13, 14], "AGG": range(1, 9), "RSK": [1], "ML": [*range(1, 15), 16], "INS": range(1, 16),
             "RAG": range(1, 15), "CNV": range(1, 9), "OP": [1, 2]}


def test_inventory_is_covered():
    want = {f"{p}-{n:02d}" for p, ns in INVENTORY.items() for n in ns}
    assert len(want) == 138 and want <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return float(v) if isinstance(v, int) else None if v is None else str(v)


@pytest.mark.parametrize("key", ["CLN-07", "VAL-06-report", "QLT-03", "IMP-01", "OUT-01-target", "IMP-06", "SRC-03", "FE-18", "SEL-03", "ST-01-sliced", "ST-04", "ST-07",
                                 "AGG-02", "AGG-07", "RSK-01", "INS-13", "RAG-01", "RAG-02", "RAG-04", "CNV-04", "CNV-08", "ML-02-sliced", "ML-08", "OP-01"])
def test_query_matches_sql(spark, con, key):
    df = entry.queries()[key](spark, SF)
    cur = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
    want = order([tuple(plain(x) for x in r) for r in cur.fetchall()])
    got = order([tuple(plain(r[n]) for n in names) for r in df.collect()])
    assert got == want


def test_flagship_runs(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("level", chains.LEVELS)
def test_preset_chains(spark, level):
    done = chains.run(workforce(spark, SF).drop("hire_date"), "attrition", "employee_id", level)
    kinds = {r["insight_type"] for r in done.insights.select("insight_type").distinct().collect()}
    assert kinds <= {"risk", "trend", "recommendation", "impact", "predictive"}
    assert "mostly_missing" not in done.table.columns
    assert (done.model is None) == (level == "basic")
    if done.model is not None:
        assert set(done.predictions.columns) >= {"employee_id", "risk_level"}


def test_tasks_do_not_need_the_package_installed():
    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as e; from tabulon.session import local_session; s = local_session(2);"
            "print('rows', len(e.queries()['RAG-04'](s, %r).collect()), len(e.queries()['RAG-01-separators'](s, %r).collect()) > 0)") % (os.path.abspath(ROOT), SF, SF)
    done = subprocess.run([sys.executable, "-c", code], cwd="/tmp", capture_output=True, text=True, timeout=240)
    assert "rows 50 True" in done.stdout, done.stderr[-2000:]
