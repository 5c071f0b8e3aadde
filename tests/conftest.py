import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from tabulon.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8, "tests", **{"spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch"))})
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF


def column(df, name, order=None):
    rows = (df.orderBy(order) if order else df).select(name).collect()
    return [r[0] for r in rows]
