import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seriesloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", 4, "6g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return session


@pytest.fixture(scope="session")
def sf():
    return SF


def months(n, start="2000-01"):
    import pandas as pd

    return [d.date() for d in pd.date_range(f"{start}-01", periods=n, freq="MS")]


def panel(spark, series, start="2000-01"):
    """A panel from {id: values}."""
    rows = [(i, d, float(v)) for i, values in series.items() for d, v in zip(months(len(values), start), values)]
    return spark.createDataFrame(rows, "id int, ds date, y double")
