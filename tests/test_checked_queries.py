"""Every query with check SQL gives the same rows in DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

from seriesloom import plans  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


def test_checks_name_queries():
    assert set(plans.checks()) <= set(plans.queries())


@pytest.mark.parametrize("name", sorted(plans.checks()))
def test_same_rows(spark, con, sf, name):
    result, _ = check.compare(spark, con, sf, name, plans.queries()[name], plans.checks()[name])
    assert result.startswith("ok"), result
    assert "types" not in result, result
