"""Every query with an SQL counterpart gives the same rows, on the smallest tables."""

import pytest

from tests.oracle import compare, connect
from trustlake.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SLOW = {"detection_distance", "match_boxes"}
# Nothing of the kind occurs in so small a table.
MAY_BE_EMPTY = {"asymmetric_confusion", "class_outliers", "targeted_classes", "selective_drop", "perturbed_drop", "modified_layers", "evidence_page"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    result = compare(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert result is None or (result == "EMPTY" and name in MAY_BE_EMPTY), result


def test_every_query_has_sql_except_assignment():
    assert set(QUERIES) - set(ORACLES) == SLOW
