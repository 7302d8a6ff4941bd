"""Every registered query against its oracle statement on the smallest tables."""

import pytest

import __spark_entry__ as entry
from testbed.compare import compare, oracle_connection
from testbed.oracle_views import view_order_is_sound
from testbed.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    # minimum sample sizes leave some reports empty on tables this small
    assert compare(spark, con, name, SF, allow_empty=True) is None


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert view_order_is_sound()


def test_every_inventory_id_is_registered():
    ids = {n.split("_")[0] for n in QUERIES}
    want = ({f"S{i}" for i in range(1, 16)} | {f"P{i}" for i in range(1, 23)} - {"P18", "P21"}
            | {f"J{i}" for i in range(1, 15)} | {f"W{i}" for i in range(1, 21)}
            | {f"A{i}" for i in range(1, 29)} | {f"K{i}" for i in range(1, 5)} | {"U1"}
            | {f"T{i}" for i in range(1, 7)})
    assert want <= ids


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
