import pytest

from quern.queries import ORACLES, QUERIES
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    ours, theirs = compare(spark, QUERIES[name], ORACLES[name], FOLDER)
    assert ours == theirs


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["noise_rows", "noisy_queries", "vital_signs"])
def test_drawn_rows_are_stable(spark, name):
    first, again = (sorted(map(repr, QUERIES[name](spark, FOLDER).collect())) for _ in range(2))
    assert first and first == again
