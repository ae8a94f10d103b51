import pytest

from quarrylog import queries
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, con, name):
    assert difference(spark, con, queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_split_bytes_is_greedy(spark):
    from quarrylog.operators.sinks import split_by_bytes

    lengths = [3, 4, 2, 20, 1, 1, 5, 9]
    rows = spark.createDataFrame([("s", i + 1, "x" * n) for i, n in enumerate(lengths)], "source_id string, line_no long, raw string")
    part, filled, want = 1, 0, []
    for n in lengths:
        if filled and filled + n + 1 > 10:
            part, filled = part + 1, 0
        filled += n + 1
        want.append(part)
    assert [r.part for r in split_by_bytes(rows, 10).orderBy("line_no").collect()] == want
