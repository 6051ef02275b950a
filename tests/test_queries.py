"""Every registered query: against its oracle where it has one, else that it runs and gives rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import duck_rows, spark_rows  # noqa: E402

from lathe.plans import registry  # noqa: E402

SF = "sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = spark_rows(QUERIES[name](spark, f"/root/testdata/{SF}"))
    if name in ORACLES:
        assert got == duck_rows(duck(SF), ORACLES[name])
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["request_id", "rank", "node_id", "path", "name", "kind", "start_line", "end_line"]
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
