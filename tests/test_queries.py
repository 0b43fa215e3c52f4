"""Every query of the library against its SQL, and queries without SQL for their columns."""

from __future__ import annotations

import pytest

from compare import SF, of_spark, of_sql
from lumisonde.plans.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    cols, rows = of_spark(df)
    assert rows
    if name in ORACLE:
        assert (cols, rows) == of_sql(ORACLE[name], SF)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["source", "np", "nn", "auc"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
