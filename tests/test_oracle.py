"""Every registered query with an oracle equals its DuckDB SQL at sf0.01."""
import pytest

import __spark_entry__ as E
from check_oracle import compare
from conftest import SF01

NAMES = sorted(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    info = compare(spark, duck, name, E.queries()[name], E.oracle_sql()[name], SF01)
    assert info["status"] == "OK", info
    assert "types" not in info, info


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 20
    assert df.columns[:3] == ["guild", "incidents", "total_seen"]


def test_split_exact_size_on_smallest_data(spark):
    from pyspark.sql import functions as F

    from conftest import SF001
    from moderata.operators import labels as LB
    from moderata.sources import tables as TB
    t = TB.training_frame(spark, SF001).select("id")
    n = t.count()
    s = LB.split_exact(t)
    assert s.where(F.col("split") == "holdout").count() == n // 10
    assert s.count() == n
