"""Every query of the engine against the same in DuckDB."""

import duckdb
import pytest

from policyframe import queries
from tests.oracle import TABLES, differences


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_same_as_sql(spark, sf_dir, name):
    assert differences(queries.queries()[name](spark, sf_dir), sf_dir, queries.oracle_sql()[name]) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20


def test_groups_beyond_default_limits(spark, sf_dir, tmp_path):
    """1,600,000 rows in 279,977 groups, of which 110,001 are left: more of each than `GroupLimits()` lets pass."""
    for t in set(TABLES) - {"orders"}:
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    key = "CASE WHEN i < 1430000 THEN i % 110000 WHEN i < 1430012 THEN 200000 WHEN i >= 1430025 THEN i END"
    rest = "'F' AS o_orderstatus, 1.5::DOUBLE AS o_totalprice, TIMESTAMP '1995-01-01' AS o_orderdate, '2-HIGH' AS o_orderpriority"
    duckdb.sql(f"COPY (SELECT i AS o_orderkey, {key} AS o_custkey, {rest} FROM range(1600000) t(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    found = queries.queries()["group_having"](spark, str(tmp_path))
    assert found.count() == 110_001
    assert differences(found, str(tmp_path), queries.oracle_sql()["group_having"]) is None
