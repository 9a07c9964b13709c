"""Registered queries against their SQL."""

from __future__ import annotations

import pytest
from compare import connect, spark_rows, sql_rows

from strikeforge.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    assert spark_rows(QUERIES[name](spark, folder)) == sql_rows(connect(folder), ORACLE_SQL[name])
