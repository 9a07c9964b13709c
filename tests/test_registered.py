"""Every registered query against its SQL, and the plans that matter at scale."""

from __future__ import annotations

import pytest
from compare import connect, formatted_plan, spark_rows, sql_rows

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(entry.OPERATORS) <= set(QUERIES) and set(entry.OPERATORS) <= set(ORACLE)
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(entry.OPERATORS))
def test_query_matches_sql(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == sql_rows(duck, ORACLE[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 7781


def test_live_queries_read_a_table_of_part_files(spark, duck, tmp_path):
    for name in ("lineitem", "supplier"):
        whole = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        whole.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    expected = sql_rows(duck, ORACLE["live_chain"])
    assert spark_rows(QUERIES["live_chain"](spark, str(tmp_path))) == expected
    batches = []
    tables = entry.Tables(spark, str(tmp_path))
    merged = entry.replay(tables, lambda df, n: batches.append(n), n_batches=6).current()
    assert spark_rows(entry.ingest.to_quotes(merged, entry.bridge.AS_OF)) == expected
    assert len(batches) >= 6


def test_live_queries_run_over_several_batches_with_late_ticks(spark):
    parts = entry.bridge.in_arrival_order(entry.Tables(spark, SF_DIR).ticks())
    spans = [p.selectExpr("min(ts)", "max(ts)").first() for p in parts]
    assert len(parts) >= 4 and all(later[0] < before[1] for before, later in zip(spans, spans[1:]))


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plan_of(spark, name: str, **options) -> str:
    tables = entry.Tables(spark, SF_DIR)
    strategies = tables.strategies()
    df = getattr(strategies, name)(**options)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, options, exchanges", [
    ("spreads", {"ranked": False}, 2),  # one per join side, none for the mirror pairs
    ("strangles", {"ranked": False}, 2),
    ("calendars", {"ranked": False}, 2),
    ("iron_condors", {}, 3),  # the self-join and one grouped maximum
    ("iron_butterflies", {"ranked": False}, 2),  # straddles and wings; grouping needs none
    ("max_pain_curve", {}, 1),  # expirations; the sums per strike and both passes share it
])
def test_shuffles_without_broadcast(spark, no_broadcast, name, options, exchanges):
    plan = plan_of(spark, name, **options)
    assert plan.count("Exchange hashpartitioning") == exchanges
    assert "BroadcastExchange" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_at_the_money_quotes_come_from_one_hash_aggregate(spark, no_broadcast):
    plan = plan_of(spark, "expected_move")
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("HashAggregate") == 2
    assert "SortAggregate" not in plan and "Window" not in plan and "Join" not in plan


def test_strategies_read_only_their_columns(spark):
    spreads = entry.Tables(spark, SF_DIR).strategies().spreads(ranked=False)
    plan = formatted_plan(spreads)
    assert plan.count("ReadSchema") == 2
    for unread in ("bid", "ask", "last", "close", "volume", "open_interest", "implied_vol"):
        assert f"{unread}:double" not in plan
    assert "IsNotNull(mid)" in plan
