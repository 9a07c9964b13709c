"""How work is laid out: nothing is sorted before it is narrow, stored twice or shuffled twice."""

from __future__ import annotations

import os
from datetime import date, timedelta
from functools import partial

import pytest

import __spark_entry__ as entry
from strikeforge.operators import ingest
from strikeforge.operators.calendars import calendars
from strikeforge.operators.pairing import Layout, lay_out
from strikeforge.plans import scan
from strikeforge.schema import CONTRACT_KEY, RAW_CONTRACT_KEY
from strikeforge.sources import bridge
from strikeforge.sources.tables import chain_from_rows


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.range(3000).selectExpr(
        "id AS l_orderkey", "if(id % 11 = 0, NULL, id * 7 % 50) AS l_partkey", "id % 4 AS l_suppkey",
        "int(id % 7) + 1 AS l_linenumber", "double(id % 50) AS l_quantity", "double(id) AS l_extendedprice",
        "id % 10 / 100D AS l_discount", "id % 9 / 100D AS l_tax", "if(id % 3 = 0, 'R', 'N') AS l_returnflag",
        "if(id % 2 = 0, 'O', 'F') AS l_linestatus", "timestamp_seconds(id % 100 * 86400) AS l_shipdate",
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(4).selectExpr("id AS s_suppkey").write.parquet(f"{folder}/supplier.parquet")
    return entry.Tables(spark, folder)


def test_ticks_are_dealt_before_they_are_sorted(tables):
    latest = tables.latest()
    plan = plan_of(latest)
    assert plan.rindex("Sort [") < plan.rindex("Exchange") and "REBALANCE" in plan
    plain = ingest.latest_quotes(bridge.ticks(tables.table("lineitem")), bridge.NEWEST_BY)
    assert latest.exceptAll(plain).isEmpty() and plain.exceptAll(latest).isEmpty()


def test_any_ticks_are_dealt_by_the_reduction(spark, tables, tmp_path):
    plain = bridge.ticks(tables.table("lineitem"))
    assert "REBALANCE" not in plan_of(plain)
    plain.write.parquet(str(tmp_path / "landed"))
    latest = ingest.latest_quotes(spark.read.parquet(str(tmp_path / "landed")), bridge.NEWEST_BY)
    plan = plan_of(latest)
    assert plan.rindex("Sort [") < plan.rindex("Exchange hashpartitioning(_cell") and "REBALANCE" in plan
    assert latest.count() == plain.select(*RAW_CONTRACT_KEY).distinct().count() > 0


def test_a_universe_is_not_broadcast(spark, tables):
    wanted = spark.createDataFrame(
        [("SYM0001", date(2026, 4, 17), 85.0, "C")], "symbol string, expiration date, strike double, right string"
    )
    chain = tables.chain(universe=wanted)
    (join,) = (line for line in plan_of(chain).splitlines() if "LeftSemi" in line)
    assert "SortMergeJoin" in join
    expected = tables.chain().filter("symbol = 'SYM0001' AND dte = 16 AND strike = 85 AND right = 'C'")
    assert chain.collect() == expected.collect()


def test_calendars_by_tasks_shuffle_each_side_once(spark):
    strikes = (0.0, -0.0, 100.0, 102.5, float("nan"))
    chain = chain_from_rows(spark, [
        dict(symbol="AAA", expiration=date(2026, 4, 17) + timedelta(days=14 * i), strike=k, right="C", mid=1.0 + i,
             underlying_price=100.0, dte=16 + 14 * i)
        for i in range(4) for k in strikes
    ])
    dealt = calendars(chain, layout=Layout(tasks=5), ranked=False)
    joined = plan_of(dealt)
    assert joined.count("REPARTITION_BY_NUM") == 2 and joined.count("Exchange hashpartitioning") == 2
    seen = lambda df: sorted(str([abs(v) if isinstance(v, float) else v for v in r]) for r in df.collect())
    plain = calendars(chain, ranked=False)
    assert dealt.columns == plain.columns and seen(dealt) == seen(plain) and dealt.count() == 6 * 7


def test_repeated_contracts_are_paired_by_tasks(tables, monkeypatch):
    plain = entry.spreads_of_repeats(tables)
    monkeypatch.setattr(entry, "lay_out", partial(lay_out, tile=3))
    dealt = entry.spreads_of_repeats(tables)
    assert "REPARTITION_BY_NUM" in plan_of(dealt)
    assert plain.count() > 0
    assert dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty()


def test_a_stored_chain_is_not_stored_again(spark, tables, tmp_path, monkeypatch):
    chain = tables.strategies().chain
    assert chain.select(*CONTRACT_KEY).count() > 0
    first = scan.run_scan(spark, chain, str(tmp_path / "first"))
    stored = []
    monkeypatch.setattr(scan.Stage, "write", lambda self, name, df, order=(): stored.append(name))
    assert scan.run_scan(spark, chain, str(tmp_path / "second"), stored=True) == first
    assert "chain" not in stored
    assert scan.run_scan(spark, chain.limit(0), str(tmp_path / "third"), stored=True) == {}
    assert not os.path.exists(tmp_path / "third")
    assert all(".zstd." in f for f in os.listdir(tmp_path / "first" / "spreads") if f.endswith(".parquet"))
