from __future__ import annotations

import math

import pandas as pd
import pytest
from chains import OTM_ITM, contract, random_chain, rows_of
from compare import formatted_plan

from strikeforge.operators import quality, screens
from strikeforge.operators.verticals import vertical_spreads
from strikeforge.schema import DATASETS
from strikeforge.plans.scan import Strategies
from strikeforge.sources.tables import chain_from_rows


@pytest.fixture(scope="module")
def spreads(spark):
    return vertical_spreads(chain_from_rows(spark, OTM_ITM), ranked=False).cache()


def test_filter_choices_are_sorted_and_not_null(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert [r.c for r in screens.filter_choices(df, "c").collect()] == ["a", "b"]


@pytest.mark.parametrize("choices, kept", [
    (None, ["a", "b"]), ({"c": []}, ["a", "b", None]), ({"c": ["a"]}, ["a"]),
    ({"c": ["x"]}, []), ({"other": ["x"]}, ["a", "b"]),
])
def test_choose(spark, choices, kept):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    found = [r.c for r in screens.choose(df, ["c", "other"], choices).collect()]
    assert sorted(found, key=str) == sorted(kept, key=str)


def test_limits_apply_only_to_columns_that_exist_and_null_fails(spark):
    df = spark.createDataFrame([(30.0, None), (25.0, 30.0), (24.0, 90.0)],
                               "spread_ratio double, credit_yield double")
    assert [r.spread_ratio for r in screens.at_least(df, screens.Thresholds()).collect()] == [25.0]


def test_default_limits_need_a_chain(spark):
    chain = chain_from_rows(spark, OTM_ITM)
    assert screens.default_thresholds(chain) == screens.Thresholds(25, 5, 5, 30)
    assert screens.default_thresholds(chain.limit(0)) == screens.NO_THRESHOLDS
    assert screens.default_thresholds(None) == screens.NO_THRESHOLDS


def test_credit_and_debit_screens(spreads):
    credit = rows_of(screens.credit_spreads(spreads, limits=screens.NO_THRESHOLDS))
    assert len(credit) == 6 and all("Credit" in r["strategy"] for r in credit)
    assert screens.credit_spreads(spreads).isEmpty()
    limits = screens.Thresholds(12, 5, 5, 10)
    assert screens.shown(screens.credit_spreads(spreads, limits=limits)) == 3
    puts = {"strategy": ["Put Debit Spread"]}
    debit = rows_of(screens.debit_spreads(spreads, puts))
    assert [r["spread_ratio"] for r in debit] == pytest.approx([39, 30.6667, 25.5], abs=1e-3)


def test_strategy_counts(spreads):
    rows = [tuple(r) for r in screens.strategy_counts(spreads).collect()]
    assert rows == [(f"{s} Spread", 3) for s in
                    ("Call Credit", "Call Debit", "Put Credit", "Put Debit")]


def test_boards_rank_each_strategy(spark):
    run = Strategies(chain_from_rows(spark, random_chain(21)))
    datasets = {
        "spreads": run.spreads(ranked=False), "iron_condors": run.iron_condors(),
        "iron_butterflies": run.iron_butterflies(ranked=False),
        "strangles": run.strangles(ranked=False), "calendars": run.calendars(ranked=False),
    }
    rows = rows_of(screens.top_boards(datasets, size=4))
    for name, board in screens.BOARDS.items():
        found = sorted((r["place"], r["metric"]) for r in rows if r["board"] == name)
        df = datasets[board.dataset]
        if board.label:
            df = df.filter(df.strategy.contains(board.label))
        values = [r[0] for r in df.select(board.metric).collect()]
        values = sorted(values, key=lambda v: -math.inf if v is None else v, reverse=True)[:4]
        assert found == list(enumerate(values, 1))


def test_screen_filters_reach_the_scan(spark, spreads, tmp_path):
    spreads.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    screen = screens.credit_spreads(stored, {"symbol": ["TEST"]})
    pushed = formatted_plan(screen).split("PushedFilters: ")[1].split("]")[0]
    assert "EqualTo(symbol,TEST)" in pushed and "GreaterThanOrEqual(spread_ratio,25.0)" in pushed
    assert "StringContains(strategy,Credit)" in pushed


def test_quote_quality(spark):
    chain = chain_from_rows(spark, [
        contract(95, "P", 1.0, bid=1.0, ask=1.0, close=1.0),
        contract(90, "P", None, close=1.0, delta=0.1),
        contract(85, "P", 1.0, close=1.0),
    ])
    row = quality.quote_quality(chain).first()
    assert (row.total, row.bid_null, row.mid_null, row.delta_null, row.close_null) == (3, 2, 1, 2, 0)
    assert row.bid_null_pct == pytest.approx(66.6667, abs=1e-3)
    assert row.bids_mostly_missing and row.close_available
    old = quality.quote_quality(chain.drop("close")).first()
    assert old.close_null == 3 and not old.close_available
    empty = quality.quote_quality(chain.limit(0)).first()
    assert empty.total == 0 and empty.bid_null_pct is None and not empty.bids_mostly_missing


def profile(df) -> dict:
    return {r["column"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("seed, rows", [(1, 1), (2, 2), (3, 5), (4, 600)])
def test_describe_agrees_with_pandas(spark, seed, rows):
    data = pd.DataFrame(random_chain(seed, symbols=8)).head(rows)
    df = chain_from_rows(spark, data.astype(object).where(data.notna(), None).to_dict("records"))
    profiled = profile(quality.describe(df))
    assert set(profiled) == set(quality.numeric_columns(df))
    for column in ("strike", "mid", "delta", "open_interest", "underlying_price", "dte"):
        values, found = data[column].astype(float).dropna(), profiled[column]
        assert found["n"] == len(values)
        if not len(values):
            assert found["mean"] is None and found["p50"] is None
            continue
        expected = values.describe()
        assert [found[k] for k in ("mean", "min", "p25", "p50", "p75", "max")] == pytest.approx(
            [expected[k] for k in ("mean", "min", "25%", "50%", "75%", "max")])
        if len(values) > 1:
            assert found["std"] == pytest.approx(expected["std"])


def test_quartiles_equal_the_exact_percentile(spark):
    df = spark.range(200_000).selectExpr(
        "double(pmod(xxhash64(id), 1000003)) AS wide", "double(id % 3) AS few",
        "if(id % 2 = 0, double(id), NULL) AS half")
    found = profile(quality.describe(df))
    for column in df.columns:
        exact = df.selectExpr(*(f"percentile({column}, {q}) AS {n}" for n, q in quality.QUARTILES.items()))
        for name, value in exact.first().asDict().items():
            assert found[column][name] == pytest.approx(value, rel=1e-12)


def test_ranks_are_found_range_by_range(spark):
    """Skewed copies, several groups, ranks between two ranges of values."""
    import random
    rng = random.Random(1)
    held = {g: [round(rng.gauss(0, 1), 3) for _ in range(n)] + [0.5] * m
            for g, n, m in (("a", 4000, 0), ("b", 300, 6000), ("c", 1, 0), ("d", 2, 0))}
    rows = [(g, v, vs.count(v)) for g, vs in held.items() for v in set(vs)]
    counted = spark.createDataFrame(rows, "g string, value double, copies long").repartition(3)
    for share in (0.0, 0.25, 0.5, 0.77, 1.0):
        ranks = {g: (len(vs) - 1) * share for g, vs in held.items()}
        rank = quality.F.element_at(quality.F.create_map(
            *(quality.F.lit(x) for pair in ranks.items() for x in pair)), quality.F.col("g"))
        for n_parts in (1, 13):
            found = quality.around_ranks(counted, ["g"], rank, n_parts).collect()
            for g, vs in held.items():
                vs = sorted(vs)
                for at in {math.floor(ranks[g]), math.ceil(ranks[g])}:
                    assert vs[at] in [r.value for r in found if r.g == g and r.first <= at <= r.last]
    few = quality.around_ranks(counted, ["g"], rank, 13)
    assert few.filter("g = 'a'").count() < len(set(held["a"])) / 4


def test_no_window_holds_a_whole_bracket(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 7D, rand(4)) AS x", "double(id) AS y")
    plan = quality.describe(df)._jdf.queryExecution().analyzed().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("part#" in line for line in windows)
    found = profile(quality.describe(df))
    exact = df.selectExpr(*(f"percentile({c}, {q}) AS {c}_{n}" for c in "xy"
                            for n, q in quality.QUARTILES.items())).first().asDict()
    assert {f"{c}_{n}": found[c][n] for c in "xy" for n in quality.QUARTILES} == pytest.approx(exact)


@pytest.mark.parametrize("rows", [0, 3])
def test_describe_without_any_value(spark, rows):
    df = spark.range(rows).selectExpr("cast(NULL AS double) AS nothing")
    row = quality.describe(df).first()
    assert (row.column, row.n, row["mean"], row.p50, row["max"]) == ("nothing", 0, None, None, None)


def test_null_profile_and_sizes(spark):
    a = chain_from_rows(spark, [contract(95, "P", 1.0, bid=1.0), contract(90, "P", None)])
    b = spark.createDataFrame([(1,)], "x int")
    nulls = {(r.dataset, r.column): r.null_count for r in
             quality.null_profile({"a": a, "b": b}).collect()}
    assert nulls[("a", "bid")] == 1 and nulls[("a", "ask")] == 2
    assert not any(k[0] == "b" for k in nulls) and ("a", "strike") not in nulls
    sizes = {r.dataset: (r.n_rows, r.n_columns) for r in
             quality.dataset_sizes({"a": a, "b": b}).collect()}
    assert sizes == {"a": (2, 18), "b": (1, 1)}
    assert quality.preview(a, 1).count() == 1
    assert ("strike", "double") in quality.column_types(a)
    assert len(DATASETS) == 8
