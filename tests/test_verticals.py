from __future__ import annotations

import random
from collections import defaultdict

import pytest
from chains import OTM, OTM_ITM, contract, keyed, random_chain, rows_of
from compare import formatted_plan
from pyspark.sql import functions as F

from strikeforge.operators.pairing import lay_out, pair_legs
from strikeforge.operators.verticals import VERTICAL_KEYS, iron_condors, vertical_spreads
from strikeforge.schema import RESULT_COLUMNS
from strikeforge.sources.tables import chain_from_rows

PAIR = ("symbol", "expiration", "right", "short_strike", "long_strike")

# strategy, short, long, credit, width, max profit, max loss, ratio, yield, ROC, breakeven, delta
GOLDEN_OTM = [
    ("Call Credit", 105, 110, 70, 5, 70, 430, 14.0, 16.2791, 0.6667, 105.70, 0.12),
    ("Put Credit", 95, 90, 70, 5, 70, 430, 14.0, 16.2791, 0.7368, 94.30, -0.12),
    ("Put Credit", 95, 85, 120, 10, 120, 880, 12.0, 13.6364, 1.2632, 93.80, -0.22),
    ("Call Credit", 105, 115, 115, 10, 115, 885, 11.5, 12.9944, 1.0952, 106.15, 0.22),
    ("Put Credit", 90, 85, 50, 5, 50, 450, 10.0, 11.1111, 0.5556, 89.50, -0.10),
    ("Call Credit", 110, 115, 45, 5, 45, 455, 9.0, 9.8901, 0.4091, 110.45, 0.10),
]
GOLDEN_ITM = [
    ("Call Debit", 105, 95, -400, 10, 600, 400, 40.0, 150.0, 3.8095, 99.00, -0.52),
    ("Put Debit", 95, 105, -390, 10, 610, 390, 39.0, 156.4103, 4.1053, 101.10, 0.52),
    ("Call Debit", 110, 95, -470, 15, 1030, 470, 31.3333, 219.1489, 4.2727, 99.70, -0.64),
    ("Put Debit", 90, 105, -460, 15, 1040, 460, 30.6667, 226.0870, 5.1111, 100.40, 0.64),
    ("Call Debit", 115, 95, -515, 20, 1485, 515, 25.75, 288.3495, 4.4783, 100.15, -0.74),
    ("Put Debit", 85, 105, -510, 20, 1490, 510, 25.5, 292.1569, 6.0, 99.90, 0.74),
]
FIELDS = """strategy short_strike long_strike credit width max_profit max_loss spread_ratio
credit_yield ROC breakeven net_delta""".split()


def golden(row) -> tuple:
    return tuple(row[f] for f in FIELDS)


@pytest.mark.parametrize("chain, expected", [
    (OTM, GOLDEN_OTM), (OTM_ITM, GOLDEN_ITM + GOLDEN_OTM),
])
def test_known_spreads_in_rank_order(spark, chain, expected):
    df = vertical_spreads(chain_from_rows(spark, chain))
    assert df.columns == RESULT_COLUMNS["spreads"]
    rows = rows_of(df)
    ratios = [r["spread_ratio"] for r in rows]
    assert ratios == sorted(ratios, reverse=True)
    found = {golden(r)[:3]: golden(r)[3:] for r in rows}
    assert len(rows) == len(expected)
    for label, short, long, *numbers in expected:
        assert found[(f"{label} Spread", short, long)] == pytest.approx(numbers, abs=1e-4)


def brute_force(chain) -> dict:
    """Pairs by definition: all ordered pairs, then the higher credit of each strike pair."""
    groups = defaultdict(list)
    for c in chain:
        if c["mid"] is not None:
            groups[c["symbol"], c["expiration"], c["right"]].append(c)
    best = {}
    for key, legs in groups.items():
        for s in legs:
            gap = s["strike"] - s["underlying_price"]
            if (gap > 0) if key[2] == "P" else (gap < 0):
                continue
            for l in legs:
                if s["strike"] == l["strike"]:
                    continue
                premium, width = s["mid"] - l["mid"], abs(s["strike"] - l["strike"])
                profit = premium if premium >= 0 else width + premium
                loss = width - premium if premium >= 0 else -premium
                if profit <= 0 or loss <= 0:
                    continue
                pair = (*key, *sorted((s["strike"], l["strike"])))
                row = (premium * 100, s["strike"], l["strike"], profit * 100, loss * 100)
                if pair not in best or row[0] > best[pair][0]:
                    best[pair] = row
    return best


def as_pairs(rows) -> dict:
    return {
        (*(r[k] for k in VERTICAL_KEYS), *sorted((r["short_strike"], r["long_strike"]))): tuple(
            r[f] for f in ("credit", "short_strike", "long_strike", "max_profit", "max_loss")
        )
        for r in rows
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force_and_the_ranked_form(spark, seed):
    chain = random_chain(seed)
    df = chain_from_rows(spark, chain)
    rows = rows_of(vertical_spreads(df, unique_contracts=True, ranked=False))
    assert as_pairs(rows) == brute_force(chain)
    ranked = rows_of(vertical_spreads(df, ranked=False))
    assert keyed(ranked, *PAIR) == keyed(rows, *PAIR)
    twice = rows_of(vertical_spreads(df.union(df), ranked=False))
    assert len(twice) == len(rows) and keyed(twice, *PAIR) == keyed(rows, *PAIR)


def test_large_groups_are_tiled_with_the_same_result(spark):
    chain = chain_from_rows(spark, random_chain(4, symbols=2, expirations=2, strikes=30))
    plain = rows_of(vertical_spreads(chain, ranked=False))
    layout = lay_out(chain, {"v": VERTICAL_KEYS}, tile=5)["v"]
    assert layout.hot.agg({"tiles": "max"}).first()[0] > 2
    tiled = vertical_spreads(chain, layout=layout, unique_contracts=True, ranked=False)
    # The hot groups are stored: each side broadcasts them and is shuffled once, already cut.
    plan = formatted_plan(tiled)
    assert plan.count("Arguments: hashpartitioning") == 2 and "HashAggregate" not in plan
    assert keyed(rows_of(tiled), *PAIR) == keyed(plain, *PAIR)


def test_an_ordinary_chain_is_left_to_spark(spark):
    chain = chain_from_rows(spark, random_chain(5))
    layout = lay_out(chain, {"v": VERTICAL_KEYS})["v"]
    assert layout.hot is None and layout.tasks is None and 0 < layout.largest < 20
    assert lay_out(chain.limit(0), {"v": VERTICAL_KEYS})["v"] == (None, None, 0)


def test_no_task_holds_a_large_group(spark):
    legs = spark.range(3000).selectExpr("'hot' AS g", "id AS k")
    layout = lay_out(legs, {"g": ["g"]}, tile=250)["g"]
    assert (layout.largest, layout.tasks) == (3000, 144)
    pairs = pair_legs(
        legs.selectExpr("g", "k AS a"), legs.selectExpr("g", "k AS b"), ["g"], layout, ["a"], ["b"])
    per_task = pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in per_task) == 3000**2
    assert max(r["count"] for r in per_task) < 3000**2 / 10


def test_repeated_contracts_count_once(spark):
    chain = chain_from_rows(spark, [*OTM, OTM[0]])
    rows = rows_of(vertical_spreads(chain))
    assert len(as_pairs(rows)) == len(rows) == 6


def test_label_follows_strikes_even_with_an_inverted_premium(spark):
    chain = chain_from_rows(spark, [contract(95, "P", 1.0), contract(90, "P", 1.5)])
    (row,) = rows_of(vertical_spreads(chain))
    assert row["strategy"] == "Put Debit Spread"
    assert row["credit"] == pytest.approx(50) and row["short_strike"] == 90
    assert row["net_delta"] is None and row["breakeven"] == pytest.approx(89.5)


def test_other_rights_behave_like_calls_but_have_no_name(spark):
    chain = chain_from_rows(spark, [contract(105, "X", 1.5), contract(110, "X", 1.0)])
    (row,) = rows_of(vertical_spreads(chain))
    assert (row["strategy"], row["short_strike"]) == ("Unknown", 105)


def test_strike_at_the_underlying_may_be_sold(spark):
    chain = chain_from_rows(spark, [contract(100, "P", 3.0), contract(95, "P", 1.0)])
    (row,) = rows_of(vertical_spreads(chain))
    assert row["short_strike"] == 100


def test_scaling_prices_scales_money_and_keeps_ratios(spark):
    scaled = [
        {**c, "strike": c["strike"] * 2, "underlying_price": c["underlying_price"] * 2,
         "mid": c["mid"] * 2} for c in OTM_ITM
    ]
    base = keyed(rows_of(vertical_spreads(chain_from_rows(spark, OTM_ITM))), *PAIR[2:])
    doubled = rows_of(vertical_spreads(chain_from_rows(spark, scaled)))
    assert len(doubled) == len(base)
    for row in doubled:
        old = base[row["right"], row["short_strike"] / 2, row["long_strike"] / 2]
        assert row["spread_ratio"] == pytest.approx(old["spread_ratio"])
        assert row["max_loss"] == pytest.approx(2 * old["max_loss"])


@pytest.mark.parametrize("chain", [OTM, OTM_ITM])
def test_known_condor(spark, chain):
    df = iron_condors(vertical_spreads(chain_from_rows(spark, chain)))
    assert df.columns == RESULT_COLUMNS["iron_condors"]
    (row,) = rows_of(df)
    assert [row[c] for c in RESULT_COLUMNS["iron_condors"][2:]] == pytest.approx(
        [95, 90, 105, 110, 70, 70, 140, 5, 5, 140, 360, 28, 38.8889, 1.4, 94.3, 105.7, 100, 5.7,
         5.7, 44, 0, 0.02, -0.04, 0.10], abs=1e-4)


def test_condor_tie_goes_to_the_narrower_spread(spark):
    # 95/90 and 95/85 have the same ratio of 20 percent.
    chain = [contract(95, "P", 2.5), contract(90, "P", 1.5), contract(85, "P", 0.5),
             contract(105, "C", 2.0), contract(110, "C", 1.0)]
    (row,) = rows_of(iron_condors(vertical_spreads(chain_from_rows(spark, chain))))
    assert (row["put_width"], row["put_short_strike"]) == (5, 90)


def test_condor_needs_both_sides(spark):
    chain = chain_from_rows(spark, OTM[:3])
    assert iron_condors(vertical_spreads(chain)).isEmpty()


def test_condors_against_brute_force(spark):
    rng = random.Random(7)
    chain = random_chain(rng.randrange(1000), symbols=4)
    spreads = vertical_spreads(chain_from_rows(spark, chain), ranked=False)
    sides = defaultdict(list)
    for r in rows_of(spreads):
        if "Credit" in r["strategy"]:
            sides[r["symbol"], r["expiration"], r["right"]].append(r)
    best = {
        key: min(rows, key=lambda r: (
            -r["spread_ratio"], r["width"], r["short_strike"], r["long_strike"]))
        for key, rows in sides.items()
    }
    expected = {
        (s, e): (p["short_strike"], p["long_strike"], best[s, e, "C"]["short_strike"],
                 best[s, e, "C"]["long_strike"], p["credit"] + best[s, e, "C"]["credit"])
        for (s, e, right), p in best.items() if right == "P" and (s, e, "C") in best
    }
    found = {
        (r["symbol"], r["expiration"]): tuple(r[c] for c in (
            "put_short_strike", "put_long_strike", "call_short_strike", "call_long_strike",
            "total_credit"))
        for r in rows_of(iron_condors(spreads))
    }
    assert expected and found == expected
