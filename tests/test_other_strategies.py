from __future__ import annotations

import math
import random
from collections import defaultdict
from datetime import timedelta

import pytest
from chains import (
    ANALYTICS, BUTTERFLY, CALENDAR, EXPIRY, OTM, STRANGLE, contract, keyed, random_chain, rows_of,
)

from strikeforge.operators.at_the_money import EXPIRATION_KEYS, expected_move, iron_butterflies
from strikeforge.operators.calendars import CALENDAR_KEYS, calendars
from strikeforge.operators.max_pain import max_pain, max_pain_curve
from strikeforge.operators.pairing import lay_out
from strikeforge.operators.strangles import strangles
from strikeforge.schema import RESULT_COLUMNS
from strikeforge.sources.tables import chain_from_rows

SEEDS = [11, 12, 13]


def by_expiration(chain, keep=lambda c: c["mid"] is not None):
    groups = defaultdict(list)
    for c in chain:
        if keep(c):
            groups[c["symbol"], c["expiration"]].append(c)
    return groups


def nearest(legs):
    return min(legs, key=lambda c: (abs(c["strike"] - c["underlying_price"]), c["strike"]))


# ---- strangles


def test_known_strangles(spark):
    df = strangles(chain_from_rows(spark, STRANGLE))
    assert df.columns == RESULT_COLUMNS["strangles"]
    rows = rows_of(df)
    premiums = [r["total_premium"] for r in rows]
    assert premiums == sorted(premiums, reverse=True)
    found = keyed(rows, "put_strike", "call_strike")
    fields = ("total_premium", "lower_breakeven", "upper_breakeven", "ROC", "net_delta")
    for key, expected in {
        (95, 105): (310, 91.9, 108.1, 3.1, 0),
        (92, 105): (250, 89.5, 107.5, 2.5381, 0.1),
        (95, 108): (250, 92.5, 110.5, 2.4631, -0.1),
        (92, 108): (190, 90.1, 109.9, 1.9, 0),
    }.items():
        assert [found[key][f] for f in fields] == pytest.approx(expected, abs=1e-4)
    assert found[95, 105]["breakeven_width"] == pytest.approx(16.2)
    assert found[95, 105]["pct_to_put_strike"] == pytest.approx(5)


def test_strangles_leave_out_the_money(spark):
    chain = [*STRANGLE, contract(100, "P", 3.0), contract(100, "C", 3.0)]
    assert strangles(chain_from_rows(spark, chain)).count() == 4


@pytest.mark.parametrize("seed", SEEDS)
def test_strangles_against_brute_force(spark, seed):
    chain = random_chain(seed)
    expected = {
        (*key, p["strike"], c["strike"]): (p["mid"] + c["mid"]) * 100
        for key, legs in by_expiration(chain).items()
        for p in legs if p["right"] == "P" and p["strike"] < p["underlying_price"]
        for c in legs if c["right"] == "C" and c["strike"] > c["underlying_price"]
    }
    df = chain_from_rows(spark, chain)
    key = ("symbol", "expiration", "put_strike", "call_strike")
    plain = keyed(rows_of(strangles(df, ranked=False)), *key)
    assert {k: r["total_premium"] for k, r in plain.items()} == expected
    layout = lay_out(df, {"e": EXPIRATION_KEYS}, tile=4)["e"]
    assert layout.hot is not None and layout.tasks is not None
    assert keyed(rows_of(strangles(df, layout=layout, ranked=False)), *key) == plain


# ---- calendars


def test_known_calendars(spark):
    df = calendars(chain_from_rows(spark, CALENDAR))
    assert df.columns == RESULT_COLUMNS["calendars"]
    found = keyed(rows_of(df), "right", "strike")
    fields = ("net_debit", "approx_max_profit", "approx_ROC", "theta_differential",
              "iv_differential", "dte_gap")
    expected = {("C", 105): (90, 150, 166.6667, -0.02, 0.02, 34),
                ("P", 95): (80, 140, 175, -0.02, 0.02, 34)}
    assert set(found) == set(expected)
    for key, values in expected.items():
        assert [found[key][f] for f in fields] == pytest.approx(values, abs=1e-4)


@pytest.mark.parametrize("days, pairs", [(6, 0), (7, 1)])
def test_calendars_need_a_week(spark, days, pairs):
    later = {"expiration": EXPIRY + timedelta(days=days), "dte": 44 + days}
    chain = [contract(105, "C", 1.5), contract(105, "C", 2.5, **later)]
    assert calendars(chain_from_rows(spark, chain)).count() == pairs


@pytest.mark.parametrize("seed", SEEDS)
def test_calendars_against_brute_force(spark, seed):
    chain = random_chain(seed, strikes=6, expirations=7)
    live = [c for c in chain if c["mid"] is not None]
    expected = {
        (n["symbol"], n["right"], n["strike"], n["expiration"], f["expiration"]):
            (f["mid"] - n["mid"]) * 100
        for n in live for f in live
        if (n["symbol"], n["right"], n["strike"]) == (f["symbol"], f["right"], f["strike"])
        and n["expiration"] < f["expiration"] and f["dte"] >= n["dte"] + 7 and f["mid"] > n["mid"]
    }
    df = chain_from_rows(spark, chain)
    key = (*CALENDAR_KEYS, "near_expiration", "far_expiration")
    plain = keyed(rows_of(calendars(df, ranked=False)), "symbol", "right", "strike", *key[3:])
    assert {k: r["net_debit"] for k, r in plain.items()} == expected
    layout = lay_out(df, {"c": CALENDAR_KEYS}, tile=2)["c"]
    assert layout.hot is not None and layout.tasks is not None
    tiled = rows_of(calendars(df, layout=layout, ranked=False))
    assert keyed(tiled, "symbol", "right", "strike", *key[3:]) == plain


def test_calendar_order_puts_missing_theta_last(spark):
    chain = [*CALENDAR, contract(90, "P", 1.0, **{"expiration": EXPIRY, "dte": 44}),
             contract(90, "P", 2.0, expiration=CALENDAR[1]["expiration"], dte=79)]
    rows = rows_of(calendars(chain_from_rows(spark, chain)))
    assert rows[-1]["theta_differential"] is None and rows[-1]["strike"] == 90


# ---- iron butterflies


def test_known_butterfly(spark):
    df = iron_butterflies(chain_from_rows(spark, BUTTERFLY))
    assert df.columns == RESULT_COLUMNS["iron_butterflies"]
    (row,) = rows_of(df)
    fields = """atm_strike put_wing_strike call_wing_strike wing_width total_credit max_profit
        max_loss spread_ratio credit_yield ROC lower_breakeven upper_breakeven atm_put_iv
        atm_call_iv short_put_delta long_call_delta pct_to_atm_strike""".split()
    assert [row[f] for f in fields] == pytest.approx(
        [100, 95, 105, 5, 290, 290, 210, 58, 138.0952, 2.9, 97.1, 102.9, 0.28, 0.26, -0.5, 0.3, 0],
        abs=1e-4)


def test_no_butterfly_where_the_nearest_strike_has_one_side(spark):
    chain = [c for c in BUTTERFLY if (c["strike"], c["right"]) != (100, "C")]
    assert iron_butterflies(chain_from_rows(spark, chain)).isEmpty()


def test_equally_near_strikes_take_the_lower(spark):
    chain = [contract(k, r, m) for k, r, m in [
        (98, "P", 3.0), (98, "C", 3.1), (102, "P", 3.2), (102, "C", 2.9),
        (94, "P", 1.0), (102, "P", 4.0)] if (k, r, m) != (102, "P", 3.2)]
    (row,) = rows_of(iron_butterflies(chain_from_rows(spark, chain)))
    assert row["atm_strike"] == 98
    (move,) = rows_of(expected_move(chain_from_rows(spark, chain)))
    assert (move["atm_call_strike"], move["atm_put_strike"]) == (98, 98)


@pytest.mark.parametrize("seed", SEEDS)
def test_butterflies_against_brute_force(spark, seed):
    chain = random_chain(seed, symbols=5, strikes=20)
    expected = {}
    for key, legs in by_expiration(chain).items():
        atm = nearest(legs)["strike"]
        quotes = {(c["strike"], c["right"]): c for c in legs}
        sp, sc = quotes.get((atm, "P")), quotes.get((atm, "C"))
        if sp is None or sc is None:
            continue
        for lp in legs:
            lc = quotes.get((2 * atm - lp["strike"], "C"))
            if lp["right"] != "P" or lp["strike"] >= atm or lc is None:
                continue
            width = atm - lp["strike"]
            credit = (sp["mid"] - lp["mid"]) + (sc["mid"] - lc["mid"])
            if credit > 0 and width - credit > 0:
                expected[(*key, width)] = (credit * 100, (width - credit) * 100)
    df = chain_from_rows(spark, chain)
    key = ("symbol", "expiration", "wing_width")
    plain = keyed(rows_of(iron_butterflies(df, ranked=False)), *key)
    assert {k: (r["total_credit"], r["max_loss"]) for k, r in plain.items()} == expected


# ---- expected move


def test_known_expected_move(spark):
    df = expected_move(chain_from_rows(spark, ANALYTICS))
    assert df.columns == RESULT_COLUMNS["expected_move"]
    (row,) = rows_of(df)
    assert [row[c] for c in RESULT_COLUMNS["expected_move"][2:]] == pytest.approx(
        [44, 100, 100, 100, 2.9, 3.1, 6, 600, 6, 106, 94, 0.27])


@pytest.mark.parametrize("seed", SEEDS)
def test_expected_move_against_brute_force(spark, seed):
    chain = random_chain(seed, symbols=6)
    expected = {}
    for key, legs in by_expiration(chain).items():
        sides = [[c for c in legs if c["right"] == r] for r in "CP"]
        if all(sides):
            c, p = map(nearest, sides)
            ivs = (c["implied_vol"], p["implied_vol"])
            expected[key] = (c["strike"], p["strike"], c["mid"] + p["mid"],
                             None if None in ivs else sum(ivs) / 2)
    rows = rows_of(expected_move(chain_from_rows(spark, chain)))
    assert {
        (r["symbol"], r["expiration"]): (
            r["atm_call_strike"], r["atm_put_strike"], r["expected_move"], r["avg_atm_iv"])
        for r in rows
    } == expected
    assert [(r["symbol"], r["expiration"]) for r in rows] == sorted(expected)


def test_expected_move_needs_both_sides(spark):
    assert expected_move(chain_from_rows(spark, OTM[:3])).isEmpty()


# ---- max pain


def test_known_max_pain(spark):
    df = max_pain(chain_from_rows(spark, ANALYTICS))
    assert df.columns == RESULT_COLUMNS["max_pain"]
    (row,) = rows_of(df)
    assert [row[c] for c in RESULT_COLUMNS["max_pain"][2:]] == [44, 100, 100, 1400, 1500, 2900, 0]
    curve = rows_of(max_pain_curve(chain_from_rows(spark, ANALYTICS)))
    assert {r["candidate_strike"]: r["total_pain"] for r in curve} == {100: 2900, 105: 6550}
    whole = rows_of(max_pain_curve(chain_from_rows(spark, ANALYTICS), include_all_candidates=True))
    assert {r["candidate_strike"]: r["total_pain"] for r in whole} == {
        95: 7000, 100: 2900, 105: 6550}


def test_puts_only_expiration_has_pain_only_with_all_candidates(spark):
    chain = chain_from_rows(spark, [c for c in ANALYTICS if c["right"] == "P"])
    assert max_pain(chain).isEmpty()
    (row,) = rows_of(max_pain(chain, include_all_candidates=True))
    assert (row["max_pain_strike"], row["total_pain"]) == (105, 0)


def test_unpriced_contracts_still_count(spark):
    chain = [{**c, "mid": None} for c in ANALYTICS]
    (row,) = rows_of(max_pain(chain_from_rows(spark, chain)))
    assert row["total_pain"] == 2900


def pains(chain) -> dict:
    result = {}
    for key, legs in by_expiration(chain, lambda c: (c["open_interest"] or 0) > 0).items():
        for k in {c["strike"] for c in legs}:
            calls = [(k - c["strike"]) * c["open_interest"] for c in legs
                     if c["right"] == "C" and c["strike"] < k]
            puts = [(c["strike"] - k) * c["open_interest"] for c in legs
                    if c["right"] == "P" and c["strike"] > k]
            result[(*key, k)] = (bool(calls), sum(calls), sum(puts))
    return result


@pytest.mark.parametrize("seed", SEEDS)
def test_max_pain_against_brute_force(spark, seed):
    chain = random_chain(seed, symbols=4, strikes=25)
    df = chain_from_rows(spark, chain)
    every = pains(chain)
    key = ("symbol", "expiration", "candidate_strike")
    whole = keyed(rows_of(max_pain_curve(df, include_all_candidates=True)), *key)
    assert {k: (r["call_pain"], r["put_pain"]) for k, r in whole.items()} == {
        k: v[1:] for k, v in every.items()}
    usual = keyed(rows_of(max_pain_curve(df)), *key)
    assert set(usual) == {k for k, v in every.items() if v[0]}
    least = {}
    for (s, e, k), (_, c, p) in sorted((k, v) for k, v in every.items() if v[0]):
        if (s, e) not in least or c + p < least[s, e][1]:
            least[s, e] = (k, c + p)
    found = rows_of(max_pain(df))
    assert {(r["symbol"], r["expiration"]): (r["max_pain_strike"], r["total_pain"])
            for r in found} == least


def test_pain_off_the_grid_keeps_its_digits(spark):
    """Odd strikes, one of them far out, and interest of very different sizes."""
    rng = random.Random(3)
    strikes = sorted({round(rng.uniform(90, 110), 7) for _ in range(300)} | {1e7})
    chain = [{**contract(k, r, 1.0), "open_interest": rng.choice([0.1, 3.7, 1e6 / 3])}
             for k in strikes for r in "CP"]
    every = {}
    for k in strikes:
        every[k] = tuple(
            math.fsum(max(sign * (k - c["strike"]), 0.0) * c["open_interest"]
                      for c in chain if c["right"] == right)
            for right, sign in (("C", 1), ("P", -1)))
    df = chain_from_rows(spark, chain)
    for layout in (df.coalesce(1), df.repartition(7)):
        rows = rows_of(max_pain_curve(layout, include_all_candidates=True))
        found = {r["candidate_strike"]: (r["call_pain"], r["put_pain"]) for r in rows}
        assert found.keys() == every.keys()
        for k, pair in found.items():
            assert pair == pytest.approx(every[k], rel=1e-13, abs=0)
