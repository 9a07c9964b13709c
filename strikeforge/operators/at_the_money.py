"""At-the-money quotes, expected move and iron butterflies.

The strike nearest to the underlying is either the highest one not above it or the lowest
one not below it. Both are plain maxima and minima of doubles, so one hash aggregate per
(symbol, expiration), combined before the shuffle, finds them together with their quotes:
no sort, no window, no join of a call half with a put half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeforge.functions.numbers import percent
from strikeforge.functions.payoff import distance_pct, named, per_contract, yield_pct
from strikeforge.operators.pairing import as_leg, pair_legs, priced
from strikeforge.schema import RESULT_COLUMNS

EXPIRATION_KEYS = ["symbol", "expiration"]
RIGHTS = {"call": "C", "put": "P"}
QUOTE = ["mid", "delta", "implied_vol"]


def strikes_around_money(chain: DataFrame) -> DataFrame:
    """Per expiration and right, the priced strikes next to the underlying and their quotes."""
    aggregates = ["max(underlying_price) AS underlying_price", "max(dte) AS dte"]
    for role, right in RIGHTS.items():
        for side, pick, relation in (("below", "max", "<="), ("above", "min", ">=")):
            level = f"if(right = '{right}' AND strike {relation} underlying_price, strike, NULL)"
            aggregates.append(f"{pick}({level}) AS {role}_{side}_strike")
            aggregates += [f"{pick}_by({c}, {level}) AS {role}_{side}_{c}" for c in QUOTE]
    return priced(chain).groupBy(*EXPIRATION_KEYS).agg(*(F.expr(a) for a in aggregates))


def _below_is_nearer(below: str, above: str) -> str:
    """Equally distant strikes: the lower one."""
    nearer = f"underlying_price - {below} <= {above} - underlying_price"
    return f"({above} IS NULL OR coalesce({nearer}, false))"


def _nearest(role: str) -> list[str]:
    """Nearest strike of one right and its quote."""
    below = _below_is_nearer(f"{role}_below_strike", f"{role}_above_strike")
    return [
        f"if({below}, {role}_below_{c}, {role}_above_{c}) AS atm_{role}_{c}"
        for c in ("strike", *QUOTE)
    ]


MOVE_COLUMNS = {
    "expected_move_contract": per_contract("expected_move"),
    "move_pct": percent("expected_move", "underlying_price"),
    "upper_bound": "underlying_price + expected_move",
    "lower_bound": "underlying_price - expected_move",
    "avg_atm_iv": "(atm_call_implied_vol + atm_put_implied_vol) / 2",
}


def expected_move(chain: DataFrame, *, ranked: bool = True) -> DataFrame:
    """Price of the nearest call plus the nearest put, per expiration.

    The two may sit at different strikes. An expiration with only one side has no row.
    """
    straddles = (
        strikes_around_money(chain)
        .selectExpr(
            *EXPIRATION_KEYS, "dte", "underlying_price", *_nearest("call"), *_nearest("put"),
            "atm_call_mid + atm_put_mid AS expected_move",
        )
        .filter("atm_call_strike IS NOT NULL AND atm_put_strike IS NOT NULL")
    )
    result = straddles.selectExpr(*named(MOVE_COLUMNS, RESULT_COLUMNS["expected_move"]))
    return result.orderBy(*EXPIRATION_KEYS) if ranked else result


def short_straddles(chain: DataFrame) -> DataFrame:
    """The at-the-money strike over both rights, where a put and a call are quoted on it."""
    below = "greatest(call_below_strike, put_below_strike)"
    above = "least(call_above_strike, put_above_strike)"

    def at_money(role: str, c: str) -> str:
        return f"""CASE atm_strike WHEN {role}_below_strike THEN {role}_below_{c}
            WHEN {role}_above_strike THEN {role}_above_{c} END AS short_{role}_{c}"""

    return (
        strikes_around_money(chain)
        .selectExpr(
            *EXPIRATION_KEYS, "dte", "underlying_price",
            f"if({_below_is_nearer(below, above)}, {below}, {above}) AS atm_strike",
            *(at_money(role, c) for role in RIGHTS for c in QUOTE),
        )
        .filter("short_call_mid IS NOT NULL AND short_put_mid IS NOT NULL")
    )


FLY_COLUMNS = {
    "put_wing_strike": "long_put_strike",
    "call_wing_strike": "long_call_strike",
    "total_credit": per_contract("credit"),
    "max_profit": per_contract("credit"),
    "spread_ratio": "credit / wing_width * 100",
    "credit_yield": yield_pct(per_contract("credit"), "max_loss"),
    "ROC": percent("credit", "atm_strike"),
    "pct_to_atm_strike": distance_pct("atm_strike"),
    "pct_to_lower_breakeven": distance_pct("lower_breakeven"),
    "pct_to_upper_breakeven": distance_pct("upper_breakeven"),
    "atm_put_iv": "short_put_implied_vol",
    "atm_call_iv": "short_call_implied_vol",
}


def iron_butterflies(chain: DataFrame, *, ranked: bool = True) -> DataFrame:
    """Short straddle at the money with long wings equally far out on both sides.

    Every contract knows its own distance from the at-the-money strike, so matching wings
    share a (symbol, expiration, distance) group of at most two rows. Grouping by it replaces
    the put-wing x call-wing join. Both breakevens count the total credit.
    """
    straddles = short_straddles(chain)
    wings = as_leg(priced(chain), "wing", EXPIRATION_KEYS, ["right", "strike", "mid", "delta"])
    wings = (
        pair_legs(straddles, wings, EXPIRATION_KEYS)
        .selectExpr("*", "abs(wing_strike - atm_strike) AS wing_width")
        .filter(
            """(wing_right = 'P' AND wing_strike < atm_strike)
            OR (wing_right = 'C' AND wing_strike > atm_strike)"""
        )
    )
    # All rows of a group carry the same straddle.
    shared = [f"max({c}) AS {c}" for c in straddles.columns if c not in EXPIRATION_KEYS]
    long_legs = [
        f"max(if(wing_right = '{right}', wing_{c}, NULL)) AS long_{role}_{c}"
        for role, right in RIGHTS.items()
        for c in ("strike", "mid", "delta")
    ]
    flies = (
        wings.groupBy(*EXPIRATION_KEYS, "wing_width")
        .agg(*(F.expr(a) for a in (*shared, *long_legs)))
        .filter("long_put_mid IS NOT NULL AND long_call_mid IS NOT NULL")
        .selectExpr(
            "*",
            "(short_put_mid - long_put_mid) + (short_call_mid - long_call_mid) AS credit",
            f"{per_contract('wing_width - credit')} AS max_loss",
            "atm_strike - credit AS lower_breakeven",
            "atm_strike + credit AS upper_breakeven",
        )
        .filter("credit > 0 AND max_loss > 0")
    )
    result = flies.selectExpr(*named(FLY_COLUMNS, RESULT_COLUMNS["iron_butterflies"]))
    if ranked:
        result = result.orderBy(F.desc("spread_ratio"), *EXPIRATION_KEYS, "wing_width")
    return result
