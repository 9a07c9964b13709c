"""Short strangles: every out-of-the-money put with every out-of-the-money call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeforge.functions.numbers import percent
from strikeforge.functions.payoff import distance_pct, named, net_greeks, per_contract
from strikeforge.operators.pairing import LEG_COLUMNS, Layout, as_leg, pair_legs, priced
from strikeforge.schema import RESULT_COLUMNS

STRANGLE_KEYS = ["symbol", "expiration"]

COLUMNS = {
    "underlying_price": "put_underlying_price",
    "total_premium": per_contract("premium"),
    "breakeven_width": "upper_breakeven - lower_breakeven",
    "pct_to_put_strike": distance_pct("put_strike", "put_underlying_price"),
    "pct_to_call_strike": distance_pct("call_strike", "call_underlying_price"),
    "pct_to_lower_breakeven": distance_pct("lower_breakeven", "put_underlying_price"),
    "pct_to_upper_breakeven": distance_pct("upper_breakeven", "call_underlying_price"),
    "ROC": percent("premium", "((put_strike + call_strike) / 2)"),
    "dte": "put_dte",
    **net_greeks("put", "+", "call"),
}


def strangles(chain: DataFrame, *, layout: Layout | None = None, ranked: bool = True) -> DataFrame:
    """A strike at the underlying belongs to neither side."""
    quoted = priced(chain)
    leg_columns = [*LEG_COLUMNS, "implied_vol", "underlying_price"]
    put = as_leg(
        quoted.filter("right = 'P' AND strike < underlying_price"),
        "put", STRANGLE_KEYS, [*leg_columns, "dte"],
    )
    call = as_leg(
        quoted.filter("right = 'C' AND strike > underlying_price"),
        "call", STRANGLE_KEYS, leg_columns,
    )
    pairs = (
        pair_legs(put, call, STRANGLE_KEYS, layout, left_by=["put_strike"], right_by=["call_strike"])
        .selectExpr(
            "*",
            "put_mid + call_mid AS premium",
            "put_strike - premium AS lower_breakeven",
            "call_strike + premium AS upper_breakeven",
        )
        .filter("premium > 0")
    )
    result = pairs.selectExpr(*named(COLUMNS, RESULT_COLUMNS["strangles"]))
    if ranked:
        result = result.orderBy(
            F.desc("total_premium"), *STRANGLE_KEYS, "put_strike", "call_strike"
        )
    return result
