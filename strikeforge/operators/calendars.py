"""Calendar spreads: sell a near expiration, buy a later one at the same strike and right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeforge.functions.numbers import percent
from strikeforge.functions.payoff import distance_pct, named, per_contract
from strikeforge.operators.pairing import Layout, as_leg, pair_legs, priced
from strikeforge.schema import RESULT_COLUMNS

CALENDAR_KEYS = ["symbol", "right", "strike"]
MIN_GAP_DAYS = 7

COLUMNS = {
    "dte_gap": "far_dte - near_dte",
    "net_debit": per_contract("debit"),
    "approx_max_profit": per_contract("near_mid"),
    "approx_ROC": percent(per_contract("near_mid"), per_contract("debit")),
    "theta_differential": "near_theta - far_theta",
    "iv_differential": "near_implied_vol - far_implied_vol",
    "underlying_price": "near_underlying_price",
    "pct_to_strike": distance_pct("strike", "near_underlying_price"),
    "near_iv": "near_implied_vol",
    "far_iv": "far_implied_vol",
}


def calendars(chain: DataFrame, *, layout: Layout | None = None, ranked: bool = True) -> DataFrame:
    """Expirations at least a week apart where the later one costs more.

    The theta differential is near minus far, so fast near decay is negative and sorts last.
    """
    quoted = priced(chain)
    leg_columns = ["expiration", "dte", "mid", "theta", "implied_vol", "delta"]
    near = as_leg(quoted, "near", CALENDAR_KEYS, [*leg_columns, "underlying_price"])
    far = as_leg(quoted, "far", CALENDAR_KEYS, leg_columns)
    pairs = (
        pair_legs(
            near, far, CALENDAR_KEYS, layout, left_by=["near_expiration"], right_by=["far_expiration"]
        )
        .filter("near_expiration < far_expiration")
        .filter(f"far_dte >= near_dte + {MIN_GAP_DAYS}")
        .selectExpr("*", "far_mid - near_mid AS debit")
        .filter("debit > 0")
    )
    result = pairs.selectExpr(*named(COLUMNS, RESULT_COLUMNS["calendars"]))
    if ranked:
        result = result.orderBy(
            F.desc("theta_differential"), *CALENDAR_KEYS, "near_expiration", "far_expiration"
        )
    return result
