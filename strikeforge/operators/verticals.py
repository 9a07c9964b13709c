"""Vertical credit and debit spreads, and the iron condors made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeforge.functions.numbers import percent
from strikeforge.functions.payoff import (
    GREEKS,
    SHARES,
    distance_pct,
    named,
    net_greeks,
    per_contract,
    yield_pct,
)
from strikeforge.operators.pairing import LEG_COLUMNS, Layout, as_leg, pair_legs, priced
from strikeforge.schema import RESULT_COLUMNS

VERTICAL_KEYS = ["symbol", "expiration", "right"]

# At or out of the money, a strike at the underlying included.
SELLABLE = """CASE WHEN right = 'P' THEN strike <= underlying_price
    ELSE strike >= underlying_price END"""

# Named by right and strike order alone, whatever the sign of the premium. Fixed values.
LABEL = """CASE
    WHEN right = 'P' AND short_strike > long_strike THEN 'Put Credit Spread'
    WHEN right = 'P' AND short_strike < long_strike THEN 'Put Debit Spread'
    WHEN right = 'C' AND short_strike < long_strike THEN 'Call Credit Spread'
    WHEN right = 'C' AND short_strike > long_strike THEN 'Call Debit Spread'
    ELSE 'Unknown' END"""

# A credit is earned around the strike sold, a debit around the strike bought.
BREAKEVEN = """CASE WHEN premium >= 0 THEN short_strike ELSE long_strike END
    + CASE WHEN right = 'P' THEN -paid ELSE paid END"""

COLUMNS = {
    "strategy": LABEL,
    "underlying_price": "short_underlying_price",
    "spread_ratio": "paid / width * 100",
    "pct_to_short_strike": distance_pct("short_strike", "short_underlying_price"),
    "pct_to_long_strike": distance_pct("long_strike", "short_underlying_price"),
    "credit": per_contract("premium"),
    "max_profit": per_contract("profit"),
    "max_loss": per_contract("loss"),
    "credit_yield": yield_pct("profit", "loss"),
    "ROC": percent("paid", "short_strike"),
    "pct_to_breakeven": distance_pct("breakeven", "short_underlying_price"),
    "dte": "short_dte",
    **net_greeks("short", "-", "long"),
}


def vertical_spreads(
    chain: DataFrame,
    *,
    layout: Layout | None = None,
    unique_contracts: bool = False,
    ranked: bool = True,
) -> DataFrame:
    """Every two-strike spread of one expiration and right whose short leg is not in the money.

    When both legs could be sold, the pair turns up in both roles; only the one with the
    higher credit counts. By default the rows of a strike pair are ranked, which holds for
    chains with repeated contracts too. ``unique_contracts=True`` says that the chain has one
    row per contract; then that needs no second shuffle: the two premiums are exact negations
    and both are valid or neither is, so the mirror to drop is the row with the negative
    premium whose long leg could be sold too. ``ranked`` adds the final order by spread ratio.
    """
    quoted = priced(chain).selectExpr("*", f"{SELLABLE} AS sellable")
    short = as_leg(
        quoted.filter("sellable"), "short", VERTICAL_KEYS, [*LEG_COLUMNS, "underlying_price", "dte"]
    )
    long = as_leg(quoted, "long", VERTICAL_KEYS, [*LEG_COLUMNS, "sellable"])
    pairs = (
        pair_legs(
            short, long, VERTICAL_KEYS, layout, left_by=["short_strike"], right_by=["long_strike"]
        )
        .filter("short_strike <> long_strike")
        .selectExpr(
            "*",
            "short_mid - long_mid AS premium",
            "abs(premium) AS paid",
            "abs(short_strike - long_strike) AS width",
            "CASE WHEN premium >= 0 THEN premium ELSE width + premium END AS profit",
            "CASE WHEN premium >= 0 THEN width - premium ELSE paid END AS loss",
            f"{BREAKEVEN} AS breakeven",
        )
        .filter("profit > 0 AND loss > 0")
    )
    if unique_contracts:
        pairs = pairs.filter("premium > 0 OR NOT long_sellable")
    else:
        pairs = pairs.selectExpr(
            "*",
            f"""row_number() OVER (
                PARTITION BY {", ".join(VERTICAL_KEYS)}, least(short_strike, long_strike),
                    greatest(short_strike, long_strike)
                ORDER BY premium DESC, short_strike, short_mid) AS place""",
        ).filter("place = 1")

    result = pairs.selectExpr(*named(COLUMNS, RESULT_COLUMNS["spreads"]))
    if ranked:
        result = result.orderBy(
            F.desc("spread_ratio"), *VERTICAL_KEYS, "short_strike", "long_strike"
        )
    return result


# The order of candidates for one side: highest spread ratio, then narrower, then lower short
# strike, then lower long strike. Behind it, what a condor needs of the winner.
SIDE = [
    "spread_ratio", "-width AS narrow", "-short_strike AS low_short", "-long_strike AS low_long",
]
SIDE_FIELDS = [
    "width", "short_strike", "long_strike", "credit", "underlying_price", "dte",
    *(f"net_{g}" for g in GREEKS),
]

CONDOR_COLUMNS = {
    "max_profit": "total_credit",
    "spread_ratio": "total_credit / at_stake * 100",
    "credit_yield": yield_pct("total_credit", "max_loss"),
    "ROC": percent(f"total_credit / {SHARES}", "((put_short_strike + call_short_strike) / 2)"),
    "underlying_price": "put_underlying_price",
    "pct_to_lower_breakeven": distance_pct("lower_breakeven", "put_underlying_price"),
    "pct_to_upper_breakeven": distance_pct("upper_breakeven", "put_underlying_price"),
    "dte": "put_dte",
    **{f"net_{g}": f"put_net_{g} + call_net_{g}" for g in GREEKS},
}


def iron_condors(spreads: DataFrame) -> DataFrame:
    """The best put credit spread with the best call credit spread of each expiration.

    Both sides come out of one grouped maximum that is combined before the shuffle, so
    there is no join of two halves. Each breakeven counts only its own side's credit.
    """
    entry = F.expr(f"struct({', '.join([*SIDE, *SIDE_FIELDS])})")
    sides = (
        spreads.filter("contains(strategy, 'Credit')")
        .select("symbol", "expiration", "right", entry.alias("entry"))
        .groupBy("symbol", "expiration")
        .agg(
            F.expr("max(entry) FILTER (WHERE right = 'P') AS put"),
            F.expr("max(entry) FILTER (WHERE right = 'C') AS call"),
        )
        .filter("put IS NOT NULL AND call IS NOT NULL")
        .selectExpr(
            "symbol",
            "expiration",
            *(f"{side}.{c} AS {side}_{c}" for side in ("put", "call") for c in SIDE_FIELDS),
            "put_credit + call_credit AS total_credit",
            f"greatest(put_width, call_width) * {SHARES} AS at_stake",
            "at_stake - total_credit AS max_loss",
            f"put_short_strike - put_credit / {SHARES} AS lower_breakeven",
            f"call_short_strike + call_credit / {SHARES} AS upper_breakeven",
        )
    )
    return sides.selectExpr(*named(CONDOR_COLUMNS, RESULT_COLUMNS["iron_condors"]))
