"""Max pain: the strike at which option holders lose the most value at expiry.

Going up the strikes, the pain of the calls grows at each step by the call interest passed so
far times the step; going down, that of the puts likewise. So running totals along the strikes
give every candidate's pain in one ordered pass each way. Nothing pairs candidates with
contracts, and as every term is positive no digits cancel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeforge.functions.numbers import percent
from strikeforge.schema import RESULT_COLUMNS

EXPIRATION_KEYS = ["symbol", "expiration"]


def with_interest(chain: DataFrame) -> DataFrame:
    """Contracts with open interest, priced or not."""
    return chain.filter("open_interest > 0")


def _interest_per_strike(chain: DataFrame) -> DataFrame:
    sums = [
        f"sum(if(right = '{right}', open_interest, 0D)) AS {role}_oi"
        for role, right in (("call", "C"), ("put", "P"))
    ]
    used = ["strike", "right", "open_interest", "underlying_price", "dte"]
    return (
        with_interest(chain)
        .select(*EXPIRATION_KEYS, *used)
        .repartition(*EXPIRATION_KEYS)  # serves the sums per strike and both passes
        .groupBy(*EXPIRATION_KEYS, "strike")
        .agg(
            F.max("underlying_price").alias("underlying_price"),
            F.max("dte").alias("dte"),
            *(F.expr(total) for total in sums),
        )
    )


def _along(strikes: DataFrame, role: str, direction: str) -> DataFrame:
    """Add the interest of ``role`` passed before each strike, and its pain there."""
    window = f"PARTITION BY {', '.join(EXPIRATION_KEYS)} ORDER BY strike {direction}"
    so_far = f"{window} ROWS BETWEEN UNBOUNDED PRECEDING AND"
    passed, step = f"{role}_oi_passed", f"{role}_step"
    return strikes.selectExpr(
        "*",
        f"coalesce(sum({role}_oi) OVER ({so_far} 1 PRECEDING), 0D) AS {passed}",
        f"coalesce(abs(strike - lag(strike) OVER ({window})), 0D) AS {step}",
    ).selectExpr("*", f"sum({passed} * {step}) OVER ({so_far} CURRENT ROW) AS {role}_pain")


def max_pain_curve(chain: DataFrame, *, include_all_candidates: bool = False) -> DataFrame:
    """Pain of settling at each candidate strike.

    A candidate needs open call interest strictly below it, so the lowest strike and
    expirations without calls have no row; ``include_all_candidates`` adds them. There is one
    shuffle, of six narrow columns by expiration. Contracts are summed per strike behind it, so what
    the passes order is one row per listed strike; a chain has two contracts per strike, so
    summing before the shuffle, which takes one more, would save little.
    """
    pains = _along(_along(_interest_per_strike(chain), "call", "ASC"), "put", "DESC")
    if not include_all_candidates:
        pains = pains.filter("call_oi_passed > 0")
    return pains.selectExpr(
        *EXPIRATION_KEYS,
        "dte",
        "underlying_price",
        "strike AS candidate_strike",
        "call_pain",
        "put_pain",
        "call_pain + put_pain AS total_pain",
    )


def max_pain(
    chain: DataFrame, *, include_all_candidates: bool = False, ranked: bool = True
) -> DataFrame:
    """The candidate with the least total pain per expiration; equal pain: the lower strike."""
    curve = max_pain_curve(chain, include_all_candidates=include_all_candidates)
    best = """min(struct(total_pain, candidate_strike AS max_pain_strike, call_pain, put_pain,
        underlying_price, dte)) AS best"""
    change = percent("(max_pain_strike - underlying_price)", "underlying_price")
    result = (
        curve.groupBy(*EXPIRATION_KEYS)
        .agg(F.expr(best))
        .select(*EXPIRATION_KEYS, "best.*")
        .selectExpr("*", f"{change} AS pct_from_underlying")
        .select(*RESULT_COLUMNS["max_pain"])
    )
    if not ranked:
        return result
    # One row per expiration is dealt once more: a sort by ranges looks at its input twice, and the
    # passes behind it would run twice.
    return result.repartition(*EXPIRATION_KEYS).orderBy(*EXPIRATION_KEYS)
