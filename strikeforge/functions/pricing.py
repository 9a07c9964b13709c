"""Price and quote expressions over one feed record."""

from __future__ import annotations

from strikeforge.functions.numbers import clean_double, if_finite, if_positive


def best_price(bid: str, ask: str, last: str, close: str, market: str | None = None) -> str:
    """Middle of a two-sided quote, else last, else close, else a finite market price.

    Every input is cleaned first: Spark orders NaN above all numbers, so an uncleaned NaN
    would pass ``> 0``.
    """
    bid, ask, last, close = (clean_double(c) for c in (bid, ask, last, close))
    choices = [
        f"CASE WHEN {bid} > 0 AND {ask} > 0 THEN ({bid} + {ask}) / 2 END",
        if_positive(last),
        if_positive(close),
    ]
    if market is not None:
        choices.append(if_positive(if_finite(clean_double(market))))
    return f"coalesce({', '.join(choices)})"


def by_right(call: str, put: str) -> str:
    """The call's field for calls, the put's for everything else, cleaned."""
    return f"CASE WHEN right = 'C' THEN {clean_double(call)} ELSE {clean_double(put)} END"


def expiry_date(text: str) -> str:
    """``yyyyMMdd`` text to a date."""
    return f"to_date({text}, 'yyyyMMdd')"
