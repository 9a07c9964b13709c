"""Expressions shared by the multi-leg strategies.

Prices and strikes are per share; contract values are per 100 shares.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from strikeforge.functions.numbers import percent

SHARES = 100
GREEKS = ("delta", "gamma", "theta", "vega")


def per_contract(per_share: str) -> str:
    return f"({per_share}) * {SHARES}"


def distance_pct(level: str, underlying: str = "underlying_price") -> str:
    """How far a price level is from the underlying, in percent of the underlying."""
    return percent(f"abs({underlying} - {level})", underlying)


def yield_pct(profit: str, loss: str) -> str:
    """Profit in percent of the amount at risk; NULL when nothing is at risk."""
    return f"CASE WHEN {loss} > 0 THEN {profit} / {loss} * 100 END"


def net_greeks(first: str, operator: str, second: str) -> dict[str, str]:
    """Both legs' Greeks added or subtracted; NULL if either leg has none."""
    return {f"net_{g}": f"{first}_{g} {operator} {second}_{g}" for g in GREEKS}


def named(columns: Mapping[str, str], order: Sequence[str]) -> list[str]:
    """Select list in contract order: computed columns by name, the rest passed through."""
    return [f"{columns.get(c, c)} AS {c}" for c in order]
