"""A scan over landed tables: quotes, underlying polls, venue listings, listed contracts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame

from strikeforge.operators.ingest import EXPIRY_FIELD, build_chain
from strikeforge.operators.universe import (
    contract_universe,
    listed_only,
    preferred_listing,
    underlying_price,
    window_ends,
)


@dataclass(frozen=True)
class Wanted:
    """What a scan asks for."""

    as_of: date
    exchange: str
    symbols: Sequence[str] = ()  # none means all
    target_dte: int = 45
    dte_range: int = 7
    strike_pct: float = 0.20


def of_symbols(df: DataFrame, symbols: Sequence[str]) -> DataFrame:
    return df.filter(df.symbol.isin(*symbols)) if symbols else df


def in_window(ticks: DataFrame, wanted: Wanted) -> DataFrame:
    """Drop ticks of other expirations at the scan: the text sorts like the date it spells."""
    first, last = window_ends(wanted.as_of, wanted.target_dte, wanted.dte_range)
    return ticks.filter(f"{EXPIRY_FIELD} BETWEEN '{first:%Y%m%d}' AND '{last:%Y%m%d}'")


def wanted_contracts(
    listings: DataFrame, underlying: DataFrame, wanted: Wanted, listed: DataFrame | None = None
) -> DataFrame:
    """The contract universe, reduced to what the venue really lists where that is known."""
    candidates = contract_universe(
        preferred_listing(listings, wanted.exchange),
        underlying,
        wanted.as_of,
        wanted.target_dte,
        wanted.dte_range,
        wanted.strike_pct,
    )
    return candidates if listed is None else listed_only(candidates, listed)


def landed_chain(
    ticks: DataFrame,
    polls: DataFrame,
    listings: DataFrame,
    wanted: Wanted,
    *,
    listed: DataFrame | None = None,
    newest_by: Sequence[str] = ("ts",),
    deal: bool = True,
) -> DataFrame:
    """The chain of one scan.

    The symbol and expiration filters reach the table scans. Far strikes go with the universe
    join, after the ticks are reduced to one per contract.
    """
    ticks, polls, listings = (of_symbols(t, wanted.symbols) for t in (ticks, polls, listings))
    underlying = underlying_price(polls)
    return build_chain(
        in_window(ticks, wanted),
        underlying,
        wanted.as_of,
        newest_by=newest_by,
        deal=deal,
        universe=wanted_contracts(listings, underlying, wanted, listed),
    )
