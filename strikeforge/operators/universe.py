"""Which contracts a scan asks for: symbols, listings, expirations, strikes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeforge.functions.pricing import best_price, expiry_date
from strikeforge.schema import CONTRACT_KEY


def parse_symbols(text: str, default: Sequence[str] = ()) -> list[str]:
    """Comma list to upper-cased symbols; blank text gives the default."""
    if not text.strip():
        return [s.upper() for s in default]
    return [s.strip().upper() for s in text.split(",") if s.strip()]


def symbol_universe(df: DataFrame, text: str) -> DataFrame:
    """Distinct symbols named by comma lists held in a column, parsed the same way."""
    parts = f"transform(split({text}, ','), s -> upper(trim(s)))"
    return df.selectExpr(f"explode({parts}) AS symbol").filter("symbol <> ''").distinct()


def preferred_listing(listings: DataFrame, exchange: str) -> DataFrame:
    """One listing per symbol: the preferred venue's if it has one, else the first by name.

    A listing without a venue comes after all others. Of several listings of one venue the first in
    the order of all its fields is taken, its arrays ordered first, as they spell sets; so the
    choice does not depend on the order of rows.
    """
    fields = [c for c in listings.columns if c != "symbol"]
    other = F.coalesce(F.col("exchange") != exchange, F.lit(True))
    rank = [other, F.col("exchange").isNull(), F.col("exchange")]
    rank += [in_total_order(listings, c) for c in sorted(fields) if c != "exchange"]
    # Equal ranks are equal sets; the fields themselves tell apart in which order they are spelled.
    best = F.min(F.struct(*(r.alias(f"_{i}") for i, r in enumerate(rank)), *fields)).alias("best")
    kept = [F.col(f"best.{c}").alias(c) for c in fields]
    return listings.groupBy("symbol").agg(best).select("symbol", *kept)


def in_total_order(df: DataFrame, column: str) -> Column:
    """What a column is ordered by: NULL last, arrays as sets."""
    is_array = isinstance(df.schema[column].dataType, T.ArrayType)
    value = F.sort_array(column) if is_array else F.col(column)
    return F.struct(F.col(column).isNull().alias("missing"), value.alias("value"))


def window_ends(as_of: date, target_dte: int, dte_range: int) -> tuple[date, date]:
    return (
        as_of + timedelta(days=target_dte - dte_range),
        as_of + timedelta(days=target_dte + dte_range),
    )


def _window(as_of: date, target_dte: int, dte_range: int) -> str:
    first, last = window_ends(as_of, target_dte, dte_range)
    return f"BETWEEN DATE '{first}' AND DATE '{last}'"


def band(pct: float) -> str:
    low, high = f"{1 - pct!r}D", f"{1 + pct!r}D"
    return f"BETWEEN underlying_price * {low} AND underlying_price * {high}"


def dte_window(
    listings: DataFrame, as_of: date, target_dte: int = 45, dte_range: int = 7
) -> DataFrame:
    """Listed expirations from target-range to target+range days out, both ends included."""
    return (
        listings.selectExpr("symbol", "explode(expirations) AS expiry")
        .selectExpr("symbol", f"{expiry_date('expiry')} AS expiration")
        .filter(f"expiration {_window(as_of, target_dte, dte_range)}")
    )


def strike_band(listings: DataFrame, underlying: DataFrame, pct: float = 0.20) -> DataFrame:
    """Listed strikes within ``pct`` of the underlying price, both ends included.

    A symbol without an underlying price drops out.
    """
    return (
        listings.selectExpr("symbol", "explode(strikes) AS strike")
        .join(underlying.select("symbol", "underlying_price"), "symbol")
        .filter(f"strike {band(pct)}")
    )


def contract_universe(
    listings: DataFrame,
    underlying: DataFrame,
    as_of: date,
    target_dte: int = 45,
    dte_range: int = 7,
    pct: float = 0.20,
) -> DataFrame:
    """Every (expiration, strike, call/put) a scan would ask for, from one listing per symbol.

    Works inside each listing row, so the three explodes need no shuffle beyond the
    price join.
    """
    dates = f"transform(expirations, e -> {expiry_date('e')})"
    near = f"filter({dates}, d -> d {_window(as_of, target_dte, dte_range)})"
    around = f"filter(strikes, k -> k {band(pct)})"
    return (
        listings.join(underlying.select("symbol", "underlying_price"), "symbol")
        .selectExpr("symbol", f"explode({near}) AS expiration", f"{around} AS strikes")
        .selectExpr("symbol", "expiration", "explode(strikes) AS strike")
        .selectExpr("*", "explode(array('C', 'P')) AS right")
        .select(*CONTRACT_KEY)
    )


def listed_only(candidates: DataFrame, listed: DataFrame) -> DataFrame:
    """Candidates the venue really lists."""
    return candidates.join(listed.select(*CONTRACT_KEY), CONTRACT_KEY, "left_semi")


def underlying_price(polls: DataFrame) -> DataFrame:
    """First usable price of every symbol over its polls; unpriced symbols drop out.

    Of polls with one number the lower price counts; a poll without a number comes last.
    """
    price = best_price("bid", "ask", "last", "close", "marketPrice")
    first = F.min(F.struct(F.col("poll").isNull().alias("late"), "poll", "price"))
    return (
        polls.selectExpr("symbol", "poll", f"{price} AS price")
        .filter("price IS NOT NULL")
        .groupBy("symbol")
        .agg(first["price"].alias("underlying_price"))
    )
