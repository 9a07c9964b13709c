"""Raw quotes to the option chain."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame

from strikeforge.functions.numbers import clean_double
from strikeforge.functions.pricing import best_price, by_right, expiry_date
from strikeforge.operators.snapshot import latest_per_key
from strikeforge.schema import CHAIN_SCHEMA, CONTRACT_KEY, RAW_CONTRACT_KEY

EXPIRY_FIELD = "lastTradeDateOrContractMonth"
SYMBOL_SALTS = 16

# Flat Greeks out of the nested record; all NULL when the record is missing.
GREEK_COLUMNS = {
    name: clean_double(f"modelGreeks.{field}")
    for name, field in {
        "delta": "delta",
        "gamma": "gamma",
        "theta": "theta",
        "vega": "vega",
        "implied_vol": "impliedVol",
    }.items()
}

# Open interest and volume by right; only volume falls back to the generic field.
SIZE_COLUMNS = {
    "open_interest": by_right("callOpenInterest", "putOpenInterest"),
    "volume": f"coalesce({by_right('callVolume', 'putVolume')}, {clean_double('volume')})",
}


def latest_quotes(
    ticks: DataFrame, newest_by: Sequence[str] = ("ts",), deal: bool = True
) -> DataFrame:
    """Last tick of every contract; ``deal=False`` for ticks that come dealt by contract."""
    return latest_per_key(ticks, RAW_CONTRACT_KEY, newest_by, deal)


def expiry_columns(as_of: date) -> dict[str, str]:
    expiration = expiry_date(EXPIRY_FIELD)
    return {"expiration": expiration, "dte": f"datediff({expiration}, DATE '{as_of}')"}


def quote_columns(as_of: date, sentinel_to_null: bool = False) -> dict[str, str]:
    """All chain columns one raw record gives; only the underlying price is missing."""
    return {
        "symbol": "symbol",
        "strike": "double(strike)",
        "right": "right",
        **expiry_columns(as_of),
        **{c: clean_double(c, sentinel_to_null) for c in ("bid", "ask", "last", "close")},
        "mid": best_price("bid", "ask", "last", "close", "marketPrice"),
        **GREEK_COLUMNS,
        **SIZE_COLUMNS,
    }


def to_quotes(latest: DataFrame, as_of: date, sentinel_to_null: bool = False) -> DataFrame:
    columns = quote_columns(as_of, sentinel_to_null)
    return latest.selectExpr(*(f"{c} AS {name}" for name, c in columns.items()))


def build_chain(
    ticks: DataFrame,
    underlying: DataFrame,
    as_of: date,
    *,
    newest_by: Sequence[str] = ("ts",),
    universe: DataFrame | None = None,
    keep_unpriced: bool = False,
    sentinel_to_null: bool = False,
    deal: bool = True,
) -> DataFrame:
    """The option chain of all symbols at once.

    ``universe`` restricts it to the contracts of a scan; ``keep_unpriced`` keeps contracts
    without any usable price, which a scan drops. ``deal=False`` for ticks dealt by contract.
    """
    quotes = to_quotes(latest_quotes(ticks, newest_by, deal), as_of, sentinel_to_null)
    if universe is not None:
        # Exploded from small files, a universe looks small to Spark however many contracts it has.
        wanted = universe.select(*CONTRACT_KEY).hint("merge")
        quotes = quotes.join(wanted, CONTRACT_KEY, "left_semi")
    if not keep_unpriced:
        quotes = quotes.filter("mid IS NOT NULL")
    return add_underlying(quotes, underlying)


def add_underlying(quotes: DataFrame, underlying: DataFrame) -> DataFrame:
    """Complete quotes to chain rows; symbols without an underlying price drop out.

    The underlying table has one row per symbol, so repeating it per salt is cheap and spreads
    a symbol with a third of all contracts over ``SYMBOL_SALTS`` join keys.
    """
    prices = underlying.selectExpr(
        "symbol", "underlying_price", f"explode(sequence(0, {SYMBOL_SALTS - 1})) AS _salt"
    )
    salt = f"int(pmod(xxhash64(expiration, strike, right), {SYMBOL_SALTS})) AS _salt"
    return conform(quotes.selectExpr("*", salt).join(prices, ["symbol", "_salt"]))


def conform(chain: DataFrame) -> DataFrame:
    """Project and cast to the chain schema, in its column order."""
    return chain.selectExpr(
        *(f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in CHAIN_SCHEMA)
    )


def union_sources(*chains: DataFrame) -> DataFrame:
    """One table out of several sources' chains."""
    result = conform(chains[0])
    for chain in chains[1:]:
        result = result.unionByName(conform(chain))
    return result


def duplicate_contracts(chain: DataFrame) -> DataFrame:
    """Contracts that occur more than once; a proper chain has none."""
    copies = chain.groupBy(*CONTRACT_KEY).count()
    return copies.withColumnRenamed("count", "copies").filter("copies > 1")


def require_unique_contracts(chain: DataFrame) -> DataFrame:
    """Fail on a chain with repeated contracts, otherwise hand it through."""
    sample = duplicate_contracts(chain).limit(3).collect()
    if sample:
        raise ValueError(f"option chain repeats contracts, for example {sample}")
    return chain
