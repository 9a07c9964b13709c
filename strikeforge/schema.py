"""Table contracts: the option chain, the raw quote feed and the result columns."""

from __future__ import annotations

from pyspark.sql import types as T

DOUBLE, STRING, INT = T.DoubleType(), T.StringType(), T.IntegerType()

# One row per listed contract.
CHAIN_SCHEMA = T.StructType(
    [
        T.StructField("symbol", STRING, False),
        T.StructField("expiration", T.DateType(), False),
        T.StructField("strike", DOUBLE, False),
        T.StructField("right", STRING, False),
        *(T.StructField(c, DOUBLE) for c in ("bid", "ask", "last", "close", "mid")),
        *(T.StructField(c, DOUBLE) for c in ("delta", "gamma", "theta", "vega")),
        T.StructField("implied_vol", DOUBLE),
        T.StructField("open_interest", DOUBLE),
        T.StructField("volume", DOUBLE),
        T.StructField("underlying_price", DOUBLE, False),
        T.StructField("dte", INT, False),
    ]
)

CONTRACT_KEY = ["symbol", "expiration", "strike", "right"]
# Types of the columns that datasets can be partitioned by.
KEY_TYPES = {"symbol": STRING, "right": STRING, "expiration": T.DateType()}

# The raw feed: many rows per contract, still in the vendor's field names.
GREEKS_SCHEMA = T.StructType(
    [T.StructField(c, DOUBLE) for c in ("delta", "gamma", "theta", "vega", "impliedVol")]
)
RAW_CONTRACT_KEY = ["symbol", "lastTradeDateOrContractMonth", "strike", "right"]
RAW_PRICES = ["bid", "ask", "last", "close", "marketPrice"]
RAW_SIZES = ["volume", "callOpenInterest", "putOpenInterest", "callVolume", "putVolume"]
TICK_SCHEMA = T.StructType(
    [
        T.StructField("symbol", STRING, False),
        T.StructField("lastTradeDateOrContractMonth", STRING, False),
        T.StructField("strike", DOUBLE, False),
        T.StructField("right", STRING, False),
        T.StructField("ts", T.TimestampNTZType(), False),
        *(T.StructField(c, DOUBLE) for c in RAW_PRICES + RAW_SIZES),
        T.StructField("modelGreeks", GREEKS_SCHEMA),
    ]
)

# Polls of the underlying, numbered in the order they were taken.
POLL_SCHEMA = T.StructType(
    [
        T.StructField("symbol", STRING, False),
        T.StructField("poll", INT, False),
        *(T.StructField(c, DOUBLE) for c in RAW_PRICES),
    ]
)

# What each venue lists for a symbol.
LISTING_SCHEMA = T.StructType(
    [
        T.StructField("symbol", STRING, False),
        T.StructField("exchange", STRING, False),
        T.StructField("expirations", T.ArrayType(STRING)),
        T.StructField("strikes", T.ArrayType(DOUBLE)),
    ]
)

# Result columns, in order (fixed values: they are the output contract).
RESULT_COLUMNS = {
    "option_chain": CHAIN_SCHEMA.fieldNames(),
    "spreads": """
        symbol expiration right strategy underlying_price spread_ratio short_strike
        pct_to_short_strike short_mid short_delta long_strike pct_to_long_strike long_mid
        long_delta credit width max_profit max_loss credit_yield ROC breakeven
        pct_to_breakeven dte net_delta net_gamma net_theta net_vega""".split(),
    "iron_condors": """
        symbol expiration put_short_strike put_long_strike call_short_strike call_long_strike
        put_credit call_credit total_credit put_width call_width max_profit max_loss
        spread_ratio credit_yield ROC lower_breakeven upper_breakeven underlying_price
        pct_to_lower_breakeven pct_to_upper_breakeven dte net_delta net_gamma net_theta
        net_vega""".split(),
    "strangles": """
        symbol expiration underlying_price put_strike call_strike put_mid call_mid
        total_premium lower_breakeven upper_breakeven breakeven_width pct_to_put_strike
        pct_to_call_strike pct_to_lower_breakeven pct_to_upper_breakeven ROC dte net_delta
        net_gamma net_theta net_vega put_delta call_delta put_implied_vol
        call_implied_vol""".split(),
    "iron_butterflies": """
        symbol expiration dte atm_strike put_wing_strike call_wing_strike wing_width
        short_put_mid short_call_mid long_put_mid long_call_mid total_credit max_profit
        max_loss spread_ratio credit_yield ROC lower_breakeven upper_breakeven
        underlying_price pct_to_atm_strike pct_to_lower_breakeven pct_to_upper_breakeven
        short_put_delta long_put_delta short_call_delta long_call_delta atm_put_iv
        atm_call_iv""".split(),
    "calendars": """
        symbol right strike near_expiration far_expiration near_dte far_dte dte_gap near_mid
        far_mid net_debit approx_max_profit approx_ROC theta_differential iv_differential
        underlying_price pct_to_strike near_delta far_delta near_iv far_iv near_theta
        far_theta""".split(),
    "expected_move": """
        symbol expiration dte underlying_price atm_call_strike atm_put_strike atm_call_mid
        atm_put_mid expected_move expected_move_contract move_pct upper_bound lower_bound
        avg_atm_iv""".split(),
    "max_pain": """
        symbol expiration dte underlying_price max_pain_strike call_pain put_pain total_pain
        pct_from_underlying""".split(),
}

DATASETS = list(RESULT_COLUMNS)
