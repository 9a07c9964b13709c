"""Raw option tables derived from the TPC-H-like test tables.

The test tables hold no options, so ``lineitem`` serves as a tick log (supplier = symbol,
line number = expiration, part = strike, order parity = right) and ``supplier`` gives the
underlying prices and venue listings. All formulas use only exact or IEEE-basic arithmetic,
so another engine computes the same values bit for bit.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the derivation.
AS_OF = date(2026, 4, 1)
FIRST_EXPIRATION = date(2026, 4, 17)
FIRST_DTE = 16
EXPIRATION_STEP = 14
EXPIRATIONS = 7
STRIKE_STEP = 2.5
STRIKES_EACH_SIDE = 6
MAIN_VENUE, SECOND_VENUE, THIRD_VENUE = "MAIN", "ALT", "REGIONAL"

# Ordering of ticks: time, then everything else that tells two rows apart.
TIE_BREAKERS = [
    "l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]
NEWEST_BY = ("ts", "sequence")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_of(key: str) -> str:
    """``SYM`` and at least four digits; longer keys keep all theirs."""
    return f"concat('SYM', if({key} < 10000, lpad({key}, 4, '0'), string({key})))"


def price_of(key: str) -> str:
    return f"50D + pmod({key} * 37, 400) * 0.5D"


MIDDLE_STRIKE = "floor(u / 2.5D) * 2.5D"


def _expiry_text(number: str) -> str:
    """The n-th expiration as ``yyyyMMdd``."""
    day = f"date_add(DATE '{FIRST_EXPIRATION}', {EXPIRATION_STEP} * ({number}))"
    return f"replace(string({day}), '-', '')"


def _cents(amount: str, factor: int) -> str:
    return f"floor({amount} * {factor}D + 0.5D) / 100D"


def ticks(lineitem: DataFrame, dealt: bool = False) -> DataFrame:
    """The tick log in the raw feed's form, with NaN, -1 and missing Greeks as a feed has them.

    ``dealt`` lays them out by contract while the records are narrow, in partitions of the size
    that adaptive execution advises; a contract with very many ticks still takes several. Whoever
    reduces the ticks need not deal the wide ones.
    """
    nan = "double('NaN')"
    quoted = "NOT (l_returnflag = 'R' AND l_discount >= 0.09D)"
    own_volume = f"if(l_linenumber % 2 = 0, l_quantity, {nan})"
    lineitem = lineitem.selectExpr(
        "*", "l_partkey % 13 AS place", "if(l_orderkey % 2 = 0, 'C', 'P') AS right"
    )
    if dealt:
        lineitem = lineitem.hint("rebalance", "l_suppkey", "l_linenumber", "place", "right")
    return lineitem.selectExpr(
        "*",
        f"{price_of('l_suppkey')} AS u",
        f"int({FIRST_DTE} + {EXPIRATION_STEP} * (l_linenumber - 1)) AS dte",
        f"{MIDDLE_STRIKE} + {STRIKE_STEP}D * (place - {STRIKES_EACH_SIDE}) AS strike",
        "greatest(if(right = 'C', u - strike, strike - u), 0D) AS intrinsic",
        "u * dte * 0.0008D / (1D + 10D * abs(strike - u) / u) * (1D + l_tax) AS tv",
        "intrinsic + tv AS value",
    ).selectExpr(
        f"{symbol_of('l_suppkey')} AS symbol",
        f"{_expiry_text('l_linenumber - 1')} AS lastTradeDateOrContractMonth",
        "strike",
        "right",
        "l_shipdate AS ts",
        f"struct({', '.join(TIE_BREAKERS)}) AS sequence",
        f"if({quoted}, {_cents('value', 98)}, -1D) AS bid",
        f"if({quoted}, {_cents('value', 102)}, -1D) AS ask",
        f"if(l_quantity > 40, {nan}, {_cents('value', 100)}) AS last",
        f"if(l_tax >= 0.07D, NULL, {_cents('value', 99)}) AS close",
        f"if(l_linestatus = 'O', double('infinity'), {nan}) AS marketPrice",
        "l_quantity AS volume",
        "if(right = 'C', l_quantity * 10, 0D) AS callOpenInterest",
        "if(right = 'C', 0D, l_quantity * 10) AS putOpenInterest",
        f"if(right = 'C', {own_volume}, 1D) AS callVolume",
        f"if(right = 'C', 1D, {own_volume}) AS putVolume",
        """if(l_tax < 0.08D, struct(
            0.5D + 0.5D * ((u - strike) / u) - if(right = 'C', 0D, 1D) AS delta,
            1D / (u + 10D * abs(strike - u)) AS gamma,
            -tv / dte AS theta,
            0.01D * tv AS vega,
            0.2D + l_discount AS impliedVol), NULL) AS modelGreeks""",
    )


def underlying_polls(supplier: DataFrame) -> DataFrame:
    """Three polls per symbol: even keys have no price at first, and prices drift later."""
    nan = "double('NaN')"

    def poll(number: int, bid: str, ask: str, last: str) -> str:
        return f"""struct({number} AS poll, {bid} AS bid, {ask} AS ask, {last} AS last,
            double(NULL) AS close, {nan} AS marketPrice)"""

    polls = [
        poll(1, "if(even, -1D, u - 0.25D)", "if(even, -1D, u + 0.25D)", nan),
        poll(2, "-1D", "-1D", "if(even, u, u + 0.25D)"),
        poll(3, "u", "u + 1D", nan),
    ]
    return (
        supplier.selectExpr(
            f"{symbol_of('s_suppkey')} AS symbol",
            f"{price_of('s_suppkey')} AS u",
            "s_suppkey % 2 = 0 AS even",
        )
        .selectExpr("symbol", f"explode(array({', '.join(polls)})) AS p")
        .select("symbol", "p.*")
    )


def listings(supplier: DataFrame) -> DataFrame:
    """Venue listings: the main venue lists everything, others every second entry.

    Keys ending in 3 are not on the main venue.
    """

    def venue(name: str, step: int) -> str:
        expirations = f"sequence(0, {EXPIRATIONS - 1}, {step})"
        strikes = f"sequence(-{STRIKES_EACH_SIDE}, {STRIKES_EACH_SIDE}, {step})"
        return f"""struct('{name}' AS exchange,
            transform({expirations}, i -> {_expiry_text('i')}) AS expirations,
            transform({strikes}, i -> {MIDDLE_STRIKE} + {STRIKE_STEP}D * i) AS strikes)"""

    first = f"if(s_suppkey % 10 = 3, {venue(THIRD_VENUE, 2)}, {venue(MAIN_VENUE, 1)})"
    return (
        supplier.selectExpr("*", f"{price_of('s_suppkey')} AS u")
        .selectExpr(
            f"{symbol_of('s_suppkey')} AS symbol",
            f"explode(array({first}, {venue(SECOND_VENUE, 2)})) AS v",
        )
        .select("symbol", "v.*")
    )


# -- variants in which rules decide that the tables above always meet


def listing_ties(supplier: DataFrame) -> DataFrame:
    """Listings with several records of one venue, their entries in falling order, and with
    records that name no venue."""
    plain = listings(supplier)
    number = "int(substr(symbol, 4))"
    again = plain.filter(f"{number} % 3 = 0").selectExpr(
        "symbol", "exchange",
        "reverse(slice(expirations, 1 + int(exchange = 'ALT'), 3)) AS expirations",
        "reverse(strikes) AS strikes",
    )
    nameless = plain.filter(f"{number} % 5 = 0").selectExpr(
        "symbol", "string(NULL) AS exchange", "slice(expirations, 1, 1) AS expirations", "strikes"
    )
    return plain.unionByName(again).unionByName(nameless)


def poll_ties(supplier: DataFrame) -> DataFrame:
    """Polls with one number twice, without a number, and symbols that are never priced."""
    number = "int(substr(symbol, 4))"
    plain = underlying_polls(supplier).filter(f"{number} % 11 <> 0")
    price = price_of(number)

    def more(which: str, poll: str, last: str) -> DataFrame:
        return plain.sparkSession.createDataFrame([], plain.schema).unionByName(
            supplier.selectExpr(f"{symbol_of('s_suppkey')} AS symbol").filter(which).selectExpr(
                "symbol", f"int({poll}) AS poll", "-1D AS bid", "-1D AS ask", f"{last} AS last",
                "double(NULL) AS close", "double('NaN') AS marketPrice",
            )
        )

    numbered = f"{number} % 11 <> 0"
    return (
        plain.unionByName(more(f"{number} % 4 = 0 AND {numbered}", "2", f"{price} - 1D"))
        .unionByName(more(f"{number} % 4 = 1 AND {numbered}", "1", f"{price} - 2D"))
        .unionByName(more(f"{number} % 7 = 0", "NULL", "1D"))
    )


def vendor_priced(ticks: DataFrame) -> DataFrame:
    """Ticks without last and close, so that the vendor's price decides where nothing is quoted."""
    return ticks.withColumns({
        "last": F.lit(float("nan")), "close": F.lit(None).cast("double"),
        "marketPrice": F.expr("""CASE WHEN volume > 40 THEN double('infinity') WHEN volume > 30
            THEN double('NaN') WHEN volume > 20 THEN -1D ELSE strike / 4D END"""),
    })


def weekly(chain: DataFrame) -> DataFrame:
    """Expirations five days apart, and contracts with none or unknown open interest."""
    nth = f"(dte - {FIRST_DTE}) div {EXPIRATION_STEP}"
    return chain.withColumns({
        "dte": F.expr(f"int({FIRST_DTE} + 5 * ({nth}))"),
        "expiration": F.expr(f"date_add(DATE '{AS_OF}', int({FIRST_DTE} + 5 * ({nth})))"),
        "open_interest": F.expr("""CASE int(strike * 2D + dte) % 3
            WHEN 0 THEN 0D WHEN 1 THEN open_interest END"""),
    })


def spoilt_json(chain: DataFrame) -> DataFrame:
    """The chain as JSON lines: some cut off, some with text for a number, some without a field that
    every contract has."""
    fields = ", ".join(chain.columns)
    without = {c: fields.replace(c, f"string(NULL) AS {c}") for c in ("symbol", "underlying_price")}
    whole = f"to_json(struct({fields}))"
    return chain.selectExpr(f"""CASE
        WHEN strike % 25 = 0 AND right = 'C' THEN substring({whole}, 1, 40)
        WHEN strike % 25 = 5 AND right = 'P' THEN to_json(struct({without["symbol"]}))
        WHEN strike % 25 = 10 AND right = 'P' THEN replace({whole}, '"dte":', '"dte":"in "')
        WHEN strike % 25 = 15 AND right = 'C' THEN to_json(struct({without["underlying_price"]}))
        ELSE {whole} END AS value""")


def in_arrival_order(ticks: DataFrame) -> list[DataFrame]:
    """The tick log as it arrives, year by year; one tick in ten arrives a year late."""
    arrival = "year(ts) + int(sequence.l_orderkey % 10 = 0)"
    years = ticks.selectExpr(f"{arrival} AS y").distinct().orderBy("y").collect()
    return [ticks.filter(f"{arrival} = {row.y}") for row in years]
