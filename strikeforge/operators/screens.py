"""Screens over stored results: filters that reach the Parquet scan, and rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALL = None  # the default choice: every value present, so NULL drops out
Choices = Mapping[str, Sequence | DataFrame | None]


def filter_choices(df: DataFrame, column: str) -> DataFrame:
    """The values a column filter offers."""
    return df.select(column).dropna().distinct().orderBy(column)


def choose(df: DataFrame, columns: Sequence[str], choices: Choices | None = None) -> DataFrame:
    """Keep rows whose value is chosen in every column the table has.

    A column without a choice keeps all values; an empty choice does not filter. A choice may
    be a table with that column, of any size: it is joined, and where ``df`` is stored in
    folders of the column, it decides at run time which of them are read. An empty table chooses
    nothing.
    """
    choices = choices or {}
    for column in (c for c in columns if c in df.columns):
        chosen = choices.get(column, ALL)
        if isinstance(chosen, DataFrame):
            df = df.join(chosen.select(column), column, "left_semi")
        elif chosen is ALL:
            df = df.filter(F.col(column).isNotNull())
        elif len(chosen):
            df = df.filter(F.col(column).isin(*chosen))
    return df


@dataclass(frozen=True)
class Thresholds:
    """Least values, in percent."""

    spread_ratio: float = 25.0
    pct_to_short_strike: float = 5.0
    pct_to_long_strike: float = 5.0
    credit_yield: float = 30.0


NO_THRESHOLDS = Thresholds(0.0, 0.0, 0.0, 0.0)


def default_thresholds(chain: DataFrame | None) -> Thresholds:
    """The usual limits, or none while there is no chain."""
    return NO_THRESHOLDS if chain is None or chain.isEmpty() else Thresholds()


def at_least(df: DataFrame, limits: Thresholds) -> DataFrame:
    """Apply each limit whose column the table has; NULL fails."""
    for column, limit in vars(limits).items():
        if column in df.columns:
            df = df.filter(F.col(column) >= limit)
    return df


def credit_spreads(
    spreads: DataFrame, choices: Choices | None = None, limits: Thresholds = Thresholds()
) -> DataFrame:
    rows = spreads.filter(F.col("strategy").contains("Credit"))
    rows = choose(rows, ["symbol", "expiration", "strategy"], choices)
    return at_least(rows, limits).orderBy(F.desc("spread_ratio"))


def debit_spreads(spreads: DataFrame, choices: Choices | None = None) -> DataFrame:
    """No limits apply to debit spreads."""
    rows = spreads.filter(F.col("strategy").contains("Debit"))
    rows = choose(rows, ["symbol", "expiration", "strategy"], choices)
    return rows.orderBy(F.desc("spread_ratio"))


def limited(
    df: DataFrame, choices: Choices | None = None, limits: Thresholds = Thresholds()
) -> DataFrame:
    """Iron condors and butterflies: choices, limits, best spread ratio first."""
    rows = at_least(choose(df, ["symbol", "expiration"], choices), limits)
    return rows.orderBy(F.desc("spread_ratio"))


def strangle_list(df: DataFrame, choices: Choices | None = None) -> DataFrame:
    return choose(df, ["symbol", "expiration"], choices).orderBy(F.desc("total_premium"))


def calendar_list(df: DataFrame, choices: Choices | None = None) -> DataFrame:
    rows = choose(df, ["symbol", "expiration", "right"], choices)
    return rows.orderBy(F.desc("theta_differential"))


def analytics_list(df: DataFrame, choices: Choices | None = None) -> DataFrame:
    """Expected move or max pain, in stored order."""
    return choose(df, ["symbol", "expiration"], choices)


def chain_list(chain: DataFrame, choices: Choices | None = None) -> DataFrame:
    rows = choose(chain, ["symbol", "expiration", "right"], choices)
    return rows.orderBy("symbol", "expiration", "strike")


def shown(df: DataFrame) -> int:
    """How many rows a screen shows."""
    return df.count()


def strategy_counts(spreads: DataFrame) -> DataFrame:
    return (
        spreads.groupBy("strategy")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "strategy")
    )


@dataclass(frozen=True)
class Board:
    """A top-10 list: which rows of a dataset, by what, and which strikes identify a row."""

    dataset: str
    metric: str
    strikes: Sequence[str]
    expirations: Sequence[str] = ("expiration",)
    label: str | None = None


BOARDS = {
    "credit": Board("spreads", "spread_ratio", ["short_strike", "long_strike"], label="Credit"),
    "debit": Board("spreads", "spread_ratio", ["short_strike", "long_strike"], label="Debit"),
    "condors": Board(
        "iron_condors", "spread_ratio",
        ["put_short_strike", "put_long_strike", "call_short_strike", "call_long_strike"],
    ),
    "butterflies": Board(
        "iron_butterflies", "spread_ratio", ["atm_strike", "put_wing_strike", "call_wing_strike"]
    ),
    "strangles": Board("strangles", "total_premium", ["put_strike", "call_strike"]),
    "calendars": Board(
        "calendars", "theta_differential", ["strike"], ["near_expiration", "far_expiration"]
    ),
}


def top_rows(df: DataFrame, board: Board, size: int = 10) -> DataFrame:
    """The best rows of one board, ties in contract order.

    Each task keeps its own best ``size`` rows, so nothing is sorted as a whole.
    """
    if board.label:
        df = df.filter(F.col("strategy").contains(board.label))
    right = ["right"] if "right" in df.columns else []
    ties = ["symbol", *board.expirations, *right, *board.strikes]
    return df.orderBy(F.desc_nulls_last(board.metric), *ties).limit(size)


def top_boards(datasets: Mapping[str, DataFrame], size: int = 10) -> DataFrame:
    """All boards in one table with a common shape."""
    return boards_of({name: datasets[board.dataset] for name, board in BOARDS.items()}, size)


def boards_of(rows: Mapping[str, DataFrame], size: int = 10) -> DataFrame:
    """The same from each board's own rows."""
    missing = F.lit(None)

    def shaped(name: str, board: Board) -> DataFrame:
        df = rows[name]
        has_right = "right" in df.columns
        top = top_rows(df, board, size)
        # At most ``size`` rows are left, so one unpartitioned window is safe here.
        ties = ["symbol", *board.expirations, *(["right"] if has_right else []), *board.strikes]
        place = F.row_number().over(Window.orderBy(F.desc_nulls_last(board.metric), *ties))
        near, *far = board.expirations
        strikes = [F.col(c) for c in board.strikes] + [missing] * (4 - len(board.strikes))
        return top.select(
            F.lit(name).alias("board"),
            place.alias("place"),
            F.col(board.metric).alias("metric"),
            "symbol",
            F.col(near).alias("expiration"),
            (F.col(far[0]) if far else missing).cast("date").alias("far_expiration"),
            (F.col("right") if has_right else missing).cast("string").alias("right"),
            *(s.cast("double").alias(f"strike_{i}") for i, s in enumerate(strikes, 1)),
        )

    return reduce(DataFrame.unionByName, (shaped(n, b) for n, b in BOARDS.items()))
