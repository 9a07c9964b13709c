"""Top-10 boards straight from the chain, without making the pairs that cannot reach them.

Every board's metric has a bound per group of legs that an aggregate over the legs gives. The
groups with the highest bounds are paired first; their best rows set a mark, and only groups, and
where possible legs, whose bound reaches the mark are paired at all. Bounds are never below
the metric, ties included, so the boards equal those of stored results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeforge.functions.payoff import per_contract
from strikeforge.operators.calendars import CALENDAR_KEYS
from strikeforge.operators.pairing import priced
from strikeforge.operators.screens import BOARDS, Board, boards_of, top_rows
from strikeforge.operators.strangles import STRANGLE_KEYS
from strikeforge.operators.verticals import VERTICAL_KEYS
from strikeforge.plans.scan import WRITERS, Strategies
from strikeforge.sources.tables import Stage

#: Groups that are paired first, and how many more of them if they have too few rows.
PROBED, PROBED_MORE = 64, 8
#: The slope of a pair is a mean of the slopes between its strikes, up to rounding.
ROUNDING = 1e-9


def slope_bounds(chain: DataFrame) -> DataFrame:
    """``symbol, expiration, right, debit, credit``: no spread ratio of the group is above.

    Between two strikes the premium changes by the sum of the changes from strike to strike, so
    its share of the width is at most the steepest of those. Both legs of a credit spread are on
    the side that is not in the money, so for ``credit`` only steps there count. Of repeated contracts
    the extremes of a strike count.
    """
    strikes = priced(chain).groupBy(*VERTICAL_KEYS, "strike").agg(
        F.min("mid").alias("low"), F.max("mid").alias("high"),
        F.min("underlying_price").alias("under"), F.max("underlying_price").alias("over"),
    )
    group = Window.partitionBy(*VERTICAL_KEYS)
    upwards = group.orderBy("strike")
    steps = strikes.select(
        "*",
        *(F.lead(c).over(upwards).alias(f"next_{c}") for c in ("strike", "low", "high")),
        F.min("under").over(group).alias("least"), F.max("over").over(group).alias("most"),
    ).selectExpr(
        *VERTICAL_KEYS,
        "greatest(abs(next_high - low), abs(high - next_low)) / (next_strike - strike) AS slope",
        "CASE WHEN right = 'P' THEN next_strike <= most ELSE strike >= least END AS outside",
    )
    ratio = f"least(slope, 1.0D) * {100 * (1 + ROUNDING)!r}D"
    return steps.filter("slope IS NOT NULL").groupBy(*VERTICAL_KEYS).agg(
        F.expr(f"max({ratio}) AS debit"), F.expr(f"max({ratio}) FILTER (WHERE outside) AS credit")
    )


def _credit_bounds(chain: DataFrame) -> DataFrame:
    return slope_bounds(chain).withColumnRenamed("credit", "bound")


def _debit_bounds(chain: DataFrame) -> DataFrame:
    return slope_bounds(chain).withColumnRenamed("debit", "bound")


def _condor_bounds(chain: DataFrame) -> DataFrame:
    """A condor's ratio is at most the sum of its sides' ratios: both share the wider width."""
    return slope_bounds(chain).groupBy("symbol", "expiration").agg(F.expr(
        """max(credit) FILTER (WHERE right = 'P') + max(credit) FILTER (WHERE right = 'C') AS bound"""
    ))


def _strangle_bounds(chain: DataFrame) -> DataFrame:
    best = priced(chain).groupBy(*STRANGLE_KEYS).agg(
        F.expr("max(mid) FILTER (WHERE right = 'P' AND strike < underlying_price) AS best_put"),
        F.expr("max(mid) FILTER (WHERE right = 'C' AND strike > underlying_price) AS best_call"),
    )
    return best.selectExpr("*", f"{per_contract('(best_put + best_call)')} AS bound")


def _calendar_bounds(chain: DataFrame) -> DataFrame:
    thetas = priced(chain).groupBy(*CALENDAR_KEYS).agg(
        F.max("theta").alias("most"), F.min("theta").alias("least")
    )
    return thetas.selectExpr("*", "most - least AS bound")


@dataclass(frozen=True)
class Pruning:
    """How a board bounds its metric: per group, and per leg by the group's extremes."""

    grouping: str  # what the strategy pairs by
    keys: Sequence[str]
    bounds: Callable[[DataFrame], DataFrame]
    rows: Callable[[Strategies], DataFrame]
    leg: str | None = None

    def rows_of(self, legs: DataFrame, unique_contracts: bool) -> DataFrame:
        run = Strategies(legs, unique_contracts=unique_contracts, groupings=[self.grouping])
        return self.rows(run)


STRANGLE_LEG = f"""CASE right WHEN 'P' THEN {per_contract('(mid + best_call)')}
    ELSE {per_contract('(best_put + mid)')} END"""
CALENDAR_LEG = "greatest(theta - least, most - theta)"
PRUNED = {
    "credit": Pruning(
        "verticals", VERTICAL_KEYS, _credit_bounds, lambda s: s.spreads(ranked=False)
    ),
    "debit": Pruning(
        "verticals", VERTICAL_KEYS, _debit_bounds, lambda s: s.spreads(ranked=False)
    ),
    "condors": Pruning(
        "verticals", ["symbol", "expiration"], _condor_bounds, lambda s: s.iron_condors()
    ),
    "strangles": Pruning(
        "expirations", STRANGLE_KEYS, _strangle_bounds, lambda s: s.strangles(ranked=False),
        STRANGLE_LEG,
    ),
    "calendars": Pruning(
        "calendars", CALENDAR_KEYS, _calendar_bounds, lambda s: s.calendars(ranked=False),
        CALENDAR_LEG,
    ),
}


def _mark(
    chain: DataFrame, bounds: DataFrame, pruning: Pruning, board: Board, size: int,
    unique_contracts: bool,
) -> float | None:
    """A metric that the best ``size`` rows reach, None if there are fewer rows than that."""
    probed, groups = PROBED, bounds.count()
    while True:
        likely = bounds.orderBy(F.desc_nulls_last("bound"), *pruning.keys).limit(probed)
        legs = chain.join(likely.select(*pruning.keys), list(pruning.keys), "left_semi")
        rows = pruning.rows_of(legs, unique_contracts)
        best = top_rows(rows, board, size).select(board.metric).collect()
        if len(best) == size and best[-1][0] is not None:
            return best[-1][0]
        if probed >= groups:
            return None
        probed *= PROBED_MORE


def pruned_chain(
    chain: DataFrame, name: str, size: int = 10, *, unique_contracts: bool = True
) -> DataFrame:
    """The part of a stored chain that holds every leg of the best ``size`` rows of a board.

    ``size`` numbers reach the driver. Groups without a bound, a single leg say, have no rows. A
    chain with fewer rows than ``size`` for the board is returned whole, an empty one too.
    """
    pruning, stage = PRUNED[name], Stage(chain.sparkSession)
    stage.write(name, pruning.bounds(chain))
    bounds = stage.read(name)
    mark = _mark(chain, bounds, pruning, BOARDS[name], size, unique_contracts)
    if mark is None:
        return chain
    within = bounds.filter(F.col("bound") >= mark)
    if pruning.leg is None:
        return chain.join(within.select(*pruning.keys), list(pruning.keys), "left_semi")
    legs = chain.join(within, list(pruning.keys)).filter(F.expr(pruning.leg) >= mark)
    return legs.select(*chain.columns)


def top_boards_of_chain(
    chain: DataFrame, size: int = 10, *, unique_contracts: bool = True
) -> DataFrame:
    """``screens.top_boards`` of a stored chain whose strategies are not stored.

    Butterflies are linear in the chain and not pruned. The small jobs that set the marks of the
    boards run side by side.
    """
    def rows(name: str) -> DataFrame:
        if name not in PRUNED:
            return Strategies(chain).iron_butterflies(ranked=False)
        legs = pruned_chain(chain, name, size, unique_contracts=unique_contracts)
        return PRUNED[name].rows_of(legs, unique_contracts)

    in_thread = inheritable_thread_target(chain.sparkSession)
    with ThreadPoolExecutor(max_workers=WRITERS) as pool:
        pending = {name: pool.submit(in_thread(rows), name) for name in BOARDS}
        return boards_of({name: result.result() for name, result in pending.items()}, size)
