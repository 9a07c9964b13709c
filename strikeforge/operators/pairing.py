"""Pairing option legs, laid out by the number of pairs rather than by the size of the legs.

A strategy that pairs legs inside a group (one expiration of one symbol, say) produces rows
by the square of the group, which Spark cannot see from the size of its input: it packs
small-looking partitions into one task. So the groups are counted first, with a small job
over the stored chain. The counts give the number of tasks the pairs need. A group beyond
``TILE_LEGS`` is cut: its legs get a hashed tile number, and every left tile meets every
right tile under a join key of its own. The result is the same, and no task ever holds a
whole large group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import ceil
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeforge.functions.payoff import GREEKS
from strikeforge.sources.tables import Stage

TILE_LEGS = 2048
LEFT_TILE, RIGHT_TILE = "_left_tile", "_right_tile"


class Layout(NamedTuple):
    """How to lay out the pairs of one grouping."""

    hot: DataFrame | None = None  # groups to cut, with their number of tiles
    tasks: int | None = None  # None leaves it to Spark
    largest: int = 0  # legs of the largest group


def priced(chain: DataFrame) -> DataFrame:
    return chain.filter("mid IS NOT NULL")


def _sizes(legs: DataFrame, on: Sequence[str]) -> DataFrame:
    return legs.groupBy(*on).agg(F.count(F.lit(1)).alias("legs"))


def hot_groups(legs: DataFrame, on: Sequence[str], tile: int = TILE_LEGS) -> DataFrame:
    """Groups with more than ``tile`` legs and how many tiles each needs."""
    return (
        _sizes(legs, on)
        .filter(f"legs > {tile}")
        .selectExpr(*on, f"int(ceil(legs / {tile})) AS tiles")
    )


def lay_out(
    legs: DataFrame, groupings: Mapping[str, Sequence[str]], tile: int = TILE_LEGS
) -> dict[str, Layout]:
    """Count the groups of each grouping, combined before the shuffle, all in one job.

    One row per grouping comes back to the driver. Work below one tile per core is left to
    Spark, which may broadcast. Hot groups are stored in the shared folder, so that neither side
    of a join counts them again and Spark knows how many bytes they are.
    """
    cores, stage = legs.sparkSession.sparkContext.defaultParallelism, Stage(legs.sparkSession)
    counts = (
        _sizes(legs, on).selectExpr(
            f"'{name}' AS name", "sum(double(legs) * legs) AS pairs", "max(legs) AS largest"
        )
        for name, on in groupings.items()
    )
    result = {}
    for row in reduce(DataFrame.unionByName, counts).collect():
        largest = row.largest or 0
        tasks = ceil((row.pairs or 0) / tile**2)
        hot = None
        if largest > tile:
            stage.write(row.name, hot_groups(legs, groupings[row.name], tile))
            hot = stage.read(row.name)
        result[row.name] = Layout(hot, tasks if tasks > cores else None, largest)
    return result


def _tiled(
    legs: DataFrame,
    on: Sequence[str],
    hot: DataFrame,
    spread_by: Sequence[str],
    own: str | None,
    other: str | None,
) -> DataFrame:
    """Number the legs' own tile by hash and repeat them for each tile of the other side."""
    columns = list(legs.columns)
    legs = legs.join(hot, list(on), "left")
    tiles = "coalesce(tiles, 1)"
    if own:
        tile = f"int(pmod(xxhash64({', '.join(spread_by)}), {tiles})) AS {own}"
        legs = legs.selectExpr("*", tile)
        columns.append(own)
    if other:
        legs = legs.selectExpr("*", f"explode(sequence(0, {tiles} - 1)) AS {other}")
        columns.append(other)
    return legs.select(*columns)


def pair_legs(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    layout: Layout | None = None,
    left_by: Sequence[str] = (),
    right_by: Sequence[str] = (),
) -> DataFrame:
    """Inner equi-join of two leg tables that share only the ``on`` columns.

    Any further relation between the legs is a filter on the result, which the optimizer
    moves into the join. ``left_by`` / ``right_by`` name the columns that tell the legs of
    one group apart; a side without them is not cut. The stored table of hot groups is
    joined without a hint: Spark sees the size of its files and broadcasts it below its
    threshold, so that the legs are cut before their first shuffle.
    """
    keys, tiles = list(on), []
    hot, tasks, _ = layout or Layout()
    if hot is not None:
        own_left = LEFT_TILE if left_by else None
        own_right = RIGHT_TILE if right_by else None
        left = _tiled(left, on, hot, left_by, own_left, own_right)
        right = _tiled(right, on, hot, right_by, own_right, own_left)
        tiles = [t for t in (own_left, own_right) if t]
        keys += tiles
    if tasks is None:
        return left.join(right, keys).drop(*tiles)
    # Spark joins floating keys in a normalized form, for which it would shuffle once more: their
    # hashes are what rows are dealt and joined by, and pairs of one hash are compared.
    floating = [c for c in on if isinstance(left.schema[c].dataType, (T.FloatType, T.DoubleType))]
    for c in floating:
        hashed = F.xxhash64(F.col(c) + F.lit(0))
        left = left.withColumn(f"_{c}_hash", hashed)
        right = right.withColumn(f"_{c}_hash", hashed).withColumnRenamed(c, f"_other_{c}")
        keys[keys.index(c)] = f"_{c}_hash"
    pairs = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys)
    for c in floating:
        pairs = pairs.filter(f"{c} >= _other_{c} AND {c} <= _other_{c}")
    return pairs.drop(*tiles, *(f"_{c}_hash" for c in floating), *(f"_other_{c}" for c in floating))


def as_leg(
    contracts: DataFrame, role: str, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Keep the group keys and the leg's own columns, named after its role."""
    return contracts.selectExpr(*keys, *(f"{c} AS {role}_{c}" for c in columns))


LEG_COLUMNS = ["strike", "mid", *GREEKS]
