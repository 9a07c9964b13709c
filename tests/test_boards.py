"""Boards straight from the chain equal the boards of all pairs."""

from __future__ import annotations

import pytest
from chains import random_chain
from compare import spark_rows
from pyspark.sql import functions as F

from strikeforge.operators import screens
from strikeforge.plans import boards
from strikeforge.plans.scan import Strategies
from strikeforge.sources.tables import chain_from_rows


def stored(spark, folder, rows):
    chain_from_rows(spark, rows).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def all_boards(chain, size, unique_contracts=True):
    run = Strategies(chain, unique_contracts=unique_contracts)
    return screens.top_boards({
        "spreads": run.spreads(ranked=False), "iron_condors": run.iron_condors(),
        "iron_butterflies": run.iron_butterflies(), "strangles": run.strangles(ranked=False),
        "calendars": run.calendars(ranked=False),
    }, size)


@pytest.mark.parametrize("seed,size,repeats", [(1, 4, 1), (2, 10, 2)])
def test_boards_of_a_chain_equal_those_of_all_pairs(
    spark, tmp_path, monkeypatch, seed, size, repeats
):
    monkeypatch.setattr(boards, "PROBED", 2)
    chain = stored(spark, tmp_path / "chain", random_chain(seed, symbols=6) * repeats)
    found = boards.top_boards_of_chain(chain, size, unique_contracts=repeats == 1)
    assert spark_rows(found) == spark_rows(all_boards(chain, size, repeats == 1))


def test_no_ratio_is_above_its_bound(spark, tmp_path):
    chain = stored(spark, tmp_path / "chain", random_chain(3, symbols=6))
    bounds = boards.slope_bounds(chain)
    keys = ["symbol", "expiration", "right"]
    spreads = Strategies(chain).spreads(ranked=False).join(bounds, keys, "left")
    credit = F.col("strategy").contains("Credit")
    bound = F.when(credit, F.col("credit_bound")).otherwise(F.col("debit"))
    spreads = spreads.drop("credit").join(
        bounds.select(*keys, F.col("credit").alias("credit_bound")), keys, "left"
    )
    over = spreads.filter(bound.isNull() | (F.col("spread_ratio") > bound))
    assert spreads.count() and over.count() == 0


def test_far_groups_are_left_out(spark, tmp_path):
    rows = random_chain(4, symbols=30)
    chain = stored(spark, tmp_path / "chain", rows)
    for name in ("strangles", "calendars", "condors"):
        legs = boards.pruned_chain(chain, name, 1)
        assert 0 < legs.count() < len(rows) / 2, name
        assert legs.columns == chain.columns


def test_boards_of_few_and_of_no_rows(spark, tmp_path):
    chain = stored(spark, tmp_path / "chain", random_chain(5, symbols=1, expirations=2, strikes=4))
    found = boards.top_boards_of_chain(chain, 1000)
    assert spark_rows(found) == spark_rows(all_boards(chain, 1000))
    assert boards.top_boards_of_chain(chain.limit(0)).count() == 0
