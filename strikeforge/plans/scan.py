"""One scan: the chain is stored once, every computation reads it back."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from strikeforge.operators.at_the_money import (
    EXPIRATION_KEYS,
    expected_move,
    iron_butterflies,
)
from strikeforge.operators.calendars import CALENDAR_KEYS, calendars
from strikeforge.operators.ingest import require_unique_contracts
from strikeforge.operators.max_pain import max_pain, max_pain_curve
from strikeforge.operators.pairing import Layout, lay_out
from strikeforge.operators.strangles import strangles
from strikeforge.operators.verticals import VERTICAL_KEYS, iron_condors, vertical_spreads
from strikeforge.schema import DATASETS
from strikeforge.sources.tables import (
    STATISTICS, Profile, Stage, load_dataset, remove, remove_folders, write_profiled,
    write_statistics,
)

FILE_ORDER = ["symbol", "expiration"]
WRITERS = 3
GROUPINGS = {
    "verticals": VERTICAL_KEYS, "expirations": EXPIRATION_KEYS, "calendars": CALENDAR_KEYS,
}


class Strategies:
    """The seven computations over one stored chain.

    One counting job tells how to lay out the pairs; it runs when the first computation asks.
    Chains from ``build_chain`` have one row per contract; for any other, ask
    ``require_unique_contracts`` or pass ``unique_contracts=False``. ``groupings`` limits the
    counting to those the wanted computations pair by.
    """

    def __init__(
        self, chain: DataFrame, *, unique_contracts: bool = True,
        groupings: Sequence[str] = tuple(GROUPINGS),
    ):
        self.chain = chain
        self.unique_contracts = unique_contracts
        self.groupings = groupings

    @cached_property
    def layouts(self) -> dict[str, Layout]:
        return lay_out(self.chain, {name: GROUPINGS[name] for name in self.groupings})

    def spreads(self, ranked: bool = True) -> DataFrame:
        return vertical_spreads(
            self.chain,
            layout=self.layouts["verticals"],
            unique_contracts=self.unique_contracts,
            ranked=ranked,
        )

    def iron_condors(self, spreads: DataFrame | None = None) -> DataFrame:
        return iron_condors(self.spreads(ranked=False) if spreads is None else spreads)

    def strangles(self, ranked: bool = True) -> DataFrame:
        return strangles(self.chain, layout=self.layouts["expirations"], ranked=ranked)

    def iron_butterflies(self, ranked: bool = True) -> DataFrame:
        return iron_butterflies(self.chain, ranked=ranked)

    def calendars(self, ranked: bool = True) -> DataFrame:
        return calendars(self.chain, layout=self.layouts["calendars"], ranked=ranked)

    def expected_move(self) -> DataFrame:
        return expected_move(self.chain)

    def max_pain(self) -> DataFrame:
        return max_pain(self.chain)

    def max_pain_curve(self, include_all_candidates: bool = False) -> DataFrame:
        return max_pain_curve(self.chain, include_all_candidates=include_all_candidates)


def run_scan(
    spark: SparkSession, chain: DataFrame, out: str, *, check_unique: bool = True,
    by_symbol: bool = False, stored: bool = False,
) -> dict[str, int]:
    """Write the eight datasets under ``out`` and return their row counts.

    The chain is evaluated once, into the shared folder; ``stored`` says that it is read from
    files already. An empty chain stops the scan before anything is written to ``out``. Spreads are stored before the condors read them
    back. Pair tables are not sorted globally: readers rank what they filter. Datasets that
    do not depend on each other are written side by side, so a small one does not leave the
    cluster waiting on its last tasks. Repeated contracts would give wrong spreads, so they
    fail the scan first; ``check_unique=False`` trusts a chain from ``build_chain``, which has none.

    Sizes and NULL counts are taken by the writes and kept as a small table next to the datasets.
    ``by_symbol`` stores every dataset in one folder per symbol: a scan of some symbols then
    replaces theirs and leaves the files of all others as they are, and a screen of some reads only
    theirs. The counts returned are those of this scan; statistics of the whole are not kept.
    """
    stage = Stage(spark)
    try:
        if stored:
            if chain.isEmpty():
                return {}
        else:
            if not stage.write("chain", chain):
                return {}
            chain = stage.read("chain")
        if check_unique:
            require_unique_contracts(chain)
        profiles = _store_all(spark, Strategies(chain), out, ["symbol"] if by_symbol else [])
    finally:
        stage.drop()
    if by_symbol:
        remove(spark, f"{out}/{STATISTICS}")
    else:
        write_statistics(spark, out, profiles)
    return {name: profile.n_rows for name, profile in profiles.items()}


def _store_all(
    spark: SparkSession, run: Strategies, out: str, partition_by: Sequence[str]
) -> dict[str, Profile]:
    def store(name: str, df: DataFrame, order: Sequence[str] = ()) -> Profile:
        return write_profiled(df, f"{out}/{name}", order, partition_by, df.columns)

    first = {
        "option_chain": lambda: store("option_chain", run.chain, FILE_ORDER),
        "expected_move": lambda: store("expected_move", run.expected_move()),
    }
    after_counting = {
        "strangles": lambda: store(
            "strangles", run.strangles(ranked=False), [*FILE_ORDER, "put_strike"]
        ),
        "calendars": lambda: store(
            "calendars", run.calendars(ranked=False), [*CALENDAR_KEYS, "near_expiration"]
        ),
        "iron_butterflies": lambda: store(
            "iron_butterflies", run.iron_butterflies(ranked=False), FILE_ORDER
        ),
        "max_pain": lambda: store("max_pain", run.max_pain()),
    }
    in_thread = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=WRITERS) as pool:
        pending = {name: pool.submit(in_thread(write)) for name, write in first.items()}
        run.layouts  # counted once, before the other writers share it
        pending |= {name: pool.submit(in_thread(write)) for name, write in after_counting.items()}
        # Rows of one short leg side by side take less room.
        spread_order = [*FILE_ORDER, "right", "short_strike"]
        done = {"spreads": store("spreads", run.spreads(ranked=False), spread_order)}
        # What is stored of other symbols is not part of this scan.
        spreads = load_dataset(spark, out, "spreads")
        if partition_by:
            spreads = spreads.join(run.chain.select("symbol").distinct(), "symbol", "left_semi")
        done["iron_condors"] = store("iron_condors", run.iron_condors(spreads), FILE_ORDER)
        done |= {name: result.result() for name, result in pending.items()}
    if partition_by:
        # Symbols that this scan has looked at and that have no rows any more.
        (column,) = partition_by
        scanned = {row[0] for row in run.chain.select(column).distinct().collect()}
        for name, profile in done.items():
            remove_folders(spark, f"{out}/{name}", column, scanned - profile.folders)
    return {name: done[name] for name in DATASETS}
