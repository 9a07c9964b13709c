"""Registered queries: the engine's operators over tables derived from the given ones."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle.sql import oracle_sql as _oracle_sql
from strikeforge.functions.numbers import clean_double
from strikeforge.operators import ingest, quality, screens, universe
from strikeforge.operators.calendars import calendars
from strikeforge.operators.max_pain import max_pain
from strikeforge.operators.pairing import lay_out
from strikeforge.operators.verticals import VERTICAL_KEYS, vertical_spreads
from strikeforge.plans.boards import top_boards_of_chain
from strikeforge.plans.landed import Wanted, landed_chain, wanted_contracts
from strikeforge.plans.scan import Strategies, run_scan
from strikeforge.schema import CHAIN_SCHEMA, CONTRACT_KEY, DATASETS
from strikeforge.sources import bridge
from strikeforge.sources.landing import Landed, read_landed
from strikeforge.sources.tables import (
    Stage, folder_bytes, load_dataset, load_datasets, load_statistics, write_table,
)
from strikeforge.streaming.live import (
    LiveQuotes, buckets_for, latest_in_state, state_sized_for,
)

try:
    import corpus_pipeline
    from strikeforge.llm import queries as llm
except ModuleNotFoundError as missing:
    # The training-data operators can be left out; anything else that is missing is a fault.
    if missing.name not in ("corpus_pipeline", "strikeforge.llm"):
        raise
    llm = None

# A scan 45 days out, give or take 30.
SCAN = Wanted(bridge.AS_OF, bridge.MAIN_VENUE, dte_range=30)

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """What the queries read, all derived from the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.stage = Stage(spark)
        self._strategies: Strategies | None = None
        self._datasets: str | None = None
        self._written: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        return bridge.table(self.spark, self.sf_dir, name)

    def ticks(self, dealt: bool = True) -> DataFrame:
        return bridge.ticks(self.table("lineitem"), dealt)

    def latest(self) -> DataFrame:
        return ingest.latest_quotes(self.ticks(), bridge.NEWEST_BY, deal=False)

    def underlying(self) -> DataFrame:
        return universe.underlying_price(bridge.underlying_polls(self.table("supplier")))

    def listings(self) -> DataFrame:
        return bridge.listings(self.table("supplier"))

    def preferred(self) -> DataFrame:
        return universe.preferred_listing(self.listings(), bridge.MAIN_VENUE)

    def chain(self, **options) -> DataFrame:
        return ingest.build_chain(
            self.ticks(), self.underlying(), bridge.AS_OF, newest_by=bridge.NEWEST_BY, deal=False,
            **options,
        )

    def strategies(self) -> Strategies:
        """Over the stored chain, as in a scan: the ticks are read and reduced once."""
        if self._strategies is None:
            self.stage.write("chain", self.chain(keep_unpriced=True))
            self._strategies = Strategies(self.stage.read("chain"))
        return self._strategies

    def folder(self) -> str:
        """The stored results of one scan."""
        if self._datasets is None:
            self._datasets = f"{self.stage.path}/datasets"
            self._written = run_scan(
                self.spark, self.strategies().chain, self._datasets, stored=True
            )
        return self._datasets

    def written(self) -> dict[str, int]:
        """The row counts that the scan returned."""
        self.folder()
        return self._written

    def dataset(self, name: str) -> DataFrame:
        return load_dataset(self.spark, self.folder(), name)

    def limits(self) -> screens.Thresholds:
        return screens.default_thresholds(self.dataset("option_chain"))

    def statistics(self) -> DataFrame:
        return load_statistics(self.spark, self.folder())

    def datasets(self) -> dict[str, DataFrame]:
        return load_datasets(self.spark, self.folder(), DATASETS)


def symbol_universe(t: Tables) -> DataFrame:
    own, following = bridge.symbol_of("s_suppkey"), bridge.symbol_of("(s_suppkey + 1)")
    untidy = f"concat(' ', lower({own}), ' , ,', {following}, ',') AS symbols"
    lists = t.table("supplier").selectExpr(untidy)
    return universe.symbol_universe(lists, "symbols")


def ends_of(listing: DataFrame) -> DataFrame:
    return listing.select(
        "symbol",
        "exchange",
        F.size("expirations").alias("n_expirations"),
        F.array_min("expirations").alias("first_expiration"),
        F.array_max("expirations").alias("last_expiration"),
        F.size("strikes").alias("n_strikes"),
        F.array_min("strikes").alias("low_strike"),
        F.array_max("strikes").alias("high_strike"),
    )


def preferred_of_ties(t: Tables) -> DataFrame:
    listings = bridge.listing_ties(t.table("supplier"))
    return ends_of(universe.preferred_listing(listings, bridge.MAIN_VENUE))


def listed_contracts(t: Tables) -> DataFrame:
    listed = ingest.to_quotes(t.latest(), bridge.AS_OF).select(*CONTRACT_KEY)
    return wanted_contracts(t.listings(), t.underlying(), SCAN, listed)


def scan_chain(t: Tables) -> DataFrame:
    polls = bridge.underlying_polls(t.table("supplier"))
    return landed_chain(t.ticks(), polls, t.listings(), SCAN, newest_by=bridge.NEWEST_BY, deal=False)


def clean_numbers(t: Tables) -> DataFrame:
    text = """CASE WHEN l_linenumber = 1 THEN 'n/a' WHEN l_quantity > 40 THEN 'NaN'
        WHEN l_returnflag = 'R' THEN '-1' WHEN l_linestatus = 'O' THEN string(l_quantity) END"""
    return t.table("lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        f"{clean_double(text)} AS number",
        f"{clean_double(text, sentinel_to_null=True)} AS number_or_null",
    )


def quote_fields(t: Tables, *names: str) -> DataFrame:
    return ingest.to_quotes(t.latest(), bridge.AS_OF).select(*CONTRACT_KEY, *names)


def expiry_dte(t: Tables) -> DataFrame:
    fields = ingest.expiry_columns(bridge.AS_OF)
    return t.latest().selectExpr(
        "symbol", "strike", "right", f"{ingest.EXPIRY_FIELD} AS expiry_text",
        *(f"{c} AS {name}" for name, c in fields.items()),
    )


def filter_choices(t: Tables) -> DataFrame:
    offered = [(c, t.dataset("option_chain")) for c in ("symbol", "expiration", "right")]
    offered.append(("strategy", t.dataset("spreads")))
    return reduce(
        DataFrame.unionByName,
        (
            screens.filter_choices(df, c).select(
                F.lit(c).alias("column"), F.col(c).cast("string").alias("choice")
            )
            for c, df in offered
        ),
    )


def chain_describe(t: Tables) -> DataFrame:
    profile = quality.describe(t.dataset("option_chain"))
    rounded = ("mean", "std", *quality.QUARTILES)
    return profile.withColumns({c: F.round(c, 6) for c in rounded})


def spreads_of_repeats(t: Tables) -> DataFrame:
    """Every contract twice, as when two sources deliver the same chain."""
    chain = t.strategies().chain
    twice = ingest.union_sources(chain, chain)
    layout = lay_out(twice, {"verticals": VERTICAL_KEYS})["verticals"]
    return vertical_spreads(twice, layout=layout, ranked=False)


def scan_counts(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(t.written().items()), "dataset string, n_rows long")


def shown_rows(t: Tables) -> DataFrame:
    shown = [
        (name, screens.shown(show(t)))
        for name, show in OPERATORS.items()
        if name.startswith("screen_")
    ]
    return t.spark.createDataFrame(shown, "screen string, n_rows long")


def replay(
    t: Tables,
    on_snapshot: Callable[[DataFrame, int], None] | None = None,
    n_batches: int = 4,
    in_state: bool = False,
) -> LiveQuotes:
    """The tick log, landed as it arrives, read as a stream of ``n_batches`` at least until it is
    drained. Every batch but the first has ticks older than some before it.

    ``in_state`` reduces the ticks in Spark's state store, else each batch alone is reduced.
    """
    folder = Stage(t.spark).path
    for part in bridge.in_arrival_order(t.ticks(dealt=False)):
        part.write.mode("append").option("compression", "zstd").parquet(f"{folder}/landing")
    landed = t.spark.read.parquet(f"{folder}/landing")
    per_trigger = max(1, len(landed.inputFiles()) // n_batches)
    stream = t.spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", per_trigger)
    # The landed copy is the replay's own: its files go when their batch is done.
    stream = stream.option("cleanSource", "delete")
    ticks, mode = stream.parquet(f"{folder}/landing"), "append"
    if in_state:
        # Ticks are a year late at most, and a window of a year is as old when it ends.
        ticks, mode = latest_in_state(
            ticks, bridge.NEWEST_BY, delay="800 days", window="365 days"
        ), "update"
    landed_bytes = folder_bytes(t.spark, f"{folder}/landing")
    live = LiveQuotes(
        t.spark, f"{folder}/live", bridge.NEWEST_BY, as_of=lambda: bridge.AS_OF,
        on_snapshot=on_snapshot, n_buckets=buckets_for(landed_bytes),
    )
    writer = live.writer(ticks, mode).trigger(availableNow=True)
    sized = state_sized_for(t.spark, landed_bytes)
    with sized if in_state else nullcontext():
        query = writer.start()
    query.awaitTermination()
    return live


def live_chain(t: Tables) -> DataFrame:
    return ingest.to_quotes(replay(t).current(), bridge.AS_OF)


def live_state(t: Tables) -> DataFrame:
    return ingest.to_quotes(replay(t, in_state=True).current(), bridge.AS_OF)


def live_scan(t: Tables) -> DataFrame:
    """A whole scan per trigger; the condors stored by the last one."""
    out = f"{Stage(t.spark).path}/live-datasets"

    def scan(latest: DataFrame, _: int) -> None:
        quotes = ingest.to_quotes(latest, bridge.AS_OF)
        run_scan(latest.sparkSession, ingest.add_underlying(quotes, t.underlying()), out)

    replay(t, scan, n_batches=2)
    return load_dataset(t.spark, out, "iron_condors")


def landed_json(t: Tables) -> Landed:
    folder = f"{Stage(t.spark).path}/landed"
    bridge.spoilt_json(t.strategies().chain).write.text(folder)
    return read_landed(t.spark, folder, CHAIN_SCHEMA, "json")


def refused_rows(t: Tables) -> DataFrame:
    refused = landed_json(t).refused
    return refused.groupBy("reason").agg(F.count("record").alias("n_rows"))


def vendor_price(t: Tables) -> DataFrame:
    latest = ingest.latest_quotes(bridge.vendor_priced(t.ticks()), bridge.NEWEST_BY, deal=False)
    quotes = ingest.to_quotes(latest, bridge.AS_OF)
    return quotes.select(*CONTRACT_KEY, "mid").filter("mid IS NOT NULL")


def symbol_rerun(t: Tables) -> DataFrame:
    """The expected moves in one folder per symbol, some symbols' written once more."""
    folder, moves = f"{Stage(t.spark).path}/by-symbol", t.strategies().expected_move()
    write_table(moves, f"{folder}/expected_move", partition_by=["symbol"])
    again = moves.filter("symbol LIKE '%7'")
    write_table(again, f"{folder}/expected_move", partition_by=["symbol"])
    return load_dataset(t.spark, folder, "expected_move")


def screen_chosen(t: Tables) -> DataFrame:
    """Calendars of symbols and rights chosen by tables."""
    near = t.dataset("expected_move").filter("move_pct >= 10").select("symbol").distinct()
    rights = t.spark.range(1).selectExpr("'P' AS right")
    return screens.calendar_list(t.dataset("calendars"), {"symbol": near, "right": rights})


OPERATORS: dict[str, Callable[[Tables], DataFrame]] = {
    "chain_snapshot": lambda t: ingest.to_quotes(t.latest(), bridge.AS_OF),
    "symbol_universe": symbol_universe,
    "preferred_listing": lambda t: ends_of(t.preferred()),
    "preferred_listing_ties": preferred_of_ties,
    "dte_window": lambda t: universe.dte_window(t.preferred(), bridge.AS_OF, 44, 14),
    "strike_band": lambda t: universe.strike_band(t.preferred(), t.underlying(), 0.1),
    "contract_universe": lambda t: wanted_contracts(t.listings(), t.underlying(), SCAN),
    "listed_contracts": listed_contracts,
    "underlying_price": lambda t: t.underlying(),
    "underlying_price_ties": lambda t: universe.underlying_price(
        bridge.poll_ties(t.table("supplier"))
    ),
    "clean_numbers": clean_numbers,
    "best_price": lambda t: quote_fields(t, "mid").filter("mid IS NOT NULL"),
    "vendor_price": vendor_price,
    "flatten_greeks": lambda t: quote_fields(t, *ingest.GREEK_COLUMNS),
    "expiry_dte": expiry_dte,
    "oi_volume_by_right": lambda t: quote_fields(t, *ingest.SIZE_COLUMNS),
    "chain": lambda t: t.chain(),
    "scan_chain": scan_chain,
    "vertical_spreads": lambda t: t.strategies().spreads(),
    "vertical_spreads_repeated": spreads_of_repeats,
    "iron_condors": lambda t: t.strategies().iron_condors(),
    "iron_butterflies": lambda t: t.strategies().iron_butterflies(),
    "strangles": lambda t: t.strategies().strangles(),
    "calendars": lambda t: t.strategies().calendars(),
    "calendars_weekly": lambda t: calendars(bridge.weekly(t.strategies().chain)),
    "expected_move": lambda t: t.strategies().expected_move(),
    "max_pain": lambda t: t.strategies().max_pain(),
    "max_pain_sparse": lambda t: max_pain(bridge.weekly(t.strategies().chain)),
    "max_pain_curve": lambda t: t.strategies().max_pain_curve(),
    "max_pain_curve_all": lambda t: t.strategies().max_pain_curve(True),
    "dataset_roundtrip": lambda t: t.dataset("spreads"),
    "symbol_rerun": symbol_rerun,
    "typed_read": lambda t: landed_json(t).good,
    "refused_rows": refused_rows,
    "filter_choices": filter_choices,
    "screen_credit": lambda t: screens.credit_spreads(t.dataset("spreads"), limits=t.limits()),
    "screen_debit": lambda t: screens.debit_spreads(t.dataset("spreads")),
    "screen_condors": lambda t: screens.limited(t.dataset("iron_condors"), limits=t.limits()),
    "screen_butterflies": lambda t: screens.limited(
        t.dataset("iron_butterflies"), limits=t.limits()
    ),
    "screen_strangles": lambda t: screens.strangle_list(t.dataset("strangles"), {"symbol": []}),
    "screen_calendars": lambda t: screens.calendar_list(t.dataset("calendars"), {"right": ["P"]}),
    "screen_expected_move": lambda t: screens.analytics_list(t.dataset("expected_move")),
    "screen_max_pain": lambda t: screens.analytics_list(t.dataset("max_pain")),
    "screen_chain": lambda t: screens.chain_list(t.dataset("option_chain")),
    "screen_chosen": screen_chosen,
    "shown_rows": shown_rows,
    "scan_counts": scan_counts,
    "chain_preview": lambda t: quality.preview(t.dataset("option_chain").orderBy(*CONTRACT_KEY)),
    "quote_quality": lambda t: quality.quote_quality(t.dataset("option_chain")),
    "chain_describe": chain_describe,
    "strategy_counts": lambda t: screens.strategy_counts(t.dataset("spreads")),
    "top10_by_strategy": lambda t: screens.top_boards(t.datasets()),
    "top10_of_chain": lambda t: top_boards_of_chain(t.strategies().chain),
    "null_profile": lambda t: quality.stored_null_profile(t.statistics()),
    "null_profile_read": lambda t: quality.null_profile(t.datasets()),
    "dataset_sizes": lambda t: quality.stored_sizes(t.statistics()),
    "dataset_sizes_read": lambda t: quality.dataset_sizes(t.datasets()),
    "live_chain": live_chain,
    "live_state": live_state,
    "live_scan": live_scan,
}


def queries() -> dict[str, Query]:
    """All operators. Those over stored tables share one stored chain and one scan per
    session and table folder."""
    opened: dict[tuple[str, str], Tables] = {}

    def tables(spark: SparkSession, sf_dir: str) -> Tables:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in opened:
            opened[key] = Tables(spark, sf_dir)
        return opened[key]

    def registered(operator: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, sf_dir: operator(tables(spark, sf_dir))

    found = {name: registered(operator) for name, operator in OPERATORS.items()}
    if llm is not None:
        found |= llm.QUERIES | {"pipeline": corpus_pipeline.run}
    return found


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: every vertical spread of the derived chain."""
    return queries()["vertical_spreads"](spark, "/root/testdata/sf0.001")


def oracle_sql() -> dict[str, str]:
    """SQL for every operator over derived tables; of the training-data operators, for those
    that SQL can express."""
    return _oracle_sql() | (llm.ORACLE_SQL if llm is not None else {})
