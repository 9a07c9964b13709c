"""``spark-submit``-able scan: landed tables in, eight datasets out."""

from __future__ import annotations

import argparse
import logging
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from strikeforge.operators.universe import parse_symbols
from strikeforge.plans.landed import Wanted, landed_chain
from strikeforge.plans.scan import run_scan
from strikeforge.schema import LISTING_SCHEMA, POLL_SCHEMA, TICK_SCHEMA
from strikeforge.sources.landing import read_landed
from strikeforge.sources.tables import read_table, write_table

log = logging.getLogger("strikeforge")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="strikeforge", description=__doc__)
    for name in ("ticks", "polls", "listings", "out"):
        parser.add_argument(f"--{name}", required=True, help="folder")
    parser.add_argument("--exchange", required=True, help="preferred venue")
    parser.add_argument("--format", default="parquet", help="format of the landed tables")
    parser.add_argument("--refused", help="folder for landed rows that do not fit their schema")
    parser.add_argument(
        "--by-symbol", action="store_true", help="store in symbol folders, replace only those scanned"
    )
    parser.add_argument("--symbols", default="", help="comma list; blank means all")
    parser.add_argument("--as-of", type=date.fromisoformat, default=None, help="UTC today if left out")
    parser.add_argument("--target-dte", type=int, default=45)
    parser.add_argument("--dte-range", type=int, default=7)
    parser.add_argument("--strike-pct", type=float, default=0.20)
    return parser.parse_args(argv)


def landed_rows(
    spark: SparkSession, path: str, schema: StructType, fmt: str, refused: str | None
) -> DataFrame:
    """A landed table; rows that do not fit are stored under ``refused``, if it is given."""
    if not refused:
        return read_table(spark, path, schema, fmt)
    landed = read_landed(spark, path, schema, fmt)
    n_refused = write_table(landed.refused, refused)
    if n_refused:
        log.warning("%s: %d rows refused, see %s", path, n_refused, refused)
    return landed.good


def main(argv: list[str] | None = None) -> dict[str, int]:
    logging.basicConfig(level=logging.INFO)
    args = arguments(argv)
    spark = SparkSession.builder.appName("strikeforge").getOrCreate()
    tables = [
        landed_rows(spark, path, schema, args.format, args.refused and f"{args.refused}/{name}")
        for name, path, schema in (
            ("ticks", args.ticks, TICK_SCHEMA),
            ("polls", args.polls, POLL_SCHEMA),
            ("listings", args.listings, LISTING_SCHEMA),
        )
    ]
    wanted = Wanted(
        as_of=args.as_of or datetime.now(timezone.utc).date(),
        exchange=args.exchange,
        symbols=parse_symbols(args.symbols),
        target_dte=args.target_dte,
        dte_range=args.dte_range,
        strike_pct=args.strike_pct,
    )
    rows = run_scan(spark, landed_chain(*tables, wanted), args.out, by_symbol=args.by_symbol)
    if not rows:
        log.error("no option chain rows, nothing written")
    for name, count in rows.items():
        log.info("%s: %d rows", name, count)
    return rows


if __name__ == "__main__":
    main()
