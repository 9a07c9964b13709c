"""Option-chain analytics on Spark DataFrames."""

from strikeforge.operators.at_the_money import expected_move, iron_butterflies
from strikeforge.operators.calendars import calendars
from strikeforge.operators.ingest import build_chain, require_unique_contracts
from strikeforge.operators.max_pain import max_pain, max_pain_curve
from strikeforge.operators.strangles import strangles
from strikeforge.operators.verticals import iron_condors, vertical_spreads
from strikeforge.plans.scan import Strategies, run_scan
from strikeforge.schema import CHAIN_SCHEMA, DATASETS
from strikeforge.streaming.live import LiveQuotes

__all__ = [
    "CHAIN_SCHEMA", "DATASETS", "LiveQuotes", "Strategies", "build_chain", "calendars",
    "expected_move", "iron_butterflies", "iron_condors", "max_pain", "max_pain_curve",
    "require_unique_contracts", "run_scan", "strangles", "vertical_spreads",
]
