"""Cleaning of raw feed numbers. Functions here and next door give Spark SQL expressions."""

from __future__ import annotations


def clean_double(value: str, sentinel_to_null: bool = False) -> str:
    """Read a raw value as double; missing, unparsable and NaN become NULL.

    The feed's -1 sentinel and infinities pass, unless ``sentinel_to_null`` asks for
    -1 to become NULL too. ``nanvl`` passes on its second argument for NaN.
    """
    number = f"nanvl(try_cast({value} AS double), NULL)"
    return f"nullif({number}, -1D)" if sentinel_to_null else number


def if_positive(value: str) -> str:
    return f"CASE WHEN {value} > 0 THEN {value} END"


def if_finite(value: str) -> str:
    """NaN sorts above infinity, so one comparison excludes both."""
    return f"CASE WHEN abs({value}) < double('infinity') THEN {value} END"


def percent(part: str, whole: str) -> str:
    """``part / whole * 100``; NULL where the divisor is zero."""
    return f"try_divide({part}, {whole}) * 100"
