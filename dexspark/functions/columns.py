"""Column helpers: the total order of events, prices and scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dexspark.schemas import KEY_STEP


def event_key(block: str = "block_number", log: str = "log_index") -> Column:
    """One long that orders events as (block, log) do; hashed aggregates take it, structs they don't."""
    return F.col(block) * F.lit(KEY_STEP) + F.col(log)


def price_from_sqrt(sqrt: Column) -> Column:
    """Price of token 0 in token 1, raw units, from a square root price in 96-bit fixed point."""
    return F.pow(sqrt.cast("double") / F.lit(2.0**96), F.lit(2))


def human_units(raw: Column, decimals: Column) -> Column:
    """raw / 10^decimals as a double, for display and valuation only."""
    return raw.cast("double") / F.pow(F.lit(10.0), decimals)


def address_text(raw: Column) -> Column:
    """0x and lower-case hex of binary addresses."""
    return F.concat(F.lit("0x"), F.lower(F.hex(raw)))


def epoch(time: Column) -> Column:
    return F.unix_timestamp(time)
