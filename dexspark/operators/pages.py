"""Pages of rows by key: newest first, continued behind the last key seen, no offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST, MOST, USUAL = 1, 500, 50


def clamp(limit: int | None) -> int:
    return min(max(USUAL if limit is None else limit, LEAST), MOST)


def before_key(keys: list[str], after: tuple) -> Column:
    """(k1, k2, ...) < after, in the order of the keys."""
    out = F.lit(False)
    for key, value in reversed(list(zip(keys, after, strict=True))):
        out = (F.col(key) < value) | ((F.col(key) == value) & out)
    return out


def page(rows: DataFrame, keys: list[str], after: tuple | None = None, limit: int | None = None) -> DataFrame:
    """Up to ``limit`` rows with the greatest keys below after, with has_more on each."""
    size = clamp(limit)
    if after is not None:
        rows = rows.filter(before_key(keys, after))
    falling = [F.desc(k) for k in keys]
    # the window goes over the rows of one page and the one behind it
    more = F.count("*").over(Window.partitionBy(F.lit(0))) > size
    return rows.orderBy(*falling).limit(size + 1).withColumn("has_more", more).orderBy(*falling).limit(size)


def swaps_page(swaps: DataFrame, pool: str, after: tuple[int, int] | None = None, limit: int | None = None) -> DataFrame:
    return page(swaps.filter(F.col("pool") == pool), ["block_number", "log_index"], after, limit)


def candles_page(candles: DataFrame, pool: str, resolution: str, after: tuple | None = None, limit: int | None = None) -> DataFrame:
    if resolution not in ("1m", "1h", "1d"):
        raise ValueError(f"no such resolution: {resolution}")
    return page(candles.filter((F.col("pool") == pool) & (F.col("resolution") == resolution)), ["bucket"], after, limit)


def trades_page(consumed: DataFrame, wallet: Column | str, after: tuple[int, int, int] | None = None, limit: int | None = None) -> DataFrame:
    return page(consumed.filter(F.col("wallet") == wallet), ["sell_block", "sell_log", "consume_seq"], after, limit)


def new_pools_page(pools: DataFrame, after: tuple | None = None, limit: int | None = None) -> DataFrame:
    return page(pools, ["discovered_at", "address"], after, limit)


def indexed_pools(pools: DataFrame) -> DataFrame:
    return pools.filter("is_indexed").orderBy("address")


def pool_by_address(pools: DataFrame, address: str) -> DataFrame:
    return pools.filter(F.col("address") == address)


def ingest_status(state: DataFrame) -> DataFrame:
    """Adds lag = max(head - live, 0), null while either is unknown."""
    known = F.col("head_height").isNotNull() & F.col("live_cursor").isNotNull()
    return state.withColumn("lag", F.when(known, F.greatest(F.col("head_height") - F.col("live_cursor"), F.lit(0))))
