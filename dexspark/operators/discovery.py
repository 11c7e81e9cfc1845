"""Discovery of new pools from factory events, with risk flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dexspark.operators.alerts import risk_flags
from dexspark.operators.decode import decode_mints, decode_pool_created
from dexspark.sources.tables import append_new

#: Blocks below the head that are looked at.
LOOKBACK = 250


def discover_pools(raw_logs: DataFrame, head: int, lookback: int = LOOKBACK, factory: str | None = None) -> DataFrame:
    """(address, token0, token1, fee, tick_spacing, created_block, providers, risk_flags)."""
    logs = raw_logs.filter((F.col("block_number") > head - lookback) & (F.col("block_number") <= head))
    made = decode_pool_created(logs if factory is None else logs.filter(F.col("address") == factory))
    providers = decode_mints(logs).groupBy(F.col("pool").alias("address")).agg(F.countDistinct("owner").alias("providers"))
    count = F.coalesce("providers", F.lit(0))
    return made.join(providers, "address", "left").select(
        "address", "token0", "token1", "fee", "tick_spacing", F.col("block_number").alias("created_block"), count.cast("long").alias("providers"), risk_flags(count).alias("risk_flags")
    )


def capture_pools(pools: DataFrame, found: DataFrame) -> DataFrame:
    """Pools not registered yet, as unindexed rows."""
    return append_new(pools, found.withColumn("is_indexed", F.lit(False)), ["address"])
