"""Price candles: building, merging, rolling up and repairing after a revert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dexspark.functions import wide
from dexspark.functions.columns import event_key

UNITS = {"1m": "minute", "1h": "hour", "1d": "day"}


def _merged(rows: DataFrame, bucket: Column, resolution: Column) -> DataFrame:
    """One row per pool, bucket and resolution; the order keys decide open and close, not the input order."""
    return (
        rows.groupBy("pool", bucket.alias("bucket"), resolution.alias("resolution"))
        .agg(
            F.min_by("open", "open_key").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "close_key").alias("close"),
            F.sum("volume0").cast("decimal(38,0)").alias("volume0"),
            F.sum("volume1").cast("decimal(38,0)").alias("volume1"),
            F.sum("trade_count").alias("trade_count"),
            F.min("open_key").alias("open_key"),
            F.max("close_key").alias("close_key"),
        )
    )


def candles(swaps: DataFrame, resolution: str = "1m") -> DataFrame:
    """Candles of swaps (pool, block_time, price, amount0, amount1, block_number, log_index).

    Open and close are the prices of the first and last event of the bucket; empty buckets have
    no row.
    """
    single = swaps.select(
        "pool",
        "block_time",
        *[F.col("price").alias(c) for c in ("open", "high", "low", "close")],
        F.abs("amount0").cast("decimal(38,0)").alias("volume0"),
        F.abs("amount1").cast("decimal(38,0)").alias("volume1"),
        F.lit(1).cast("long").alias("trade_count"),
        event_key().alias("open_key"),
        event_key().alias("close_key"),
    )
    return _merged(single, F.date_trunc(UNITS[resolution], "block_time"), F.lit(resolution))


VOLUMES = ("volume0", "volume1")


def wide_candles(swaps: DataFrame, resolution: str = "1m") -> DataFrame:
    """Candles of swaps whose amounts are limbs of 256-bit words: volumes are limbs, exact beyond 38 digits."""
    plain = candles(swaps.withColumns({"amount0": F.lit(0), "amount1": F.lit(0)}), resolution).drop(*VOLUMES)
    own = swaps.select("pool", F.date_trunc(UNITS[resolution], "block_time").alias("bucket"), *[wide.magnitude(F.col(f"amount{k}")).alias(v) for k, v in enumerate(VOLUMES)])
    return plain.join(_wide_sums(own, F.col("bucket")), ["pool", "bucket"])


def _wide_sums(rows: DataFrame, bucket: Column) -> DataFrame:
    sums = rows.groupBy("pool", bucket.alias("bucket")).agg(*[wide.total(F.col(v)).alias(v) for v in VOLUMES])
    return sums.withColumns({v: wide.carried(F.col(v)) for v in VOLUMES})


def wide_rollup(held: DataFrame, resolution: str) -> DataFrame:
    """Hour or day candles of candles with wide volumes."""
    unit = F.date_trunc(UNITS[resolution], "bucket")
    zero = F.lit(0).cast("decimal(38,0)")
    plain = _merged(held.withColumns({v: zero for v in VOLUMES}), unit, F.lit(resolution)).drop(*VOLUMES)
    return plain.join(_wide_sums(held, unit), ["pool", "bucket"])


def merge_candles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Candles of the events behind both inputs, in whatever order they came."""
    return _merged(old.unionByName(new), F.col("bucket"), F.col("resolution"))


def rollup(minutes: DataFrame, resolution: str, as_of: Column) -> DataFrame:
    """Hour or day candles of the buckets that are complete at as_of."""
    unit = UNITS[resolution]
    return _merged(minutes.filter(F.col("bucket") < F.date_trunc(unit, as_of)), F.date_trunc(unit, "bucket"), F.lit(resolution))


def rollup_of(minutes: DataFrame, resolution: str) -> DataFrame:
    """Hour or day candles of all minutes, the last bucket as far as it has come."""
    return _merged(minutes, F.date_trunc(UNITS[resolution], "bucket"), F.lit(resolution))


def affected_buckets(swaps: DataFrame, fork: int, resolution: str = "1m") -> DataFrame:
    """Pools and buckets that lose events when blocks above the fork are withdrawn."""
    gone = swaps.filter(F.col("block_number") > fork)
    return gone.select("pool", F.date_trunc(UNITS[resolution], "block_time").alias("bucket")).distinct()


def revert_candles(held: DataFrame, swaps: DataFrame, fork: int, resolution: str = "1m") -> DataFrame:
    """Candles after the withdrawal: untouched ones stay, touched ones are rebuilt from survivors."""
    touched = affected_buckets(swaps, fork, resolution)
    survivors = swaps.filter(F.col("block_number") <= fork).withColumn("bucket", F.date_trunc(UNITS[resolution], "block_time"))
    rebuilt = candles(survivors.join(touched, ["pool", "bucket"], "left_semi").drop("bucket"), resolution)
    return held.join(touched, ["pool", "bucket"], "left_anti").unionByName(rebuilt)


def split_window(swaps: DataFrame, floor: Column) -> tuple[DataFrame, DataFrame]:
    """Rows inside the raw window, and older ones that only feed aggregates."""
    inside = F.col("block_time") >= floor
    return swaps.filter(inside), swaps.filter(~inside)


def window_counts(swaps: DataFrame, floor: Column) -> DataFrame:
    return swaps.agg(F.count_if(F.col("block_time") >= floor).alias("kept"), F.count_if(F.col("block_time") < floor).alias("discarded"))
