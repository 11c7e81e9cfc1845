"""Retention: which raw days may go, their cold copy, and upkeep of derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dexspark.operators.candles import rollup
from dexspark.operators.wallets import flag_wash, leaderboard, wash_wallets


def day_of(raw: DataFrame) -> Column:
    """The partition column of a table written by days, which prunes its files; else the day of block_time."""
    return F.col("day").cast("date") if "day" in raw.columns else F.to_date("block_time")


def day_heights(raw: DataFrame) -> DataFrame:
    """(day, max_block, rows) of the raw table."""
    return raw.groupBy(day_of(raw).alias("day")).agg(F.max("block_number").alias("max_block"), F.count("*").alias("rows"))


def droppable_days(raw: DataFrame, as_of: Column, retain_days: int, finalized: int | None) -> DataFrame:
    """Days older than the cutoff whose blocks are all final; none while no height is final."""
    old = F.col("day") < F.date_sub(as_of, retain_days)
    return day_heights(raw).filter(old & (F.col("max_block") <= F.lit(finalized).cast("long")))


def export_day(raw: DataFrame, day: str, path: str) -> None:
    """Cold copy of one day as text with a header."""
    raw.filter(day_of(raw) == F.lit(day).cast("date")).drop("day").write.mode("overwrite").option("header", True).csv(path)


def retain(raw: DataFrame, minutes: DataFrame, as_of: Column, retain_days: int, finalized: int | None) -> dict[str, DataFrame]:
    """Rolls candles up first, then returns what stays of the raw rows and the dropped days."""
    gone = droppable_days(raw, as_of, retain_days, finalized)
    kept = raw.withColumn("day", day_of(raw)).join(gone.select("day"), "day", "left_anti").select(*raw.columns)
    return {"hours": rollup(minutes, "1h", as_of), "days": rollup(minutes, "1d", as_of), "raw": kept, "dropped": gone}


def drop_days(spark: SparkSession, path: str, days: DataFrame) -> int:
    """Deletes the folders of whole days of a table written by days; no row is read or written. Returns their number.

    A row per day comes to the driver. A day that has gone before is passed over, so a run that was
    cut off can be repeated.
    """
    gone = 0
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in days.select(F.col("day").cast("string")).distinct().collect():
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/day={row[0]}")
        gone += bool(folder.getFileSystem(conf).delete(folder, True))
    return gone


def maintain(stats: DataFrame, swaps: DataFrame, n: int = 100, **limits) -> DataFrame:
    """Leaderboard after fresh wash flags."""
    return leaderboard(flag_wash(stats, wash_wallets(swaps, **limits)), n)
