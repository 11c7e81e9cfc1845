"""Scans of raw logs and headers, and the bulk load of text staging files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dexspark.operators.candles import split_window
from dexspark.schemas import HEADERS, RAW_LOGS


#: Blocks of a pool that stay together in a file, and files of a day at most.
FILE_BLOCKS, FILES = 1000, 32


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_LOGS).parquet(path)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEADERS).parquet(path)


def write_logs(raw_logs: DataFrame, headers: DataFrame, path: str, unit: str = "day") -> None:
    """Logs in folders by day (or month, year) of their block, sorted by contract in each file."""
    days = headers.select(F.col("number").alias("block_number"), day_of_block(unit).alias("day"))
    dealt = raw_logs.join(days, "block_number").repartition("day", F.pmod(F.xxhash64("address"), F.lit(FILES)))
    dealt.sortWithinPartitions("day", "address", "block_number").write.mode("append").partitionBy("day").parquet(path)


def day_of_block(unit: str = "day") -> Column:
    return F.date_trunc(unit, "block_time").cast("date")


def scan_logs(raw_logs: DataFrame, first: int, last: int, watched: list[str] | DataFrame | None = None, headers: DataFrame | None = None, unit: str = "day") -> DataFrame:
    """Logs of blocks first to last, of the watched contracts if any are given: addresses, or a table with address.

    Of logs that ``write_logs`` wrote, only the days of the range are read, found in the headers when the scan
    runs. A list is pushed into the files, a table filters the rows by a semi-join.
    """
    rows = raw_logs.filter(F.col("block_number").between(first, last))
    if headers is not None:
        days = headers.filter(F.col("number").between(first, last)).select(day_of_block(unit).alias("day")).distinct()
        rows = rows.join(days, "day", "left_semi")
    if isinstance(watched, DataFrame):
        return rows.join(watched.select("address").distinct(), "address", "left_semi").select(*raw_logs.columns)
    return rows.filter(F.col("address").isin(*watched)) if watched else rows


def blocks_with_logs(headers: DataFrame, raw_logs: DataFrame) -> DataFrame:
    """Every header with the array of its logs in order, empty for a block without one."""
    entry = F.struct("log_index", "address", "topics", "data", "tx_hash")
    logs = raw_logs.groupBy(F.col("block_number").alias("number")).agg(F.array_sort(F.collect_list(entry)).alias("logs"))
    kind = logs.schema["logs"].dataType.simpleString()
    return headers.join(logs, "number", "left").withColumn("logs", F.coalesce("logs", F.array().cast(kind)))


def explode_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers, one row per block also where it is empty, and the rows of its logs."""
    logs = blocks.select(F.col("number").alias("block_number"), F.explode("logs").alias("_log")).select("block_number", "_log.*")
    return blocks.drop("logs"), logs


def active_blocks(raw_logs: DataFrame, first: int, last: int, watched: list[str] | DataFrame | None = None) -> DataFrame:
    """Blocks in the range that hold a watched log."""
    return scan_logs(raw_logs, first, last, watched).select("block_number").distinct()


def load_backfill(text: DataFrame, types: dict[str, str], floor: Column, time: str = "block_time") -> tuple[DataFrame, DataFrame]:
    """Casts text columns once, epoch seconds to block_time, and splits at the raw window's floor.

    A value that does not cast is an error. The older part feeds aggregates only.
    """
    cast = {c: F.timestamp_seconds(F.col(c).cast("long")) if c == time else F.col(c).cast(t) for c, t in types.items()}
    return split_window(text.select(*[v.alias(c) for c, v in cast.items()]), floor)


def write_raw(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Day-partitioned facts, sorted in each file so that statistics skip pools and blocks.

    A day's rows are dealt by pool and block range too, so a large day is many tasks and files.
    """
    dated = rows.withColumn("day", F.to_date("block_time"))
    dealt = dated.repartition("day", F.pmod(F.xxhash64("pool", F.floor(F.col("block_number") / FILE_BLOCKS)), F.lit(FILES)))
    dealt.sortWithinPartitions("day", "pool", "block_number").write.mode(mode).partitionBy("day").parquet(path)


def days_of_blocks(headers: DataFrame, first: int, last: int) -> DataFrame:
    """(low, high) days of a block range, to prune partitions by before filtering on blocks."""
    inside = headers.filter(F.col("number").between(first, last))
    return inside.agg(F.to_date(F.min("block_time")).alias("low"), F.to_date(F.max("block_time")).alias("high"))
