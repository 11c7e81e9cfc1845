"""Undoing withdrawn blocks: what the tables hold once blocks above a fork are gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dexspark.operators.fifo import POSITION, fifo_axis, fifo_consume, money, open_lots, sell_totals
from dexspark.operators.wallets import average, wallet_stats


def revert_raw(rows: DataFrame, fork: int, block: str = "block_number") -> DataFrame:
    """Rows that stay."""
    return rows.filter(F.col(block) <= fork)


def removed_count(rows: DataFrame, fork: int, block: str = "block_number") -> DataFrame:
    return rows.agg(F.count_if(F.col(block) > fork).alias("removed"))


def revert_ledger(consumed: DataFrame, fork: int) -> tuple[DataFrame, DataFrame]:
    """Drawdowns that stay, and the lot pieces that undone sells give back.

    Tail rows carry no lot and give nothing back.
    """
    back = consumed.filter((F.col("sell_block") > fork) & F.col("lot_log").isNotNull())
    return consumed.filter(F.col("sell_block") <= fork), back.select(*POSITION, "lot_block", "lot_log", F.col("qty").alias("remaining"))


def restore_lots(lots: DataFrame, pieces: DataFrame, fork: int) -> DataFrame:
    """Open lots with pieces put back in their place; lots bought above the fork go."""
    key = [*POSITION, "lot_block", "lot_log"]
    both = lots.select(*key, "remaining").unionByName(pieces.select(*key, "remaining"))
    return both.filter(F.col("lot_block") <= fork).groupBy(*key).agg(F.sum("remaining").alias("remaining"))


def touched_positions(lots: DataFrame, pieces: DataFrame, fork: int) -> DataFrame:
    """Positions that get pieces back or hold a lot from above the fork."""
    return pieces.select(*POSITION).union(lots.filter(F.col("lot_block") > fork).select(*POSITION)).distinct()


def holding_above(positions: DataFrame, fork: int) -> DataFrame:
    """Positions whose nested lots reach above the fork."""
    return positions.filter(F.exists("lots", lambda lot: lot["lot_block"] > fork))


def revert_stats(stats: DataFrame, trades: DataFrame, consumed: DataFrame, fork: int) -> DataFrame:
    """Statistics less what the withdrawn trades added; wallets without trades go."""
    gone = trades.filter(F.col("block_number") > fork).groupBy("wallet").agg(F.count("*").alias("_trades"), F.sum("value").alias("_volume"))
    undone = sell_totals(consumed.filter(F.col("sell_block") > fork))
    lost = undone.groupBy("wallet").agg(F.sum("realized").alias("_realized"), F.count_if(F.col("realized") > 0).alias("_wins"))
    seen = trades.filter(F.col("block_number") <= fork).groupBy("wallet").agg(F.max("block_number").alias("last_active_block"))
    joined = stats.drop("last_active_block").join(gone, "wallet", "left").join(lost, "wallet", "left")

    def less(name: str) -> F.Column:
        return (F.col(name) - F.coalesce(f"_{name}", F.lit(0))).cast(dict(stats.dtypes)[name]).alias(name)

    left = joined.select("wallet", less("realized"), less("trades"), less("wins"), less("volume")).filter("trades > 0")
    return left.join(seen, "wallet").select("wallet", "realized", "trades", "wins", "volume", average(money(trades)), "last_active_block")


def replay(trades: DataFrame) -> dict[str, DataFrame]:
    """Ledger, open lots, sell totals and statistics of trades from the start."""
    axis = fifo_axis(trades)
    consumed = fifo_consume(axis)
    totals = sell_totals(consumed)
    return {"consumed": consumed, "lots": open_lots(axis), "totals": totals, "stats": wallet_stats(trades, totals)}


def replay_from(snapshot: DataFrame, pending: DataFrame) -> DataFrame:
    """Ledger of pending trades on top of a snapshot of open lots at the final block.

    The lots enter the axis as buys at their old place, with their left quantity and whole value.
    """
    columns = [*POSITION, "side", "qty", "value", "block_number", "log_index", "tx_hash"]
    return fifo_consume(fifo_axis(as_buys(snapshot).unionByName(pending.select(*columns), allowMissingColumns=True)))


def as_buys(lots: DataFrame) -> DataFrame:
    """Open lots as buys that are left in part, for ``fifo_axis``."""
    return lots.select(
        *POSITION,
        F.lit("buy").alias("side"),
        F.col("remaining").alias("qty"),
        F.col("lot_qty").alias("whole"),
        F.col("lot_value").alias("value"),
        F.col("lot_block").alias("block_number"),
        F.col("lot_log").alias("log_index"),
        F.lit(None).cast("string").alias("tx_hash"),
    )
