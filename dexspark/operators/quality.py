"""Checks of invariants, as one-row or row-per-fault tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dexspark.operators.fifo import lot_cost

KINDS = ("mint", "burn", "collect")


def check_gap_free(headers: DataFrame, start: int | None = None) -> DataFrame:
    """(first, last, count, gap_free)."""
    sums = headers.agg(F.min("number").alias("first"), F.max("number").alias("last"), F.countDistinct("number").alias("count"))
    whole = F.col("last") - F.col("first") + 1 == F.col("count")
    if start is not None:
        whole = whole & (F.col("first") == start)
    return sums.withColumn("gap_free", F.coalesce(whole, F.lit(True)))


def check_cursor(state: DataFrame, headers: DataFrame) -> DataFrame:
    """(live_cursor, top, ok): the cursor is never ahead of the rows."""
    top = headers.agg(F.max("number").alias("top"))
    ok = F.col("live_cursor").isNull() | (F.col("live_cursor") <= F.col("top"))
    return state.select("live_cursor").crossJoin(F.broadcast(top)).withColumn("ok", F.coalesce(ok, F.lit(False)))


def check_event_parity(headers: DataFrame, swaps: DataFrame) -> DataFrame:
    """(orphans): facts whose block has no header."""
    return swaps.join(headers.select(F.col("number").alias("block_number")), "block_number", "left_anti").agg(F.count("*").alias("orphans"))


def check_ledger(stats: DataFrame, consumed: DataFrame) -> DataFrame:
    """(stats_realized, ledger_realized, equal)."""
    a = stats.agg(F.coalesce(F.sum("realized"), F.lit(0)).alias("stats_realized"))
    b = consumed.agg(F.coalesce(F.sum("realized"), F.lit(0)).alias("ledger_realized"))
    return a.crossJoin(F.broadcast(b)).withColumn("equal", F.col("stats_realized") == F.col("ledger_realized"))


def check_lots(positions: DataFrame) -> DataFrame:
    """(positions, faults): positions whose sums differ from those over their lots."""
    held = positions.select("wallet", "token", "qty_held", "cost_basis", F.explode_outer("lots").alias("lot")).select("*", "lot.*").withColumnRenamed("qty", "remaining")
    sums = held.groupBy("wallet", "token", "qty_held", "cost_basis").agg(F.sum("remaining").alias("_q"), F.sum(lot_cost(held)).alias("_c"))
    fault = (F.col("qty_held") != F.coalesce("_q", F.lit(0))) | (F.col("cost_basis") != F.coalesce("_c", F.lit(0)))
    return sums.agg(F.count("*").alias("positions"), F.count_if(fault).alias("faults"))


def check_kinds(liq: DataFrame) -> DataFrame:
    """(rows, bad_kind, bad_address, bad_block)."""
    kind = F.col("kind").isin(*KINDS)
    address = F.col("owner").rlike("^0x[0-9a-f]{40}$")
    return liq.agg(
        F.count("*").alias("rows"),
        F.count_if(~F.coalesce(kind, F.lit(False))).alias("bad_kind"),
        F.count_if(~F.coalesce(address, F.lit(False))).alias("bad_address"),
        F.count_if(F.coalesce(F.col("block_number") < 0, F.lit(True))).alias("bad_block"),
    )


def diff_state(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, with the side; empty if both hold the same rows."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
