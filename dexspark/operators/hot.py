"""First in, first out where one position holds a large part of all trades.

The same axis as in ``fifo``, but a position is spread over range partitions in the order of its
events, and then of the axis. A part is swept by itself and begins with what the parts
before it leave: bought, sold and uncovered so far compose, as do the next lot and the next sell above a
part of the axis. What parts leave is a row for each part and position.

Rows are written between the dealing and the sweep, so that a row's part stays what it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dexspark.functions.columns import event_key
from dexspark.operators.fifo import POSITION, consumed_of, ends_of, fifo_axis, fifo_consume, lots_of, open_lots, quantity, sell_totals
from dexspark.operators.wallets import wallet_stats
from dexspark.sources.shared import shared_path

#: Trades of a position above which it is spread.
MOST = 1_000_000
PART = ["part", *POSITION]


def dealt(rows: DataFrame, *order: F.Column) -> DataFrame:
    """Rows with the number of their range partition, by position and order; equal ones share a part."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "dealt")
    rows.repartitionByRange(parts, *POSITION, *order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def hot_positions(trades: DataFrame, most: int = MOST) -> DataFrame:
    """Positions of more than ``most`` trades: at most the number of trades over ``most``."""
    return trades.groupBy(*POSITION).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*POSITION)


def spread_axis(trades: DataFrame) -> DataFrame:
    """``fifo.fifo_axis`` with a position's events in many tasks."""
    kind = quantity(trades)
    zero = F.lit(0).cast(kind)
    buy = F.col("side") == "buy"
    whole = F.coalesce("whole", "qty") if "whole" in trades.columns else F.col("qty")
    keyed = trades.withColumn("key", event_key()).withColumns({"whole": whole.cast(kind), "qty": F.col("qty").cast(kind)})
    rows = dealt(keyed, F.col("key"))
    order = Window.partitionBy(*PART).orderBy("key")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_b": F.sum(F.when(buy, F.col("qty")).otherwise(zero)).over(run).cast(kind), "_s": F.sum(F.when(buy, zero).otherwise(F.col("qty"))).over(run).cast(kind)})
    rows = rows.withColumn("_d", F.max(F.col("_s") - F.col("_b")).over(run).cast(kind))
    sums = rows.groupBy(*PART).agg(F.max("_b").alias("_B"), F.max("_s").alias("_S"), F.max("_d").alias("_D"))
    before = Window.partitionBy(*POSITION).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({f"_{x}0": F.coalesce(F.sum(f"_{x}").over(before), F.lit(0)).cast(kind) for x in ("B", "S")})
    sums = sums.withColumn("_U0", F.greatest(F.max(F.col("_S0") - F.col("_B0") + F.col("_D")).over(before), F.lit(0)).cast(kind)).select(*PART, "_B0", "_S0", "_U0")
    both = rows.join(sums, PART)
    both = both.withColumns({"b": (F.col("_B0") + F.col("_b")).cast(kind), "_s": (F.col("_S0") + F.col("_s")).cast(kind)})
    both = both.withColumn("u", F.greatest("_U0", F.col("_S0") - F.col("_B0") + F.col("_d")).cast(kind)).withColumn("u0", F.coalesce(F.lag("u").over(order), F.col("_U0")))
    both = both.withColumns({"c": (F.col("_s") - F.col("u")).cast(kind), "b0": (F.col("b") - F.when(buy, F.col("qty")).otherwise(zero)).cast(kind), "c0": (F.col("_s") - F.when(buy, zero).otherwise(F.col("qty")) - F.col("u0")).cast(kind)})
    return both.drop("_b", "_s", "_d", "_B0", "_S0", "_U0")


def spread_consume(axis: DataFrame, lots: bool = False) -> DataFrame:
    """``fifo.fifo_consume`` with a position's axis in many tasks."""
    ends = ends_of(axis).withColumn("_tail", F.col("tail").isNotNull())
    tails = ends.filter("_tail").select(*POSITION, F.col("tail_of").alias("s"), F.lit(None).cast(ends.schema["lot"].dataType).alias("l"), F.col("tail").alias("take"))
    rows = dealt(ends.filter(~F.col("_tail")).select(*POSITION, "at", "lot", "sell"), F.desc("at"))
    falling = Window.partitionBy(*PART).orderBy(F.desc("at"))
    peers = falling.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    above = {x: F.min_by(x, F.when(F.col(x).isNotNull(), F.col("at"))).alias(f"_{x}") for x in ("lot", "sell")}
    edges = rows.groupBy(*PART).agg(*above.values(), F.max("at").alias("_top"))
    order = Window.partitionBy(*POSITION).orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*PART, *[F.last(f"_{x}", ignorenulls=True).over(before).alias(f"_{x}") for x in above], F.lead("_top").over(order).alias("_next"))
    cut = rows.withColumns({"_l": F.last("lot", ignorenulls=True).over(peers), "_s": F.last("sell", ignorenulls=True).over(peers), "_before": F.lag("at").over(falling)})
    cut = cut.filter(F.col("_before").isNull() | (F.col("_before") != F.col("at"))).withColumn("_lead", F.lead("at").over(falling)).join(edges, PART)
    cut = cut.select(*POSITION, F.coalesce("_s", "_sell").alias("s"), F.coalesce("_l", "_lot").alias("l"), (F.col("at") - F.coalesce("_lead", "_next", F.lit(0))).cast(quantity(axis)).alias("take"))
    pieces = cut.filter("s is not null and l is not null and take > 0").unionByName(tails)
    return consumed_of(pieces, axis, lots)


def spread_lots(axis: DataFrame) -> DataFrame:
    """``fifo.open_lots`` by an aggregate: what sells of a position have used up is one number."""
    return lots_of(axis.join(axis.groupBy(*POSITION).agg(F.max("c").alias("_done")), POSITION))


def replay_spread(trades: DataFrame, most: int = MOST) -> dict[str, DataFrame]:
    """``revert.replay``, with positions of more than ``most`` trades spread over tasks."""
    hot = hot_positions(trades, most)
    wide = spread_axis(trades.join(hot, POSITION, "left_semi"))
    axis = fifo_axis(trades.join(hot, POSITION, "left_anti"))
    consumed = fifo_consume(axis).unionByName(spread_consume(wide))
    totals = sell_totals(consumed)
    return {"consumed": consumed, "lots": open_lots(axis).unionByName(spread_lots(wide)), "totals": totals, "stats": wallet_stats(trades, totals)}
