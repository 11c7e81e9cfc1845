"""Wallet statistics, wash-trade flags, leaderboard and scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dexspark.operators.fifo import EXACT, lot_cost, money


def average(paid: str) -> Column:
    """avg_size: volume over trades, as a whole number if money is."""
    return (F.expr("volume div trades") if paid == "long" else (F.col("volume") / F.col("trades")).cast(EXACT)).alias("avg_size")


def wallet_stats(trades: DataFrame, totals: DataFrame) -> DataFrame:
    """(wallet, realized, trades, wins, volume, avg_size, last_active_block).

    trades are the priced buys and sells, totals their sell totals; a win is a sell that
    realized more than 0. Money of realized is in millionths, volume in input units; where values
    are exact decimals, both are too.
    """
    paid = money(trades)
    activity = trades.groupBy("wallet").agg(F.count("*").alias("trades"), F.sum("value").alias("volume"), F.max("block_number").alias("last_active_block"))
    gains = totals.groupBy("wallet").agg(F.sum("realized").alias("realized"), F.count_if(F.col("realized") > 0).alias("wins"))
    joined = activity.join(gains, "wallet", "left")
    return joined.select(
        "wallet",
        F.coalesce("realized", F.lit(0)).cast(paid).alias("realized"),
        "trades",
        F.coalesce("wins", F.lit(0)).cast("long").alias("wins"),
        F.col("volume").cast(paid).alias("volume"),
        average(paid),
        "last_active_block",
    )


def self_traders(swaps: DataFrame, least: int = 3) -> DataFrame:
    """(wallet, self_trades) of wallets that traded with themselves at least so often."""
    own = swaps.filter(F.col("sender") == F.col("recipient"))
    return own.groupBy(F.col("recipient").alias("wallet")).agg(F.count("*").alias("self_trades")).filter(F.col("self_trades") >= least)


def churners(swaps: DataFrame, least: int = 6, ratio: float = 0.05) -> DataFrame:
    """(wallet, pool, trades, net, gross) where much was traded and next to nothing kept."""
    sums = swaps.groupBy(F.col("recipient").alias("wallet"), "pool").agg(
        F.count("*").alias("trades"), F.sum("amount0").cast("decimal(38,0)").alias("net"), F.sum(F.abs("amount0")).cast("decimal(38,0)").alias("gross")
    )
    return sums.filter((F.col("trades") >= least) & (F.col("gross") > 0) & (F.abs("net").cast("double") < ratio * F.col("gross").cast("double")))


def wash_wallets(swaps: DataFrame, self_least: int = 3, churn_least: int = 6, ratio: float = 0.05) -> DataFrame:
    return self_traders(swaps, self_least).select("wallet").union(churners(swaps, churn_least, ratio).select("wallet")).distinct()


def flag_wash(stats: DataFrame, washed: DataFrame, sticky: bool = False) -> DataFrame:
    """Sets excluded on every row of stats; sticky keeps earlier flags where raw swaps have aged out."""
    flags = washed.select("wallet", F.lit(True).alias("_washed"))
    found = F.col("_washed").isNotNull()
    if sticky and "excluded" in stats.columns:
        found = found | F.coalesce("excluded", F.lit(False))
    return stats.join(flags, "wallet", "left").withColumn("excluded", found).drop("_washed")


def leaderboard(stats: DataFrame, n: int = 100) -> DataFrame:
    """The n wallets that realized most, without excluded ones; ties go to the smaller wallet."""
    top = stats.filter(~F.col("excluded")).orderBy(F.desc("realized"), "wallet").limit(n)
    rank = Window.orderBy(F.desc("realized"), "wallet")  # over the n rows
    return top.withColumn("rank", F.row_number().over(rank))


def watchlist(stats: DataFrame, n: int) -> DataFrame:
    return leaderboard(stats, n).select("wallet")


def scorecards_all(stats: DataFrame, lots: DataFrame, totals: DataFrame, recent: int = 10) -> DataFrame:
    """Per wallet its statistics, open positions by falling cost, and the latest sells, in arrays."""
    held = lots.groupBy("wallet", "token").agg(F.sum("remaining").alias("qty"), F.sum(lot_cost(lots)).alias("cost"))
    held = held.groupBy("wallet").agg(F.sort_array(F.collect_list(F.struct("cost", "qty", "token")), asc=False).alias("open_positions"))
    newest = Window.partitionBy("wallet").orderBy(F.desc("sell_block"), F.desc("sell_log"), "token")
    last = totals.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= recent)
    last = last.groupBy("wallet").agg(F.array_sort(F.collect_list(F.struct("_n", "sell_block", "sell_log", "token", "realized"))).alias("recent"))
    return stats.join(held, "wallet", "left").join(last, "wallet", "left")


def scorecard(stats: DataFrame, lots: DataFrame, totals: DataFrame, wallet: Column | str, recent: int = 10) -> DataFrame:
    """The card of one wallet; empty for an unknown one."""
    own = F.col("wallet") == wallet
    return scorecards_all(stats.filter(own), lots.filter(own), totals.filter(own), recent)
