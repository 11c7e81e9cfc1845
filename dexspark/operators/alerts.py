"""Alert rows: large trades of watched wallets, coordinated buys, new pools; each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds per block, and blocks added to a cluster's look-back.
CADENCE, SLACK = 12, 100

#: The ledger of keys that have been sent.
SENT = "alert_key string, sent_at timestamp"


def recent(rows: DataFrame, head: int, lookback: int) -> DataFrame:
    return rows.filter((F.col("block_number") > head - lookback) & (F.col("block_number") <= head))


def cluster_lookback(window_s: int) -> int:
    return window_s // CADENCE + SLACK


def of_watched(swaps: DataFrame, watched: DataFrame) -> DataFrame:
    return swaps.join(watched.select(F.col("wallet").alias("recipient")), "recipient", "left_semi")


def watchlist_moves(valued: DataFrame, watched: DataFrame, threshold: float, head: int, lookback: int) -> DataFrame:
    """(alert_key, wallet, pool, side, value, text) of trades worth the threshold or more.

    valued has recipient, pool, tx_hash, log_index, block_number, value and side; the side is
    part of the row, so sells are named as such.
    """
    rows = of_watched(recent(valued, head, lookback), watched).filter(F.col("value") >= threshold)
    text = F.concat_ws(" ", F.col("recipient"), F.when(F.col("side") == "sell", "sold").otherwise("bought"), F.col("value").cast("string"), F.lit("in"), F.col("pool"))
    return rows.select(F.concat_ws(":", F.lit("move"), "tx_hash", "log_index").alias("alert_key"), F.col("recipient").alias("wallet"), "pool", "side", "value", text.alias("text"))


def cluster_buys(buys: DataFrame, watched: DataFrame, head: int, lookback: int, least: int, window_s: int) -> DataFrame:
    """(alert_key, token, wallets, first_time, last_time) of tokens that several watched wallets bought close together.

    buys has recipient, token (the one bought), block_number and block_time.
    """
    rows = of_watched(recent(buys, head, lookback), watched)
    sums = rows.groupBy("token").agg(
        F.countDistinct("recipient").alias("wallets"), F.min(F.unix_timestamp("block_time")).alias("first_time"), F.max(F.unix_timestamp("block_time")).alias("last_time")
    )
    found = sums.filter((F.col("wallets") >= least) & (F.col("last_time") - F.col("first_time") <= window_s))
    return found.withColumn("alert_key", F.concat_ws(":", F.lit("cluster"), "token", F.expr(f"first_time div {window_s}")))


def risk_flags(providers: F.Column) -> F.Column:
    """fresh, with no_liquidity or single_lp by the number of liquidity providers."""
    return F.array_compact(F.array(F.lit("fresh"), F.when(providers == 0, "no_liquidity").when(providers == 1, "single_lp")))


def new_pool_alerts(pools: DataFrame, n: int = 200) -> DataFrame:
    """(alert_key, address, text) of the newest pools that are not indexed."""
    new = pools.filter("not is_indexed").orderBy(F.desc("discovered_at"), "address").limit(n)
    text = F.concat(F.lit("new pool "), F.col("address"), F.lit(" "), F.array_join("risk_flags", ","))
    return new.select(F.concat_ws(":", F.lit("newpool"), "address").alias("alert_key"), "address", text.alias("text"))


def unsent(alerts: DataFrame, sent: DataFrame) -> DataFrame:
    """Alerts whose key has not been sent, each once; append their keys to the ledger before sending."""
    return alerts.dropDuplicates(["alert_key"]).join(sent.select("alert_key"), "alert_key", "left_anti")


def tick(trades: DataFrame, watched: DataFrame, pools: DataFrame, head: int, lookbacks: tuple[int, int], threshold: float, least: int, window_s: int) -> DataFrame:
    """(alert_key, rule) of every rule at this head; the look-backs, of moves and of clusters, bound what is read.

    trades has value and token beside the columns of swaps. Windows of successive ticks overlap:
    ``claim_new`` lets each key through once.
    """
    found = {
        "move": watchlist_moves(trades, watched, threshold, head, lookbacks[0]),
        "cluster": cluster_buys(trades.filter("side = 'buy'"), watched, head, lookbacks[1], least, window_s),
        "newpool": new_pool_alerts(pools.filter(F.col("created_block") <= head)),
    }
    move, cluster, pool = (rows.select("alert_key", F.lit(rule).alias("rule")) for rule, rows in found.items())
    return move.unionByName(cluster).unionByName(pool)


def claim_new(alerts: DataFrame, sent_path: str, sent: DataFrame, as_of: F.Column) -> DataFrame:
    """Writes the keys of unsent alerts to the ledger and returns those alerts."""
    new = unsent(alerts, sent).persist()
    new.select("alert_key", as_of.alias("sent_at")).write.mode("append").parquet(sent_path)
    return new
