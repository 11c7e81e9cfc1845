"""Trades: direction, value and class of swaps, and prices of the reference token."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dexspark.functions.columns import human_units
from dexspark.functions.money import PRICE, value_exact


def with_pool(swaps: DataFrame, pools: DataFrame) -> DataFrame:
    """Swaps with their pool's tokens (pools: address, token0, token1, decimals0, decimals1)."""
    return swaps.join(pools, swaps["pool"] == pools["address"]).drop("address")


def with_pool_meta(swaps: DataFrame, pools: DataFrame) -> DataFrame:
    """The same, without swaps whose pool has no usable decimals."""
    return with_pool(swaps, pools.filter("decimals0 >= 0 and decimals1 >= 0"))


def with_direction(swaps: DataFrame) -> DataFrame:
    """Adds sold and bought token, raw quantity and decimals; amounts are the pool's, so positive means sold."""
    first = F.col("amount0") > 0
    return swaps.withColumns(
        {
            "sold_token": F.when(first, F.col("token0")).otherwise(F.col("token1")),
            "bought_token": bought_token(),
            "sold_decimals": F.when(first, F.col("decimals0")).otherwise(F.col("decimals1")),
            "bought_decimals": F.when(first, F.col("decimals1")).otherwise(F.col("decimals0")),
            "sold_qty": F.when(first, F.abs("amount0")).otherwise(F.abs("amount1")),
            "bought_qty": F.when(first, F.abs("amount1")).otherwise(F.abs("amount0")),
        }
    )


def bought_token(amount0: str = "amount0") -> F.Column:
    """Token that leaves the pool."""
    return F.when(F.col(amount0) > 0, F.col("token1")).otherwise(F.col("token0"))


def value_trades(directed: DataFrame, numeraire: DataFrame, reference: str | None = None) -> DataFrame:
    """Adds value and priced flags from a table (token, usd) of prices of one whole token, a row per token.

    Quantities are scaled by their token's decimals. The token ``reference`` has the price in
    the trade's own column usd, see asof_price. The sold leg counts first, then the bought leg; a
    trade without either has a null value. Where prices are decimals, values are exact, decimal(30,8), and a
    reference's double counts with 18 places; else they are doubles.
    """
    exact = dict(numeraire.dtypes)["usd"].startswith("decimal")
    kind = PRICE if exact else "double"
    prices = {side: numeraire.select(F.col("token").alias(f"{side}_token"), F.col("usd").cast(kind).alias(f"_{side}")) for side in ("sold", "bought")}
    both = directed.join(prices["sold"], "sold_token", "left").join(prices["bought"], "bought_token", "left")
    if reference is not None:
        both = both.withColumns({f"_{s}": F.coalesce(f"_{s}", F.when(F.col(f"{s}_token") == reference, F.col("usd").cast(kind))) for s in prices})
    scaled = value_exact if exact else lambda raw, decimals, price: human_units(raw, decimals) * price
    worth = {s: scaled(F.col(f"{s}_qty"), F.col(f"{s}_decimals"), F.col(f"_{s}")) for s in prices}
    flags = {f"{s}_priced": F.col(f"_{s}").isNotNull() for s in prices}
    return both.withColumns({"value": F.coalesce(worth["sold"], worth["bought"]), **flags}).drop("_sold", "_bought")


def position_trades(classified: DataFrame) -> DataFrame:
    """Buys and sells of classified swaps as trades of the recipient's position: exact values as they are, doubles as whole numbers, rounded half up.

    A buy pays with a priced token and adds what it bought; a sell takes off what it sold.
    """
    buy = F.col("class") == "buy"
    value = F.col("value") if dict(classified.dtypes)["value"].startswith("decimal") else F.floor(F.col("value") + 0.5).cast("long")
    return classified.filter("class in ('buy', 'sell')").select(
        F.col("recipient").alias("wallet"),
        F.when(buy, F.col("bought_token")).otherwise(F.col("sold_token")).alias("token"),
        F.col("class").alias("side"),
        F.when(buy, F.col("bought_qty")).otherwise(F.col("sold_qty")).alias("qty"),
        value.alias("value"),
        "block_number",
        "log_index",
        "tx_hash",
    )


def classify(valued: DataFrame) -> DataFrame:
    """Adds class: buy, sell, money_for_money, unpriceable or skipped (a quantity of 0)."""
    sold, bought = F.col("sold_priced"), F.col("bought_priced")
    kind = (
        F.when((F.col("sold_qty") <= 0) | (F.col("bought_qty") <= 0), "skipped")
        .when(sold & bought, "money_for_money")
        .when(sold, "buy")
        .when(bought, "sell")
        .otherwise("unpriceable")
    )
    return valued.withColumn("class", kind)


def latest_close(candles: DataFrame, pool: str) -> DataFrame:
    """(pool, usd): the newest close of one pool; no row where it has no candle."""
    return candles.filter(F.col("pool") == pool).groupBy("pool").agg(F.max_by("close", "bucket").alias("usd"))


def asof_price(trades: DataFrame, prices: DataFrame, time: str = "block_time", pool: str | None = None) -> DataFrame:
    """Adds usd: the newest close of the trade's pool, or of the one given, in a bucket that ended at or before its time.

    prices has pool, available_at and close. Both inputs are sorted together by day, no range
    join: a pool's days go to different tasks, and each begins with the last close before it.
    """
    day = F.to_date("_at")
    marks = prices.select("pool", F.col("available_at").alias("_at"), F.col("close").alias("_close"), F.lit(0).alias("_kind"))
    marks = marks if pool is None else marks.filter(F.col("pool") == pool)
    asked = trades.select("*", F.col(time).alias("_at"), F.lit(1).alias("_kind"))
    if pool is not None:
        marks, asked = marks.withColumnRenamed("pool", "_pool"), asked.withColumn("_pool", F.lit(pool))
    key = "pool" if pool is None else "_pool"
    both = marks.unionByName(asked, allowMissingColumns=True).withColumn("_day", day)
    # a row per pool and day
    days = both.select(key, "_day").union(marks.select(key, day)).distinct()
    last = marks.groupBy(key, day.alias("_day")).agg(F.max_by("_close", "_at").alias("_last"))
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.join(last, [key, "_day"], "left").withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    order = Window.partitionBy(key, "_day").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("usd", F.last("_close", ignorenulls=True).over(order)).filter("_kind = 1")
    priced = swept.join(carried, [key, "_day"], "left").withColumn("usd", F.coalesce("usd", "_carried"))
    return priced.select(*trades.columns, "usd")
