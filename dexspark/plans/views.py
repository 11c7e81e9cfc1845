"""Exchange-shaped views of the star-schema tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dexspark.operators.decode import BURN, COLLECT, MINT, POOL_CREATED, SWAP

#: Days are counted from here as block numbers.
GENESIS = "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades at second resolution: pool is the event type, recipient the user."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 10").alias("block_number"),
        (F.col("event_id") % 10).alias("log_index"),
        F.col("event_id").cast("string").alias("tx_hash"),
        F.col("ts").cast("timestamp").alias("block_time"),
        F.col("event_type").alias("pool"),
        F.col("user_id").cast("string").alias("recipient"),
        F.col("value").alias("price"),
        F.when(k % 2 == 0, -(k + 1)).otherwise(k + 1).alias("amount0"),
        F.when(k % 2 == 0, 2 * (k + 1)).otherwise(-2 * (k + 1)).alias("amount1"),
    )


def swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with long positions: pool is the part's brand, recipient the supplier, a block is a day.

    log_index numbers the rows of a day in the order of all columns.
    """
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    place = Window.partitionBy("l_shipdate").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    rows = lines.withColumn("log_index", (F.row_number().over(place) - 1).cast("long")).join(orders, "l_orderkey").join(parts, "l_partkey")
    qty, cents = F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long")
    sell = F.col("l_returnflag") == "R"
    return rows.select(
        F.datediff("l_shipdate", F.lit(GENESIS).cast("date")).cast("long").alias("block_number"),
        "log_index",
        F.col("l_orderkey").cast("string").alias("tx_hash"),
        F.col("l_shipdate").cast("timestamp").alias("block_time"),
        F.col("p_brand").alias("pool"),
        (F.col("o_custkey") % 100).cast("string").alias("sender"),
        F.col("l_suppkey").cast("string").alias("recipient"),
        F.when(sell, "sell").otherwise("buy").alias("side"),
        F.when(sell, qty).otherwise(-qty).alias("amount0"),
        F.when(sell, -cents).otherwise(cents).alias("amount1"),
    )


def position_trades(swaps_: DataFrame) -> DataFrame:
    return swaps_.select(
        F.col("recipient").alias("wallet"), F.col("pool").alias("token"), "side", F.abs("amount0").alias("qty"), F.abs("amount1").alias("value"), "block_number", "log_index", "tx_hash"
    )


def headers(swaps_: DataFrame, fork: int | None = None) -> DataFrame:
    """A header per block of the trades; above the fork those of another branch."""

    def named(number: Column) -> Column:
        branch = F.lit("a") if fork is None else F.when(number > fork, "b").otherwise("a")
        return F.md5(F.concat(branch, number.cast("string")))

    number = F.col("number")
    blocks = swaps_.groupBy(F.col("block_number").alias("number")).agg(F.min("block_time").alias("block_time"))
    return blocks.select("number", named(number).alias("block_hash"), named(number - 1).alias("parent_hash"), "block_time")


def brand(pool: str = "pool") -> Column:
    return F.substring_index(pool, "#", -1).cast("long")


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool per brand. Those ending in 1 trade money for money, in 2 unpriced tokens, in 3 lack decimals."""
    name = table(spark, sf_dir, "part").select(F.col("p_brand").alias("address")).distinct()
    last = F.substring("address", -1, 1)
    return name.select(
        "address",
        F.when(last == "1", "USDX").otherwise(F.col("address")).alias("token0"),
        F.when(last == "2", "OTHER").otherwise("USD").alias("token1"),
        F.when(last != "3", 0).alias("decimals0"),
        F.lit(2).alias("decimals1"),
    )


def fine_swaps(swaps_: DataFrame) -> DataFrame:
    """The trades in raw units of tokens with 18 and 6 decimals."""
    return swaps_.withColumns({"amount0": F.col("amount0").cast("decimal(20,0)") * F.lit(10**18).cast("decimal(38,0)").cast("decimal(19,0)"), "amount1": F.col("amount1") * 10**4}).withColumn(
        "amount0", F.col("amount0").cast("decimal(38,0)")
    )


def fine_pools(pools_: DataFrame) -> DataFrame:
    return pools_.withColumns({"decimals0": F.when(F.col("decimals0").isNotNull(), F.lit(18)), "decimals1": F.lit(6)})


def numeraire(pools_: DataFrame) -> DataFrame:
    """Price in cents of a whole money token."""
    tokens = pools_.select(F.col("token0").alias("token")).union(pools_.select("token1")).distinct()
    return tokens.select("token", F.when(F.col("token") == "USD", 100).when(F.col("token") == "USDX", 100).cast("long").alias("usd")).filter("usd is not null")


def new_pools(swaps_: DataFrame) -> DataFrame:
    """Registry rows of the pools by their first trade; every other brand is indexed."""
    from dexspark.operators.alerts import risk_flags

    first = swaps_.groupBy(F.col("pool").alias("address")).agg(F.min("block_time").alias("discovered_at"), F.min("block_number").alias("created_block"))
    return first.withColumns({"is_indexed": brand("address") % 2 == 0, "risk_flags": risk_flags(brand("address") % 3)})


def word(value: Column) -> Column:
    """A long as a 32-byte word in two's complement, without 0x."""
    return F.lpad(F.lower(F.hex(value)), 64, F.when(value < 0, "f").otherwise("0"))


def contract(pool: str = "pool") -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(brand(pool))), 40, F.lit("0")))


def raw_logs(swaps_: DataFrame) -> DataFrame:
    """Encoded logs of the trades: a swap each, mints, burns and collects of some senders, a creation per pool.

    Every seventh swap of a block has truncated data.
    """
    return event_logs(swaps_).unionByName(created_logs(swaps_))


def _topics(*words: Column) -> Column:
    return F.array(*[F.concat(F.lit("0x"), w) for w in words])


def event_logs(swaps_: DataFrame) -> DataFrame:
    """The logs of ``raw_logs`` but for creations, in one pass: rows stay in the task that they are in."""
    sender, recipient = F.col("sender").cast("long"), F.col("recipient").cast("long")

    def log(topics: Column, data: Column, shift: int) -> Column:
        return F.struct(topics.alias("topics"), data.alias("data"), (F.col("log_index") + shift).cast("int").alias("log_index"))

    sqrt = F.lpad(F.concat(F.hex(1 + F.col("log_index") % 5), F.lit("0" * 24)), 64, F.lit("0"))
    words = F.concat(F.lit("0x"), word(F.col("amount0")), word(F.col("amount1")), sqrt, word(1000 + F.col("log_index")), word(F.col("amount0") * 10))
    size = 2 + 5 * 64
    data = F.substring(words, F.lit(1), F.when(F.col("log_index") % 7 == 6, size - 2).otherwise(size))
    swap = log(F.array(F.lit(SWAP), F.concat(F.lit("0x"), word(sender)), F.concat(F.lit("0x"), word(recipient))), data, 0)
    low, high = word(-(F.col("log_index") + 1)), word(F.col("log_index") + 1)
    amounts = [word(F.abs("amount0")), word(F.abs("amount1"))]

    def liq(signature: str, test: Column, data_: list[Column], shift: int) -> Column:
        topics = F.concat(F.array(F.lit(signature)), _topics(word(sender), low, high))
        return F.when(test, log(topics, F.concat(F.lit("0x"), *data_), shift))

    mint = liq(MINT, sender < brand() % 3, [word(recipient), word(F.col("log_index")), *amounts], 100_000)
    burn = liq(BURN, sender == 50, [word(F.col("log_index")), *amounts], 200_000)
    collect = liq(COLLECT, sender == 51, [word(recipient), *amounts], 300_000)
    every = swaps_.select(contract().alias("address"), "block_number", "tx_hash", F.explode(F.array_compact(F.array(swap, mint, burn, collect))).alias("_log"))
    return every.select("address", "_log.topics", "_log.data", "block_number", "tx_hash", "_log.log_index")


def created_logs(swaps_: DataFrame) -> DataFrame:
    """A creation per pool, in the block of its first trade."""
    first = swaps_.groupBy("pool").agg(F.min("block_number").alias("block_number"))
    return first.select(
        F.lit("0x" + "f" * 40).alias("address"),
        F.concat(F.array(F.lit(POOL_CREATED)), _topics(word(brand() * 2), word(brand() * 2 + 1), word(F.lit(3000)))).alias("topics"),
        F.concat(F.lit("0x"), word(F.lit(60)), word(brand())).alias("data"),
        "block_number",
        F.concat(F.lit("c"), brand().cast("string")).alias("tx_hash"),
        (400_000 + brand()).cast("int").alias("log_index"),
    )
