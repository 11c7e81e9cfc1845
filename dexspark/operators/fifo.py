"""First-in-first-out cost basis without a per-row loop.

Per position (wallet, token) in event order: B and S are bought and sold so far, U is the
greatest S - B so far and C = S - U what earlier buys cover. On one axis buy i takes up
(B of the trade before, B] and sell j consumes (C of the trade before, C]. Cutting the axis at
every end gives pieces that belong to one buy and one sell each; what U grows by is the sell's
zero-cost tail. Every window has the same partition and sort keys, so there is one shuffle.
A position is the unit of work: one wallet's trades in one token are sorted in one task.

Quantities are longs, or decimals without a fraction where raw units pass a long: sums of a
position may have 38 digits and a single quantity 32. Values are longs, or decimal(30,8) where
money is exact; shares of them come in millionths of a unit as longs, or in the values' own type.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dexspark.functions.columns import event_key

POSITION = ["wallet", "token"]
#: Digits of a value that are divided at a time where quantities are wide, and digits that a value may have.
STEP, DIGITS = 5, 30
#: Exact money; differences and sums of more digits would lose places.
EXACT = "decimal(30,8)"
#: Below this a product of two numbers is divided in one step.
SHORT = 10**18
#: Products of a value and a part below these stay within a long, and within 38 digits, when they are doubled and scaled.
FAST, FAST_WIDE = 4.0e12, 2.0e37


def quantity(df: DataFrame, column: str = "qty") -> str:
    """Type of the quantities: decimal(38,0) where they come as decimals, else long."""
    return "decimal(38,0)" if dict(df.dtypes)[column].startswith("decimal") else "long"


def money(df: DataFrame, column: str = "value") -> str:
    """Type of the values: decimal(30,8) where they come as decimals, else long."""
    return EXACT if dict(df.dtypes)[column].startswith("decimal") else "long"


def share(value: F.Column, part: F.Column, whole: F.Column, kind: str, paid: str = "long") -> F.Column:
    """value * part / whole, rounded half up: in millionths for values that are longs, else with 8 places.

    Most products fit and are divided at once. A wide product may pass 38 digits: the value is then divided STEP digits at a
    time, from the first on, with what remains carried to the next. part is at most whole.
    """
    if kind == paid == "long":
        exact = value.cast("decimal(18,0)") * part.cast("decimal(18,0)") / whole.cast("decimal(18,0)")
        product = (value.cast("decimal(19,0)") * part.cast("decimal(19,0)")).cast("decimal(38,0)")
        divisor = whole.cast("decimal(19,0)")
        rest = product % divisor
        parts = (rest * F.lit(2_000_000).cast("decimal(7,0)") + divisor).cast("decimal(38,0)")
        twice = (2 * divisor).cast("decimal(20,0)")
        longer = ((product - rest) / divisor).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)") + ((parts - parts % twice) / twice).cast("decimal(32,0)")
        small = (value >= 0) & (value.cast("double") * part.cast("double") < FAST) & (whole < SHORT)
        once = F.call_function("div", value.cast("long") * part.cast("long") * F.lit(2_000_000).cast("long") + whole.cast("long"), whole.cast("long") * 2)
        return F.when(small, once).when((value < SHORT) & (whole < SHORT), (exact.cast("decimal(32,6)") * 1_000_000).cast("long")).otherwise(longer.cast("long"))
    part, whole = part.cast("decimal(38,0)"), whole.cast("decimal(38,0)")
    if paid == "long":
        units = value.cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    else:
        units = value.cast(EXACT) * F.lit(10**8).cast("decimal(9,0)")
    units = units.cast("decimal(38,0)")
    sizes = [F.lit(Decimal(10**at)).cast("decimal(38,0)") for at in range(0, DIGITS, STEP)]
    digits = F.array(*[(((units - units % at) / at).cast("decimal(38,0)") % F.lit(10**STEP)).cast("decimal(38,0)") for at in reversed(sizes)])
    none = F.lit(0).cast("decimal(38,0)")
    start = F.struct(none.alias("done"), none.alias("left"))

    def divide(at: F.Column, digit: F.Column) -> F.Column:
        left = (at["left"] * F.lit(10**STEP) + digit * part).cast("decimal(38,0)")
        more = F.floor((left - left % whole) / whole).cast("decimal(38,0)")
        return F.struct((at["done"] * F.lit(10**STEP) + more).cast("decimal(38,0)").alias("done"), (left % whole).cast("decimal(38,0)").alias("left"))

    done = F.aggregate(digits, start, divide, lambda at: (at["done"] + (at["left"] >= whole - at["left"]).cast("int")).cast("decimal(38,0)"))
    small = (units >= 0) & (units.cast("double") * part.cast("double") < FAST_WIDE) & (whole.cast("double") < FAST_WIDE / 4)
    twice = (whole * F.lit(2).cast("decimal(1,0)")).cast("decimal(38,0)")
    top = ((units * part).cast("decimal(38,0)") * F.lit(2).cast("decimal(1,0)") + whole).cast("decimal(38,0)")
    done = F.when(small, ((top - top % twice) / twice).cast("decimal(38,0)")).otherwise(done)
    return done.cast("long") if paid == "long" else (done.cast("decimal(29,0)") * F.lit(Decimal("0.00000001")).cast("decimal(8,8)")).cast(EXACT)


def fifo_axis(trades: DataFrame) -> DataFrame:
    """Adds key, b, c, u and their values before the trade (b0, c0, u0).

    trades has wallet, token, side (buy, sell), qty, value, block_number, log_index, tx_hash. What is
    left of a lot enters as a buy with its left qty, and with ``whole``, the quantity that its value is for.
    """
    order = Window.partitionBy(*POSITION).orderBy("key")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buy = F.col("side") == "buy"
    kind = quantity(trades)
    zero = F.lit(0).cast(kind)
    whole = F.coalesce("whole", "qty") if "whole" in trades.columns else F.col("qty")
    axis = trades.withColumn("key", event_key()).withColumns({"whole": whole.cast(kind), "qty": F.col("qty").cast(kind)})
    axis = axis.withColumn("b", F.sum(F.when(buy, F.col("qty")).otherwise(zero)).over(run).cast(kind))
    axis = axis.withColumn("_s", F.sum(F.when(buy, zero).otherwise(F.col("qty"))).over(run).cast(kind))
    axis = axis.withColumn("u", F.greatest(F.max(F.col("_s") - F.col("b")).over(run).cast(kind), zero))
    axis = axis.withColumn("c", (F.col("_s") - F.col("u")).cast(kind)).drop("_s")
    return axis.withColumns({f"{x}0": F.coalesce(F.lag(x).over(order), zero) for x in ("b", "c", "u")})


def ends_of(axis: DataFrame) -> DataFrame:
    """(wallet, token, at, lot, sell, tail, tail_of): where a buy or a sell ends on the axis, and what a sell has uncovered at -1."""
    lot = F.struct("block_number", "log_index", F.col("whole").alias("qty"), "value").alias("lot")
    sell = F.struct("block_number", "log_index", "tx_hash", "qty", "value")
    kind, paid = quantity(axis), money(axis)
    lot_kind, sell_kind = (f"struct<block_number:long,log_index:long,{name}qty:{kind},value:{paid}>" for name in ("", "tx_hash:string,"))
    none_lot, none_sell, none = (F.lit(None).cast(k) for k in (lot_kind, sell_kind, kind))
    lot, sell = lot.cast(lot_kind), sell.cast(sell_kind)

    def end(at, lot_, sell_, tail, tail_of):
        return F.struct(at.cast(kind).alias("at"), lot_.alias("lot"), sell_.alias("sell"), tail.cast(kind).alias("tail"), tail_of.alias("tail_of"))

    buy = F.col("side") == "buy"
    bought = end(F.col("b"), lot, none_sell, none, none_sell)
    covered = F.when(F.col("c") > F.col("c0"), end(F.col("c"), none_lot, sell, none, none_sell))
    tail = F.when(F.col("u") > F.col("u0"), end(F.lit(-1).cast("long"), none_lot, none_sell, F.col("u") - F.col("u0"), sell))
    return axis.select(*POSITION, F.explode(F.array_compact(F.when(buy, F.array(bought)).otherwise(F.array(covered, tail)))).alias("e")).select(*POSITION, "e.*")


def consumed_of(pieces: DataFrame, axis: DataFrame, lots: bool) -> DataFrame:
    """Ledger rows of pieces (s: the sell, l: the lot or null, take: the quantity)."""
    kind, paid = quantity(axis), money(axis)
    order = Window.partitionBy(*POSITION, "s.block_number", "s.log_index").orderBy(F.col("l").isNull(), "l.block_number", "l.log_index")

    def part(value, qty):
        return share(F.col(value), F.col("take"), F.col(qty), kind, paid)

    return (
        pieces.withColumn("consume_seq", F.row_number().over(order) - 1)
        .withColumns({"proceeds": part("s.value", "s.qty"), "cost": F.coalesce(part("l.value", "l.qty"), F.lit(0).cast(paid))})
        .select(
            F.col("s.tx_hash").alias("sell_tx"),
            F.col("s.log_index").alias("sell_log"),
            "consume_seq",
            *POSITION,
            F.col("take").alias("qty"),
            F.coalesce("l.block_number", "s.block_number").alias("lot_block"),
            F.col("l.log_index").alias("lot_log"),
            F.col("s.block_number").alias("sell_block"),
            "proceeds",
            "cost",
            (F.col("proceeds") - F.col("cost")).cast(paid).alias("realized"),
            *([F.col("l.qty").alias("lot_qty"), F.col("l.value").alias("lot_value")] if lots else []),
        )
    )


def fifo_consume(axis: DataFrame, lots: bool = False) -> DataFrame:
    """One row per sell and lot it draws on, then one zero-cost row for what no lot covers.

    Columns: sell_tx, sell_log, consume_seq, wallet, token, qty, lot_block, lot_log (null in the
    tail row, whose lot_block is the sell's), sell_block, proceeds, cost, realized. Money is in
    millionths of the input unit, rounded half up, or exact, see ``share``. ``lots`` adds lot_qty and
    lot_value, all that is needed to give the lot back.
    """
    kind = quantity(axis)
    ends = ends_of(axis)
    falling = Window.partitionBy(*POSITION).orderBy(F.desc("at"))
    peers = falling.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = ends.withColumns({"lot": F.last("lot", ignorenulls=True).over(peers), "sell": F.last("sell", ignorenulls=True).over(peers), "_before": F.lag("at").over(falling)})
    cut = cut.filter(F.col("tail").isNotNull() | F.col("_before").isNull() | (F.col("_before") != F.col("at")))
    cut = cut.withColumn("_low", F.greatest(F.coalesce(F.lead("at").over(falling), F.lit(0)), F.lit(0)))
    is_tail = F.col("tail").isNotNull()
    pieces = cut.filter(is_tail | (F.col("lot").isNotNull() & F.col("sell").isNotNull() & (F.col("at") > F.col("_low"))))
    sold = F.when(is_tail, F.col("tail_of")).otherwise(F.col("sell"))
    pieces = pieces.select(*POSITION, sold.alias("s"), F.when(~is_tail, F.col("lot")).alias("l"), F.when(is_tail, F.col("tail")).otherwise(F.col("at") - F.col("_low")).cast(kind).alias("take"))
    return consumed_of(pieces, axis, lots)


def open_lots(axis: DataFrame) -> DataFrame:
    """(wallet, token, lot_block, lot_log, lot_qty, lot_value, remaining) of buys not yet consumed."""
    whole = Window.partitionBy(*POSITION).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return lots_of(axis.withColumn("_done", F.max("c").over(whole)))


def lots_of(axis: DataFrame) -> DataFrame:
    """The same of an axis with _done, the end of what a position's sells have used up."""
    done = axis.filter("side = 'buy'")
    left = (F.col("b") - F.greatest("_done", "b0")).cast(quantity(axis))
    return done.withColumn("remaining", left).filter("remaining > 0").select(
        *POSITION, F.col("block_number").alias("lot_block"), F.col("log_index").cast("long").alias("lot_log"), F.col("whole").alias("lot_qty"), F.col("value").alias("lot_value"), "remaining"
    )


def lot_cost(lots: DataFrame) -> F.Column:
    """Cost of what is left of each lot, see ``share``."""
    return share(F.col("lot_value"), F.col("remaining"), F.col("lot_qty"), quantity(lots, "remaining"), money(lots, "lot_value"))


def positions(lots: DataFrame) -> DataFrame:
    """(wallet, token, qty_held, cost_basis, lots) with lots oldest first."""
    lot = F.struct("lot_block", "lot_log", F.col("remaining").alias("qty"), "lot_qty", "lot_value")
    return lots.groupBy(*POSITION).agg(F.sum("remaining").alias("qty_held"), F.sum(lot_cost(lots)).alias("cost_basis"), F.array_sort(F.collect_list(lot)).alias("lots"))


def sell_totals(consumed: DataFrame) -> DataFrame:
    """(wallet, token, sell_tx, sell_block, sell_log, qty, proceeds, cost, realized) per sell."""
    return consumed.groupBy(*POSITION, "sell_tx", "sell_block", "sell_log").agg(*[F.sum(c).alias(c) for c in ("qty", "proceeds", "cost", "realized")])
