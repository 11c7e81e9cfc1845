"""Candles: hand-worked values, replays, merges, roll-ups and reverts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from dexspark.functions.columns import price_from_sqrt
from dexspark.operators import candles as c
from dexspark.operators.quality import diff_state
from dexspark.sources.tables import append_new

T0 = datetime(2024, 3, 1, 12, 0, 0)
SCHEMA = "pool string, block_time timestamp, price double, amount0 long, amount1 long, block_number long, log_index long"


def swaps(spark, rows, per_block=1):
    return spark.createDataFrame([("p", T0 + timedelta(seconds=(b - rows[0][0]) * per_block), float(k * k), a, d, b, 0) for b, k, a, d in rows], SCHEMA)


HAND = [(100, 2, 10, -5), (101, 5, 20, -8), (102, 1, -3, 7)]


def values(row):
    return (row.open, row.high, row.low, row.close, int(row.volume0), int(row.volume1), row.trade_count)


def test_by_hand(spark):
    assert values(c.candles(swaps(spark, HAND)).first()) == (4, 25, 1, 1, 33, 20, 3)


def test_price_is_exact_for_whole_roots(spark):
    got = spark.range(1, 6).select(price_from_sqrt(F.col("id") * F.lit(2.0**96)).alias("p")).collect()
    assert [r.p for r in got] == [1, 4, 9, 16, 25]


def test_replay_adds_nothing(spark):
    rows = swaps(spark, HAND)
    assert append_new(rows, rows, ["block_number", "log_index"]).count() == 0


def test_merge_in_any_order_is_one_pass(spark):
    rows = swaps(spark, HAND)
    early, late = c.candles(rows.filter("block_number < 102")), c.candles(rows.filter("block_number >= 102"))
    once = c.candles(rows)
    assert diff_state(c.merge_candles(early, late).select(*once.columns), once).count() == 0
    assert diff_state(c.merge_candles(late, early).select(*once.columns), once).count() == 0


def test_below_window(spark):
    old = swaps(spark, [(1, 3, 42, -17)])
    kept, older = c.split_window(old, F.lit(T0 + timedelta(days=70)))
    assert (kept.count(), older.count()) == (0, 1)
    assert values(c.candles(older).first()) == (9, 9, 9, 9, 42, 17, 1)
    assert tuple(c.window_counts(old, F.lit(T0 + timedelta(days=70))).first()) == (0, 1)


def minute_candles(spark):
    rows = [(0, 10, 15, 8, 12, 100, 3), (1, 12, 20, 11, 18, 50, 2), (2, 18, 19, 17, 17, 30, 1)]
    full = [("1m", "p", T0 + timedelta(minutes=m), float(o), float(h), float(lo), float(cl), v, 0, n, m, m) for m, o, h, lo, cl, v, n in rows]
    made = spark.createDataFrame(
        full, "resolution string, pool string, bucket timestamp, open double, high double, low double, close double, volume0 long, volume1 long, trade_count long, open_key long, close_key long"
    )
    return made.withColumns({x: F.col(x).cast("decimal(38,0)") for x in ("volume0", "volume1")})


def test_rollup(spark):
    minutes = minute_candles(spark)
    hours = c.rollup(minutes, "1h", F.lit(T0 + timedelta(hours=2)))
    assert values(hours.first()) == (10, 20, 8, 17, 180, 0, 6)
    assert c.rollup(hours, "1d", F.lit(T0 + timedelta(days=1))).first().trade_count == 6
    assert c.rollup(minutes, "1h", F.lit(T0 + timedelta(minutes=59))).count() == 0


def test_revert(spark):
    rows = swaps(spark, [(120, 2, 10, 0), (121, 5, 20, 0), (126, 3, 7, 0), (127, 1, 4, 0)])
    held = c.candles(rows)
    assert values(held.first())[2:4] == (1, 1)
    assert values(c.revert_candles(held, rows, 125).first()) == (4, 25, 4, 25, 30, 0, 2)


def test_revert_of_a_whole_bucket(spark):
    rows = swaps(spark, [(100, 1, 1, 1), (101, 1, 1, 1), (130, 1, 1, 1), (131, 1, 1, 1)], per_block=20)
    left = c.revert_candles(c.candles(rows), rows, 125).collect()
    assert [r.trade_count for r in left] == [2]
