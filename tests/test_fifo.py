"""First in, first out: hand-worked cases and random positions against a queue."""

from __future__ import annotations

import random
from decimal import Decimal
from collections import deque

import pytest
from pyspark.sql import functions as F

from dexspark.operators.fifo import fifo_axis, fifo_consume, open_lots, positions, sell_totals
from dexspark.operators.quality import check_lots, diff_state
from dexspark.operators.revert import replay, restore_lots, revert_ledger, revert_stats

SCHEMA = "wallet string, token string, side string, qty long, value long, block_number long, log_index long, tx_hash string"
UNIT = 1_000_000


def trades(spark, rows):
    full = [("w", "t", side, qty, value, block, 0, f"x{block}") for side, qty, value, block in rows]
    return spark.createDataFrame(full, SCHEMA)


def run(spark, rows):
    return replay(trades(spark, rows))


def test_two_lots(spark):
    out = run(spark, [("buy", 10, 1000, 1), ("buy", 10, 2000, 2), ("sell", 15, 4500, 3)])
    got = out["consumed"].orderBy("consume_seq").collect()
    assert [(r.qty, r.proceeds // UNIT, r.realized // UNIT) for r in got] == [(10, 3000, 2000), (5, 1500, 500)]
    assert [(r.lot_block, r.remaining) for r in out["lots"].collect()] == [(2, 5)]


def test_oversell_has_a_free_tail(spark):
    out = run(spark, [("buy", 1, 100, 1), ("sell", 2, 600, 2)])
    got = out["consumed"].orderBy("consume_seq").collect()
    assert [(r.qty, r.cost // UNIT, r.lot_block, r.lot_log, r.realized // UNIT) for r in got] == [(1, 100, 1, 0, 200), (1, 0, 2, None, 300)]
    assert out["totals"].first().realized == 500 * UNIT


def test_loss(spark):
    assert run(spark, [("buy", 1, 300, 1), ("sell", 1, 100, 2)])["totals"].first().realized == -200 * UNIT


def test_chain_of_trades(spark):
    out = run(spark, [("buy", 3, 300, 1), ("buy", 2, 400, 2), ("sell", 1, 150, 3), ("sell", 3, 900, 4), ("buy", 1, 250, 5)])
    stats = out["stats"].first()
    assert (stats.realized, stats.trades, stats.wins) == (550 * UNIT, 5, 2)
    held = positions(out["lots"]).first()
    assert (held.qty_held, held.cost_basis, out["consumed"].count()) == (2, 450 * UNIT, 3)


def test_nothing(spark):
    out = run(spark, [])
    assert out["consumed"].count() == out["lots"].count() == out["stats"].count() == 0


def random_rows(seed, wallets=12, length=25):
    rng = random.Random(seed)
    return [
        (f"w{rng.randrange(wallets)}", f"t{rng.randrange(2)}", rng.choice(["buy", "buy", "sell"]), rng.randint(1, 40), rng.randint(1, 5000), block, rng.randrange(3), f"x{block}")
        for block in range(wallets * length)
    ]


def by_queue(rows):
    held, drawn = {}, []
    for wallet, token, side, qty, _, block, log, _ in sorted(rows, key=lambda r: (r[5], r[6])):
        queue = held.setdefault((wallet, token), deque())
        if side == "buy":
            queue.append([block, log, qty])
            continue
        while qty and queue:
            take = min(qty, queue[0][2])
            drawn.append((wallet, token, block, queue[0][0], take))
            queue[0][2] -= take
            qty -= take
            if not queue[0][2]:
                queue.popleft()
        if qty:
            drawn.append((wallet, token, block, block, qty))
    return sorted(drawn), sorted((*k, b, g, q) for k, lots in held.items() for b, g, q in lots)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_positions_equal_a_queue(spark, seed):
    rows = random_rows(seed)
    axis = fifo_axis(spark.createDataFrame(rows, SCHEMA))
    drawn, left = by_queue(rows)
    got = sorted((r.wallet, r.token, r.sell_block, r.lot_block, r.qty) for r in fifo_consume(axis).collect())
    assert got == drawn
    lots = open_lots(axis)
    assert sorted((r.wallet, r.token, r.lot_block, r.lot_log, r.remaining) for r in lots.collect()) == left
    assert check_lots(positions(lots)).first().faults == 0


@pytest.mark.parametrize("fork", [0, 90, 150, 299])
def test_revert_equals_a_clean_run(spark, fork):
    """Oversells and buys of one block included."""
    rows = spark.createDataFrame(random_rows(9), SCHEMA)
    out, clean = replay(rows), replay(rows.filter(f"block_number <= {fork}"))
    ledger, pieces = revert_ledger(out["consumed"], fork)
    assert diff_state(ledger, clean["consumed"]).count() == 0
    key = ["wallet", "token", "lot_block", "lot_log", "remaining"]
    assert diff_state(restore_lots(out["lots"], pieces, fork).select(*key), clean["lots"].select(*key)).count() == 0
    assert diff_state(revert_stats(out["stats"], rows, out["consumed"], fork), clean["stats"]).count() == 0


def test_parts_add_up(spark):
    out = run(spark, [("buy", 3, 100, 1), ("buy", 4, 100, 2), ("sell", 7, 1000, 3)])
    assert abs(sell_totals(out["consumed"]).first().proceeds - 1000 * UNIT) <= 1


def test_amounts_over_a_long(spark):
    """Raw units of 18 decimals: the same money as in whole tokens."""
    rows = [("w", "t", "buy", 90, 700, 1), ("w", "t", "buy", 60, 1000, 2), ("w", "t", "sell", 100, 3333, 3), ("w", "t", "sell", 77, 1001, 4)]
    small = spark.createDataFrame([(*r, 0, str(r[-1])) for r in rows], SCHEMA_SMALL)
    wide = small.withColumn("qty", (F.col("qty").cast("decimal(38,0)") * F.lit(10**12).cast("decimal(13,0)") * F.lit(10**12).cast("decimal(13,0)")).cast("decimal(38,0)"))
    kept = ["sell_block", "consume_seq", "lot_block", "proceeds", "cost", "realized"]
    want = sorted(map(tuple, fifo_consume(fifo_axis(small)).select(*kept).collect()), key=repr)
    assert sorted(map(tuple, fifo_consume(fifo_axis(wide)).select(*kept).collect()), key=repr) == want and len(want) == 4
    lots = open_lots(fifo_axis(wide.filter("block_number < 4")))
    assert positions(lots).first().cost_basis == positions(open_lots(fifo_axis(small.filter("block_number < 4")))).first().cost_basis


SCHEMA_SMALL = "wallet string, token string, side string, qty long, value long, block_number long, log_index long, tx_hash string"


def test_shares_of_wide_amounts(spark):
    import random

    from dexspark.operators.fifo import share

    rng = random.Random(2)
    rows = []
    for _ in range(300):
        whole = rng.randrange(1, 10 ** rng.randrange(1, 32))
        rows.append((rng.randrange(10 ** rng.randrange(1, 13)), rng.randrange(whole + 1), whole))
    table = spark.createDataFrame([(v, Decimal(p), Decimal(w)) for v, p, w in rows], "value long, part decimal(38,0), whole decimal(38,0)")
    got = [r[0] for r in table.select(share(F.col("value"), F.col("part"), F.col("whole"), "decimal(38,0)")).collect()]
    assert got == [(2 * v * 10**6 * p + w) // (2 * w) for v, p, w in rows]
