"""A book of all tables against a clean run: reverts, late and repeated rows, rewinds beside the stream, other writers."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from dexspark.functions.money import value_exact
from dexspark.operators.candles import candles
from dexspark.operators.fifo import fifo_axis, fifo_consume, open_lots, share
from dexspark.operators.hot import dealt, replay_spread
from dexspark.operators.quality import check_ledger, check_lots, diff_state
from dexspark.operators.revert import replay, replay_from
from dexspark.operators.fifo import positions
from dexspark.operators.wallets import scorecards_all
from dexspark.sources.tables import Conflict, Store
from dexspark.streaming.book import Book, named, record
from tests.test_fifo import SCHEMA, random_rows

T0 = datetime(2024, 3, 1)
COLUMNS = named(record())


def swap(block, log=0, branch="", rng=None):
    rng = rng or random.Random(f"{block}:{log}:{branch}")
    side, qty = rng.choice(["buy", "buy", "sell"]), rng.randrange(1, 40)
    row = {"seq": block * 10 + log, "kind": "swap", "block_number": block, "block_time": T0 + timedelta(hours=block), "tx_hash": f"x{block}{branch}", "log_index": log}
    return row | {"pool": rng.choice("pq"), "recipient": rng.choice("abc"), "price": float(qty), "amount0": qty, "amount1": -qty, "token": rng.choice("st"), "side": side, "qty": qty, "value": rng.randrange(1, 5000)}


def header(block, branch=""):
    return {"seq": block * 10, "kind": "block", "block_number": block, "block_time": T0 + timedelta(hours=block), "block_hash": f"h{block}{branch}", "parent_hash": f"h{block - 1}{branch}"}


def mark(kind, block, seq):
    return {"seq": seq, "kind": kind, "from_block": block}


def table(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], record())


def trades_of(spark, rows):
    return table(spark, rows).filter("kind = 'swap'").select(F.col("recipient").alias("wallet"), "token", "side", "qty", "value", "block_number", "log_index", "tx_hash")


def assert_equals_clean(spark, book, rows):
    """All tables against what the surviving rows give at once."""
    clean = replay(trades_of(spark, rows))
    consumed = book.read("consumed")
    pairs = [
        (consumed.drop("lot_qty", "lot_value"), clean["consumed"]),
        (book.read("lots"), clean["lots"].select(*book.read("lots").columns)),
        (book.stats(), clean["stats"]),
        (book.read("trades"), trades_of(spark, rows)),
    ]
    swaps = table(spark, rows).filter("kind = 'swap'")
    pairs += [(book.read(r), candles(swaps, r).select(*book.read(r).columns)) for r in ("1m", "1h", "1d")]
    pairs.append((book.read("headers").select("number", "block_hash"), table(spark, rows).filter("kind = 'block'").select(F.col("block_number").alias("number"), "block_hash")))
    for got, want in pairs:
        faults = diff_state(got, want).limit(3).collect()
        assert not faults, faults
    assert check_ledger(book.read("stats"), consumed).first().equal
    assert book.read("state").first().live_cursor == max(r["block_number"] for r in rows)


def blocks(first, last, branch=""):
    return [r for b in range(first, last + 1) for r in (header(b, branch), swap(b, 0, branch), swap(b, 1, branch))]


def test_reverts_late_rows_and_rewinds_equal_a_clean_run(spark, tmp_path):
    book = Book(spark, f"file://{tmp_path}/b", blocks=10, parts=2)
    late = [swap(12, 5), swap(25, 5)]
    book.apply(table(spark, blocks(1, 30)), 0)
    book.apply(table(spark, blocks(1, 30)), 0)  # a repeated batch changes nothing
    # an orphan branch, a revert in the middle of a batch, and rows that come again
    book.apply(table(spark, [*blocks(31, 38, "b"), mark("revert", 28, 10**6), *[r | {"seq": r["seq"] + 10**7} for r in [*blocks(29, 36), *blocks(20, 22)]]]), 1)
    assert_equals_clean(spark, book, blocks(1, 36))
    book.apply(table(spark, [*late, mark("final", 20, 10**8)]), 2)
    assert book.read("state").first().finalized_height == 20 and book.read("headers").agg(F.min("number")).first()[0] == 21
    book.rewind(24)
    survivors = [r for r in [*blocks(1, 24), late[0]] if r["kind"] != "block" or r["block_number"] > 20]
    assert_equals_clean(spark, book, survivors)
    assert not diff_state(book.stats(), replay(trades_of(spark, survivors))["stats"]).count()
    # the stream's next batch has the number after its last one, and is applied
    book.apply(table(spark, blocks(25, 27, "c")), 3)
    assert_equals_clean(spark, book, survivors + blocks(25, 27, "c"))
    with pytest.raises(ValueError, match="final"):
        book.rewind(19)
    with pytest.raises(RuntimeError, match="checkpoint"):
        book.apply(table(spark, blocks(1, 1)), 0)


def test_a_batch_starts_again_if_a_rewind_came_first(spark, tmp_path, monkeypatch):
    book = Book(spark, f"file://{tmp_path}/b", blocks=10, parts=2)
    book.apply(table(spark, blocks(1, 5)), 0)
    other, once = Book(spark, f"file://{tmp_path}/b", blocks=10, parts=2), []
    commit = Store.commit

    def slow(self, changes, batch=None, view=None):
        if batch == 1 and not once:
            once.append(True)
            other.rewind(3)
        return commit(self, changes, batch, view)

    monkeypatch.setattr(Store, "commit", slow)
    book.apply(table(spark, blocks(6, 7)), 1)
    assert_equals_clean(spark, book, blocks(1, 3) + blocks(6, 7))


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", {"a": ("k long, v string", F.col("k") % 3)})
    rows = spark.range(9).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    stale = store.view()
    assert store.commit({"a": (rows, ["0", "1", "2"])}, 0)
    with pytest.raises(Conflict):
        store.commit({"a": (rows, ["0", "1", "2"])}, 1, stale)
    with pytest.raises(ValueError, match="not replaced"):
        store.commit({"a": (rows, ["0"])}, 1)
    with store.pinned() as view:
        for n in range(1, 12):
            store.commit({"a": (rows.filter("k = 4").withColumn("v", F.lit(str(n))), ["1"])}, n)
        store.expire(2)
        assert view.read("a").count() == 9
    files = list((tmp_path / "s").rglob("*.parquet"))
    assert store.read("a").count() == 7 and store.view().batch == 11
    assert store.expire(2) == 1 and len(list((tmp_path / "s").rglob("*.parquet"))) < len(files) <= 12
    assert sorted(r.v for r in store.read("a").collect()) == ["11"] + ["x"] * 6
    assert len(list((tmp_path / "s" / "commits").glob("[0-9]*"))) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_positions_spread_over_tasks_equal_whole_ones(spark, seed):
    rows = spark.createDataFrame(random_rows(seed, wallets=3, length=90), SCHEMA)
    for trades in (rows, rows.withColumn("qty", F.col("qty").cast("decimal(38,0)"))):
        got, want = replay_spread(trades, 30), replay(trades)
        for name in want:
            assert not diff_state(got[name].select(*want[name].columns), want[name]).limit(3).collect(), name
    sizes = [r["count"] for r in dealt(rows.withColumns({"wallet": F.lit("w"), "token": F.lit("t")}), F.col("block_number")).groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * rows.count() / 4
    assert replay_spread(rows.limit(0))["stats"].count() == 0


def units(value):
    """A value in units of 10^-8."""
    with localcontext(prec=80):
        return int(value.scaleb(8))


def test_values_are_exact(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(10 ** rng.randrange(1, 38)), rng.randrange(0, 31), rng.randrange(10 ** rng.randrange(1, 36))) for _ in range(400)]
    rows += [(0, 18, 1), (10**38 - 1, 38, 10**18), (5, 9, 10**17), (1, 0, 5 * 10**9)]

    def exact(raw, decimals, price):
        unit = 10 ** (decimals + 10)
        return (2 * raw * price + unit) // (2 * unit)

    rows = [r for r in rows if exact(*r) < 10**29]
    frame = spark.createDataFrame([(Decimal(r), d, Decimal(f"{p}e-18")) for r, d, p in rows], "raw decimal(38,0), d int, price decimal(38,18)")
    got = [units(r[0]) for r in frame.select(value_exact(F.col("raw"), F.col("d"), F.col("price"))).collect()]
    assert [x for x in zip(rows, got, map(lambda r: exact(*r), rows)) if x[1] != x[2]] == [] and len(rows) > 250


def test_shares_of_longs_to_their_limit_and_of_exact_money(spark):
    rng = random.Random(6)
    whole = [rng.randrange(1, 2**63) for _ in range(100)] + [2**63 - 1]
    rows = [(rng.randrange(10**12), rng.randrange(w + 1), w) for w in whole]
    frame = spark.createDataFrame(rows, "v long, p long, w long")
    assert [r[0] for r in frame.select(share(F.col("v"), F.col("p"), F.col("w"), "long")).collect()] == [(2 * v * p * 10**6 + w) // (2 * w) for v, p, w in rows]
    rows = [(Decimal(f"{rng.randrange(10**24)}e-8"), Decimal(rng.randrange(w + 1)), Decimal(w)) for w in (rng.randrange(1, 10**30) for _ in range(100))]
    frame = spark.createDataFrame(rows, "v decimal(38,8), p decimal(38,0), w decimal(38,0)")
    got = [units(r[0]) for r in frame.select(share(F.col("v"), F.col("p"), F.col("w"), "decimal(38,0)", "decimal(30,8)")).collect()]
    assert got == [(2 * int(v.scaleb(8)) * int(p) + int(w)) // (2 * int(w)) for v, p, w in rows]


def test_wide_quantities_and_exact_money_everywhere(spark):
    """Thirds of 18 decimals: costs add up to the lot's, scorecards and checks take them, a snapshot in between changes nothing."""
    unit = 10**18
    rows = [("w", "t", "buy", Decimal(3 * unit), Decimal(100), 1, 0, "a"), *[("w", "t", "sell", Decimal(unit), Decimal("50.5"), n, 0, f"s{n}") for n in (2, 3, 4)], ("w", "t", "buy", Decimal(7 * unit + 1), Decimal("0.00000004"), 5, 0, "b")]
    trades = spark.createDataFrame(rows, SCHEMA.replace("qty long, value long", "qty decimal(38,0), value decimal(38,8)"))
    run = replay(trades)
    assert sorted(r.cost for r in run["consumed"].collect()) == [Decimal("33.33333333")] * 3
    assert run["stats"].first().realized == Decimal("51.50000001") and run["stats"].first().volume == Decimal("251.50000004")
    held = positions(run["lots"])
    assert (held.first().qty_held, held.first().cost_basis) == (7 * unit + 1, Decimal("0.00000004")) and check_lots(held).first().faults == 0
    assert scorecards_all(run["stats"], run["lots"], run["totals"]).first().open_positions[0].qty == 7 * unit + 1
    first = open_lots(fifo_axis(trades.filter("block_number <= 2")))
    later = replay_from(first, trades.filter("block_number > 2")).collect()
    assert [r.cost for r in later] == [Decimal("33.33333333")] * 2
    small = spark.createDataFrame([("w", "t", "buy", 3, 100, 1, 0, "a"), *[("w", "t", "sell", 1, 1, n, 0, f"s{n}") for n in (2, 3, 4)], ("w", "t", "buy", 5 * 10**18, 10, 6, 0, "c"), ("w", "t", "sell", 5 * 10**18, 10, 7, 0, "d")], SCHEMA)
    lots = open_lots(fifo_axis(small.filter("block_number <= 2")))
    assert sorted(r.cost for r in replay_from(lots, small.filter("block_number > 2")).collect()) == [10_000_000, 33_333_333, 33_333_333]
    assert fifo_consume(fifo_axis(small)).count() == 4


def test_a_branch_that_does_not_fit_reverts_to_its_fork(spark, tmp_path):
    """Found by a mismatch at the top, by blocks given again from the fork on, and not at all where it lies below the final height."""
    held = {"top": 6, "name": ""}

    def canonical():
        return table(spark, [header(b, held["name"] if b > 4 else "") | ({"parent_hash": "h4"} if b == 5 else {}) for b in range(1, 13)]).select(F.col("block_number").alias("number"), "block_hash", "parent_hash")

    def branch(first, last, name):
        rows = blocks(first, last, name)
        return [r | {"parent_hash": "h4"} if r["kind"] == "block" and r["block_number"] == 5 else r for r in rows]

    book = Book(spark, f"file://{tmp_path}/b", blocks=10, parts=2, canonical=canonical)
    book.apply(table(spark, blocks(1, 8)), 0)
    held["name"] = "b"
    book.apply(table(spark, branch(9, 9, "b")), 1)  # its parent is not the recorded block 8
    assert_equals_clean(spark, book, blocks(1, 4))
    book.apply(table(spark, branch(5, 9, "b")), 2)
    assert_equals_clean(spark, book, blocks(1, 4) + branch(5, 9, "b"))
    held["name"] = "c"
    book.apply(table(spark, branch(5, 7, "c")), 3)  # the blocks from the fork on at once
    assert_equals_clean(spark, book, blocks(1, 4) + branch(5, 7, "c"))
    assert sorted(map(tuple, book.read("reverts").collect())) == [(1, 9, 4), (3, 5, 4)]
    book.finalise(6)
    held["name"] = "d"
    with pytest.raises(ValueError, match="fork is not found"):
        book.apply(table(spark, branch(8, 8, "d")), 4)


@pytest.mark.parametrize(("cost", "kind"), [(1 << 62, "decimal(38,0)"), (5, "bigint")])
def test_totals_of_a_book_pass_a_long(spark, tmp_path, cost, kind):
    from dexspark.plans.registry import book_totals

    held = Book(spark, f"file://{tmp_path}/book", parts=2)
    row = {"sell_tx": "x", "wallet": "a", "token": "s", "qty": 1, "sell_block": 1, "cost": cost}
    schema = held.store.tables["consumed"][0]
    rows = spark.createDataFrame([tuple(row.get(c) for c in named(schema))] * 3, schema)
    held.store.commit({"consumed": (rows, ["0"])})
    found = book_totals(held, {"consumed": "cost", "lots": "remaining"})
    assert dict(found.dtypes)["total"] == kind
    assert {r["name"]: (r["rows"], r["total"]) for r in found.collect()} == {"consumed": (3, 3 * cost), "lots": (0, None)}
