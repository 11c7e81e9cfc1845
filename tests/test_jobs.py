"""Chain, alerts, wash flags, pages, retention, discovery and keyed tables on small inputs."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dexspark.operators import alerts, chain, discovery, pages, quality, retention, trades, wallets
from dexspark.operators import decode as d
from dexspark.schemas import RAW_LOGS
from dexspark.sources import logs
from dexspark.sources.tables import Snapshots, append_new, merge_add, upsert
from tests.test_decode import log, topic, word  # noqa: F401

T0 = datetime(2024, 3, 1)


def headers(spark, first, last, name="a", above=10**9):
    def hash_of(n):
        return f"{'b' if n > above else name}{n}"

    return spark.createDataFrame([(n, hash_of(n), hash_of(n - 1), T0) for n in range(first, last + 1)], "number long, block_hash string, parent_hash string, block_time timestamp")


@pytest.mark.parametrize(("above", "expected"), [(110, (110, None)), (119, (119, None)), (90, (None, "final"))])
def test_fork_point(spark, above, expected):
    assert tuple(chain.fork_point(headers(spark, 100, 120), headers(spark, 100, 125, above=above), 120, 100).first()) == expected


def test_fork_point_finds_holes(spark):
    recorded = headers(spark, 100, 120).filter("number <> 115")
    assert tuple(chain.fork_point(recorded, headers(spark, 100, 125, above=110), 120, 100).first()) == (None, "hole")


def test_continuity(spark):
    rows = headers(spark, 5, 8).union(spark.createDataFrame([(9, "x", "other", T0), (20, "y", "z", T0)], headers(spark, 1, 1).schema))
    assert {r.number: r.status for r in chain.continuity(rows).collect()} == {5: "extends", 6: "ok", 7: "ok", 8: "ok", 9: "mismatch", 20: "extends"}


def test_backfill_cursor(spark):
    def cursor(ranges):
        return chain.backfill_cursor(spark.createDataFrame(ranges, "lo long, hi long"), 0).first().cursor

    assert cursor([(0, 9), (10, 19), (30, 39)]) == 19
    assert cursor([(0, 50), (10, 19), (51, 60)]) == 60
    assert cursor([(5, 9)]) is None
    assert cursor([]) is None


def test_finality_is_monotone(spark):
    state = spark.createDataFrame([(10, 5, 100)], "live_cursor long, finalized_height long, head_height long")
    assert chain.advance_finality(state, 90, 95).first().finalized_height == 90
    assert chain.advance_finality(state, 90, 3).first().finalized_height == 5
    rows = spark.createDataFrame([(1,), (9,)], "block_number long")
    assert chain.final(rows, None).count() == 0 and chain.pending(rows, None).count() == 2
    assert pages.ingest_status(state).first().lag == 90
    assert pages.ingest_status(state.withColumn("live_cursor", F.lit(None).cast("long"))).first().lag is None


def classified(spark, rows):
    pools = spark.createDataFrame([("wu", "WETH", "USDC", 0, 0), ("sw", "SHIB", "WETH", 0, 0), ("xy", "X", "Y", 0, 0), ("bad", "X", "Y", None, 0)], "address string, token0 string, token1 string, decimals0 int, decimals1 int")
    money = spark.createDataFrame([("WETH", 3000), ("USDC", 1)], "token string, usd long")
    swaps = spark.createDataFrame(rows, "pool string, amount0 long, amount1 long")
    return trades.classify(trades.value_trades(trades.with_direction(trades.with_pool_meta(swaps, pools)), money)).collect()


def test_classes(spark):
    got = {(r.pool, r.amount0): (r["class"], r.value) for r in classified(spark, [("wu", 1, -3000), ("sw", 42, -2), ("sw", -42, 2), ("xy", 1, -1), ("bad", 1, -1), ("wu", 0, -5)])}
    assert got == {("wu", 1): ("money_for_money", 3000), ("sw", 42): ("sell", 6000), ("sw", -42): ("buy", 6000), ("xy", 1): ("unpriceable", None), ("wu", 0): ("skipped", 5 * 1)}


def swaps(spark, rows):
    return spark.createDataFrame(rows, "sender string, recipient string, pool string, amount0 long")


def test_wash(spark):
    rows = [("a", "clean", "p", 5), ("b", "clean", "p", 4)] + [("self", "self", "p", 10)] * 3 + [("z", "churn", "p", 100 * (-1) ** k) for k in range(6)]
    stats = spark.createDataFrame([("clean",), ("self",), ("churn",)], "wallet string")
    flags = {r.wallet: r.excluded for r in wallets.flag_wash(stats, wallets.wash_wallets(swaps(spark, rows))).collect()}
    assert flags == {"clean": False, "self": True, "churn": True}
    held = stats.withColumn("excluded", F.col("wallet") == "clean")
    none = wallets.wash_wallets(swaps(spark, []))
    assert wallets.flag_wash(held, none, sticky=True).filter("excluded").count() == 1
    assert wallets.flag_wash(held, none).filter("excluded").count() == 0


def test_leaderboard_breaks_ties(spark):
    stats = spark.createDataFrame([("b", 5, False), ("a", 5, False), ("c", 9, True)], "wallet string, realized long, excluded boolean")
    assert [(r.rank, r.wallet) for r in wallets.leaderboard(stats).orderBy("rank").collect()] == [(1, "a"), (2, "b")]


def test_page_walk(spark):
    rows = spark.createDataFrame([(100, 0), (101, 0), (102, 0)], "block_number long, log_index long").withColumn("pool", F.lit("p"))
    first = pages.swaps_page(rows, "p", None, 2).collect()
    assert [(r.block_number, r.has_more) for r in first] == [(102, True), (101, True)]
    second = pages.swaps_page(rows, "p", (101, 0), 2).collect()
    assert [(r.block_number, r.has_more) for r in second] == [(100, False)]
    assert (pages.clamp(None), pages.clamp(0), pages.clamp(9999)) == (50, 1, 500)
    with pytest.raises(ValueError):
        pages.candles_page(rows, "p", "5m")


@pytest.mark.parametrize(("finalized", "expected"), [(1000, ["2023-11-22"]), (None, []), (5000, ["2023-11-22", "2024-01-01"])])
def test_prune(spark, finalized, expected):
    raw = spark.createDataFrame([(datetime(2023, 11, 22), 500), (datetime(2024, 1, 1), 2000), (datetime(2024, 2, 29), 3000)], "block_time timestamp, block_number long")
    got = retention.droppable_days(raw, F.lit("2024-03-01").cast("date"), 30, finalized).orderBy("day").collect()
    assert [str(r.day) for r in got] == expected


def test_moves_fire_once(spark, tmp_path):
    rows = spark.createDataFrame([("w", "p", f"t{v}", 0, 90, v, "buy") for v in (300, 50)] + [("x", "p", "t9", 0, 90, 900, "buy")], "recipient string, pool string, tx_hash string, log_index long, block_number long, value long, side string")
    watched = spark.createDataFrame([("w",)], "wallet string")
    found = alerts.watchlist_moves(rows, watched, 100, 100, 50)
    assert [r.alert_key for r in found.collect()] == ["move:t300:0"]
    sent = spark.createDataFrame([], "alert_key string, sent_at timestamp")
    path = str(tmp_path / "sent")
    assert alerts.claim_new(found, path, sent, F.lit(T0)).count() == 1
    assert alerts.claim_new(found, path, spark.read.parquet(path), F.lit(T0)).count() == 0


@pytest.mark.parametrize(("times", "fires"), [((0, 60, 120), 1), ((0, 60), 0), ((0, 60, 9000), 0)])
def test_clusters(spark, times, fires):
    rows = spark.createDataFrame([(f"w{k}", "t", 90, T0 + timedelta(seconds=s)) for k, s in enumerate(times)], "recipient string, token string, block_number long, block_time timestamp")
    watched = spark.createDataFrame([(f"w{k}",) for k in range(3)], "wallet string")
    assert alerts.cluster_buys(rows, watched, 100, alerts.cluster_lookback(600), 3, 600).count() == fires


def test_discovery(spark):
    def created(n):
        return (f"0x{'f' * 40}", [d.POOL_CREATED, topic(1), topic(2), topic(3000)], "0x" + word(60) + word(n), 90, f"c{n}", n)

    def mint(n, owner, at):
        return (f"0x{n:040x}", [d.MINT, topic(owner), topic(1), topic(2)], "0x" + word(1) * 4, 95, "m", at)

    logs_ = spark.createDataFrame([created(1), created(2), created(3), mint(2, 5, 10), mint(2, 5, 11), mint(3, 5, 12), mint(3, 6, 13), mint(3, 7, 14)], RAW_LOGS)
    got = {int(r.address, 16): r.risk_flags for r in discovery.discover_pools(logs_, 100).collect()}
    assert got == {1: ["fresh", "no_liquidity"], 2: ["fresh", "single_lp"], 3: ["fresh"]}
    pools = spark.createDataFrame([(f"0x{1:040x}",)], "address string")
    assert discovery.capture_pools(pools, discovery.discover_pools(logs_, 100)).count() == 2


def test_blocks_keep_their_empty_ones(spark):
    rows = spark.createDataFrame([log([d.SWAP], [1], 3)], RAW_LOGS)
    blocks = logs.blocks_with_logs(headers(spark, 6, 8), rows)
    assert {r.number: len(r.logs) for r in blocks.collect()} == {6: 0, 7: 1, 8: 0}
    kept, flat = logs.explode_blocks(blocks)
    assert (kept.count(), flat.count()) == (3, 1)
    assert [r.block_number for r in logs.active_blocks(rows, 1, 9).collect()] == [7]


def test_every_log_is_in_a_block(spark):
    from dexspark.plans import registry, views
    from tests.conftest import SMALL

    got = registry.queries()["blocks_with_all_logs"](spark, SMALL).agg(F.sum("logs")).first()[0]
    assert got == views.raw_logs(views.swaps(spark, SMALL)).count()


def test_bad_text_is_an_error(spark):
    text = spark.createDataFrame([("1", "nope")], "block_time string, amount0 string")
    with pytest.raises(Exception):
        logs.load_backfill(text, {"block_time": "timestamp", "amount0": "long"}, F.lit(T0))[1].collect()


def test_keyed_tables(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, v long, n long")
    new = spark.createDataFrame([("a", 1, 11), ("a", 0, 12), ("c", 5, 1)], "k string, v long, n long")
    assert {(r.k, r.n) for r in upsert(old, new, ["k"], "v").collect()} == {("a", 11), ("b", 20), ("c", 1)}
    assert {(r.k, r.n, r.v) for r in merge_add(old, new, ["k"], ["n"], ["v"]).collect()} == {("a", 33, 1), ("b", 20, 2), ("c", 1, 5)}
    assert append_new(old, new, ["k"]).count() == 1
    held = Snapshots(spark, f"file://{tmp_path}/s", "k string, v long, n long")
    assert held.read().count() == 0
    assert held.write(old, 1) and not held.write(new, 1) and held.write(new, 2)
    assert held.read().count() == 3


def test_quality(spark):
    assert quality.check_gap_free(headers(spark, 5, 9), 5).first().gap_free
    assert not quality.check_gap_free(headers(spark, 5, 9).filter("number <> 7")).first().gap_free
    state = spark.createDataFrame([(10,)], "live_cursor long")
    assert not quality.check_cursor(state, headers(spark, 5, 9)).first().ok
    assert quality.check_event_parity(headers(spark, 5, 9), spark.createDataFrame([(4,), (5,)], "block_number long")).first().orphans == 1


def test_store_commits_parts_together(spark, tmp_path):
    from dexspark.sources.tables import Store

    store = Store(spark, f"file://{tmp_path}/s", {"a": ("k long, v string", F.col("k") % 3), "b": ("n long", F.lit(0))})
    rows = spark.range(9).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    assert store.read("a").count() == 0 and store.view().version == 0
    assert store.commit({"a": (rows, ["0", "1", "2"]), "b": (rows.select(F.col("k").alias("n")), ["0"])}, 0)
    assert not store.commit({"a": (rows.limit(0), ["0"])}, 0)
    assert store.commit({"a": (rows.filter("k = 4").withColumn("v", F.lit("y")), ["1", "2"])}, 1)
    assert sorted((r.k, r.v) for r in store.read("a").collect()) == [(0, "x"), (3, "x"), (4, "y"), (6, "x")]
    assert store.read("b").count() == 9 and store.read("a", ["1"]).count() == 1
    with pytest.raises(RuntimeError, match="checkpoint"):
        store.commit({"a": (rows, ["0"])}, 0)


def test_stream_by_time_takes_what_comes(spark, tmp_path):
    """Batches of two files at most while files come, none for nothing."""
    from dexspark.streaming.ingest import read_block_stream, run_every

    source, kinds, sizes = str(tmp_path / "in"), "block_number long, log_index long", []
    rows = spark.createDataFrame([(n, 0) for n in range(6)], kinds)
    for n in range(3):
        rows.filter(F.col("block_number") % 3 == n).coalesce(1).write.mode("append").parquet(source)
    running = run_every(read_block_stream(spark, source, kinds, files=2), lambda batch, n: sizes.append(batch.count()), str(tmp_path / "check"), "1 second")
    try:
        running.processAllAvailable()
        rows.limit(0).coalesce(1).write.mode("append").parquet(source)
        running.processAllAvailable()
    finally:
        running.stop()
    assert sizes == [4, 2]


def test_tick_sees_only_its_window(spark):
    rows = spark.createDataFrame(
        [("w", "p", f"t{b}", 0, b, T0, 500, "buy") for b in (10, 90)] + [("x", "p", "t5", 0, 90, T0, 5, "buy"), ("y", "p", "t6", 0, 90, T0, 5, "sell")],
        "recipient string, pool string, tx_hash string, log_index long, block_number long, block_time timestamp, value long, side string",
    ).withColumn("token", F.col("pool"))
    watched = spark.createDataFrame([("w",), ("x",), ("y",)], "wallet string")
    pools = spark.createDataFrame([("a", 50, T0, False, ["fresh"]), ("b", 150, T0, False, ["fresh"]), ("c", 50, T0, True, [])], "address string, created_block long, discovered_at timestamp, is_indexed boolean, risk_flags array<string>")
    found = alerts.tick(rows, watched, pools, 100, (50, 20), 100, 2, 600)
    assert {(r.rule, r.alert_key.split(":")[1]) for r in found.collect()} == {("move", "t90"), ("cluster", "p"), ("newpool", "a")}
    assert alerts.tick(rows.limit(0), watched, pools.limit(0), 100, (50, 20), 100, 2, 600).count() == 0


def test_scans_read_the_days_of_their_range(spark, tmp_path):
    """Files read follow the range of blocks, found when the scan runs."""
    import re

    path = str(tmp_path / "logs")
    rows = spark.createDataFrame([(f"0x{b % 5:040x}", ["t"], "0x", b, f"x{b}", 0) for b in range(200)], RAW_LOGS)
    heads = spark.range(200).select(F.col("id").alias("number"), F.lit("h").alias("block_hash"), F.lit("p").alias("parent_hash"), F.timestamp_seconds(F.col("id") * 8640).alias("block_time"))
    logs.write_logs(rows, heads, path)
    own = spark.createDataFrame([(f"0x{3:040x}",), (f"0x{3:040x}",)], "address string")
    found = logs.scan_logs(spark.read.parquet(path), 50, 59, own, heads)
    assert sorted(r.block_number for r in found.collect()) == [53, 58]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    scan = logs.scan_logs(spark.read.parquet(path), 50, 59, None, heads)
    assert scan.count() == 10 and len(scan.select(F.input_file_name()).distinct().collect()) <= 5 < len(set(re.findall(r"day=[\d-]+", str(list((tmp_path / "logs").rglob("*.parquet"))))))


def test_wide_volumes(spark):
    import random

    from dexspark.functions.wide import limbs, to_text
    from dexspark.operators.candles import wide_candles, wide_rollup

    rng = random.Random(3)
    rows = [("p", T0 + timedelta(minutes=n % 7, hours=n % 3), 1.0, rng.randrange(-(2**255), 2**255), rng.randrange(2**200), n, 0) for n in range(60)]
    text = [(p, t, x, f"{a % 2**256:064x}", f"{b:064x}", n, g) for p, t, x, a, b, n, g in rows]
    frame = spark.createDataFrame(text, "pool string, block_time timestamp, price double, w0 string, w1 string, block_number long, log_index long")
    frame = frame.withColumns({"amount0": limbs("w0", True), "amount1": limbs("w1", True)})
    got = wide_rollup(wide_candles(frame), "1d").select(to_text(F.col("volume0")), to_text(F.col("volume1")), "trade_count").first()
    assert tuple(got) == (str(sum(abs(r[3]) for r in rows)), str(sum(r[4] for r in rows)), 60)
