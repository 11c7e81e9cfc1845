"""Decoding: a real swap, extreme words and malformed logs."""

from __future__ import annotations

import random

from dexspark.functions.wide import limbs, to_text, word_to_num
from dexspark.operators import decode as d
from dexspark.schemas import RAW_LOGS


def word(value: int) -> str:
    return f"{value % (1 << 256):064x}"


def log(topics, words, at=0, cut=0):
    data = "0x" + "".join(map(word, words))
    return ("0x" + "1" * 40, topics, data[: len(data) - cut], 7, f"t{at}", at)


def topic(value: int) -> str:
    return "0x" + word(value)


# Amounts, price, liquidity and tick of a public swap.
REAL = [140586, -74025266944810, 1820754252512732283398282170500178, 1620197336976127727, 200858]


def test_real_swap(spark):
    logs = spark.createDataFrame([log([d.SWAP, topic(5), topic(5)], REAL, 39)], RAW_LOGS)
    row = d.decode_swaps(logs).first()
    assert [int(row.amount0), int(row.amount1), int(row.sqrt_price_x96), int(row.liquidity), row.tick] == REAL
    assert row.sender == row.recipient == "0x" + f"{5:040x}" and row.log_index == 39


def test_mint(spark):
    logs = spark.createDataFrame([log([d.MINT, topic(9), topic(200000), topic(201000)], [1, 1000000, 250, 400])], RAW_LOGS)
    row = d.decode_mints(logs).first()
    assert (row.kind, row.tick_lower, row.tick_upper, int(row.amount), int(row.amount0), int(row.amount1)) == ("mint", 200000, 201000, 1000000, 250, 400)
    assert d.liq_events(logs).count() == 1


def test_collect_moves_no_liquidity_and_negative_ticks(spark):
    logs = spark.createDataFrame([log([d.COLLECT, topic(9), topic(-10), topic(-5)], [1, 250, 400])], RAW_LOGS)
    row = d.decode_collects(logs).first()
    assert (row.tick_lower, row.tick_upper, int(row.amount), int(row.amount0)) == (-10, -5, 0, 250)


def test_misses_count_as_unknown(spark):
    rows = [log(["0x" + "a" * 64], [1]), log([], [1], 1), log([d.SWAP, topic(1), topic(2)], REAL, 2, cut=2), log([d.SWAP, topic(1), topic(2)], REAL, 3), (None, None, None, None, None, None)]
    logs = spark.createDataFrame(rows, RAW_LOGS)
    counts = {r.outcome: 0 for r in d.classify_logs(logs).collect()}
    for r in d.classify_logs(logs).collect():
        counts[r.outcome] += r.logs
    assert counts == {"unknown": 4, "swap": 1}
    assert d.decode_swaps(logs).count() == 1


def test_words_are_exact(spark):
    rng = random.Random(4)
    values = [0, 1, -1, 2**63 - 1, 2**63, -(2**63), -(2**63) - 1, 2**64, 2**255 - 1, -(2**255), 10**26, -(10**26), 10**52 - 1, -(10**52), 10**38 - 1, 10**38] + [rng.randint(-(2**255), 2**255 - 1) >> rng.randrange(250) for _ in range(300)]
    rows = spark.createDataFrame([(str(v), word(v)) for v in values], "v string, w string")
    assert rows.filter(to_text(limbs("w", True)) != rows.v).count() == 0
    unsigned = spark.createDataFrame([(str(v % 2**256), word(v)) for v in values], "v string, w string")
    assert unsigned.filter(to_text(limbs("w", False)) != unsigned.v).count() == 0
    got = {r.v: r.n for r in rows.select("v", word_to_num("w", True).alias("n")).collect()}
    assert all((got[str(v)] is None) == (abs(v) >= 10**38) for v in values)
    assert spark.createDataFrame([("xyz",)], "w string").select(word_to_num("w", True)).first()[0] is None
