"""What keeps large runs within time and disk: rows are made once, shuffles go, and shortcuts of arithmetic equal the long way."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dexspark.functions.money import value_exact
from dexspark.operators.fifo import share
from dexspark.plans import registry


@pytest.mark.parametrize("name", ["scorecards_wide", "pnl_end_to_end", "blocks_with_all_logs"])
def test_trades_are_made_once(spark, sf, name):
    """The branches of the query read trades that are there, not the tables each."""
    read = registry.queries()[name](spark, sf).inputFiles()
    assert read and not [f for f in read if "lineitem" in f]


def test_shares_around_the_shortcut(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        part = rng.randrange(1, 10**6)
        value = 4 * 10**12 // part + rng.randrange(-2, 3)
        rows.append((value, part, part + rng.randrange(10)))
    frame = spark.createDataFrame(rows, "v long, p long, w long")
    assert [r[0] for r in frame.select(share(F.col("v"), F.col("p"), F.col("w"), "long")).collect()] == [(2 * v * p * 10**6 + w) // (2 * w) for v, p, w in rows]
    wide = [(v, Decimal(p) * 10**19, Decimal(w) * 10**19) for v, p, w in rows]
    frame = spark.createDataFrame(wide, "v long, p decimal(38,0), w decimal(38,0)")
    assert [r[0] for r in frame.select(share(F.col("v"), F.col("p"), F.col("w"), "decimal(38,0)")).collect()] == [(2 * v * p * 10**6 + w) // (2 * w) for v, p, w in rows]


def test_values_around_the_shortcut(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        price, decimals = rng.randrange(1, 10**19), rng.choice([6, 18, 27, 28])
        raw = 4 * 10**37 // price + rng.randrange(-10**9, 10**9)
        rows.append((raw, decimals, price))
    frame = spark.createDataFrame([(Decimal(r), d, Decimal(p).scaleb(-18)) for r, d, p in rows], "raw decimal(38,0), d int, price decimal(38,18)")
    got = [int(r[0].scaleb(8)) for r in frame.select(value_exact(F.col("raw"), F.col("d"), F.col("price"))).collect()]
    assert got == [(2 * r * p + 10 ** (d + 10)) // (2 * 10 ** (d + 10)) for r, d, p in rows]


def test_a_book_keeps_nothing_of_a_batch_but_its_tables(spark, tmp_path):
    """Staged rows go, a repeated batch changes nothing, and with an upkeep of 1 so does what a commit replaced."""
    from dexspark.sources.shared import TIDY
    from dexspark.streaming.book import Book
    from tests.test_book import assert_equals_clean, blocks, table

    before = spark.conf.get(TIDY, "false")
    book = Book(spark, f"file://{tmp_path}/b", blocks=10, parts=1, unit="year", upkeep=1, keep=1)
    book.apply(table(spark, blocks(1, 3)), 0)
    book.apply(table(spark, blocks(3, 5)), 1)
    assert_equals_clean(spark, book, blocks(1, 5))
    for name in ("swaps", "trades", "lots", "1m"):
        assert len(list((tmp_path / "b" / name).glob("v*"))) == 1, name
    assert not list((tmp_path / "b").glob("stage/*")) and spark.conf.get(TIDY) == before
    assert not spark.sparkContext._jsc.getPersistentRDDs()
