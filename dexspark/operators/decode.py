"""Decoding of contract logs: one column job per event, dispatched on the first topic.

A log whose topics or data do not have the shape of its event gives no row and counts as
unknown, like one with an unknown first topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dexspark.functions.wide import limbs, narrow, to_text

# The signature hashes of the events.
SWAP = "0xc42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67"
MINT = "0x7a53080ba414158be7ec69b987b5fb7d07dee101fe85488f0853ae16239d0bde"
BURN = "0x0c396cd989a39f4459b5fa1aed6a9a8dcdbc45908acfd67e028cd568da98982c"
COLLECT = "0x70935338e69775456a85ddef226c395fb668b63fa0115f5f20610b388e6ca9c0"
POOL_CREATED = "0x783cca1c0412dd0d695e784568c96da2e9c22ff989357a2e8b1d9b2b4e6b7118"

#: Topics and 32-byte data words of each event.
SHAPES = {SWAP: (3, 5), MINT: (4, 4), BURN: (4, 3), COLLECT: (4, 3), POOL_CREATED: (4, 2)}


def well_formed(signature: str) -> Column:
    topics, words = SHAPES[signature]
    fine = F.forall("topics", lambda t: t.rlike("^0x[0-9a-f]{64}$"))
    return (F.get("topics", F.lit(0)) == signature) & (F.size("topics") == topics) & fine & F.col("data").rlike(f"^0x[0-9a-f]{{{64 * words}}}$")


def _event(raw_logs: DataFrame, signature: str) -> DataFrame:
    """Rows of one event with their topics and data words as t1.., w0.. of 64 digits."""
    topics, words = SHAPES[signature]
    rows = raw_logs.filter(well_formed(signature))
    cut = {f"t{k}": F.substring(F.get("topics", F.lit(k)), 3, 64) for k in range(1, topics)}
    cut |= {f"w{k}": F.substring("data", 3 + 64 * k, 64) for k in range(words)}
    return rows.withColumns(cut)


def address(word: str) -> Column:
    return F.concat(F.lit("0x"), F.substring(word, 25, 40))


def integer(word: str) -> Column:
    """Small signed integer (up to 32 bits) at the end of a word."""
    low = F.conv(F.substring(word, 57, 8), 16, 10).cast("long")
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def with_numbers(rows: DataFrame, signed: dict[str, bool]) -> DataFrame:
    """Words as limbs, in columns of their own so that they are computed once."""
    return rows.withColumns({f"n{w[1:]}": limbs(w, s) for w, s in signed.items()})


def number(column: str) -> Column:
    """DECIMAL(38,0), null for numbers that need more digits."""
    return narrow(F.col(column))


def exact(column: str) -> Column:
    return to_text(F.col(column))


def place() -> list[Column]:
    return [F.col("block_number"), F.col("tx_hash"), F.col("log_index"), F.col("address").alias("pool")]


def decode_swaps(raw_logs: DataFrame) -> DataFrame:
    """Swaps with amounts as decimals and, exact at any size, as text."""
    words = {"w0": True, "w1": True, "w2": False, "w3": False}
    return with_numbers(_event(raw_logs, SWAP), words).select(
        *place(),
        address("t1").alias("sender"),
        address("t2").alias("recipient"),
        number("n0").alias("amount0"),
        number("n1").alias("amount1"),
        exact("n0").alias("amount0_text"),
        exact("n1").alias("amount1_text"),
        exact("n2").alias("sqrt_price_x96"),
        exact("n3").alias("liquidity"),
        integer("w4").alias("tick"),
    )


def _liquidity(rows: DataFrame, kind: str, owner: str, low: str, high: str, amount: Column, amount0: Column, amount1: Column) -> DataFrame:
    return rows.select(
        *place(),
        F.lit(kind).alias("kind"),
        address(owner).alias("owner"),
        integer(low).alias("tick_lower"),
        integer(high).alias("tick_upper"),
        amount.alias("amount"),
        amount0.alias("amount0"),
        amount1.alias("amount1"),
    )


def decode_mints(raw_logs: DataFrame) -> DataFrame:
    """The sender leads the data of a mint."""
    return _liquidity(with_numbers(_event(raw_logs, MINT), {"w1": False, "w2": False, "w3": False}), "mint", "t1", "t2", "t3", number("n1"), number("n2"), number("n3"))


def decode_burns(raw_logs: DataFrame) -> DataFrame:
    return _liquidity(with_numbers(_event(raw_logs, BURN), {"w0": False, "w1": False, "w2": False}), "burn", "t1", "t2", "t3", number("n0"), number("n1"), number("n2"))


def decode_collects(raw_logs: DataFrame) -> DataFrame:
    """The recipient leads the data; a collect moves no liquidity."""
    return _liquidity(with_numbers(_event(raw_logs, COLLECT), {"w1": False, "w2": False}), "collect", "t1", "t2", "t3", F.lit(0).cast("decimal(38,0)"), number("n1"), number("n2"))


def liq_events(raw_logs: DataFrame) -> DataFrame:
    return decode_mints(raw_logs).unionByName(decode_burns(raw_logs)).unionByName(decode_collects(raw_logs))


def decode_pool_created(raw_logs: DataFrame) -> DataFrame:
    return _event(raw_logs, POOL_CREATED).select(
        "block_number", "tx_hash", "log_index", F.col("address").alias("factory"), address("w1").alias("address"), address("t1").alias("token0"), address("t2").alias("token1"), integer("t3").alias("fee"), integer("w0").alias("tick_spacing")
    )


def outcome(watched: DataFrame | None = None) -> Column:
    liq = well_formed(MINT) | well_formed(BURN) | well_formed(COLLECT)
    fine = {"swap": well_formed(SWAP), "liq": liq, "ignored": well_formed(POOL_CREATED)}
    out = F.lit("unknown")
    for name, test in reversed(fine.items()):
        out = F.when(F.coalesce(test, F.lit(False)), name).otherwise(out)
    return out


def watched_logs(raw_logs: DataFrame, watched: DataFrame) -> DataFrame:
    """Logs of the watched contracts (address)."""
    return raw_logs.join(watched.select("address"), "address", "left_semi")


def classify_logs(raw_logs: DataFrame, watched: DataFrame | None = None) -> DataFrame:
    """(address, outcome, logs): counts of swap, liq, ignored and unknown logs per contract."""
    rows = raw_logs if watched is None else watched_logs(raw_logs, watched)
    return rows.groupBy("address", outcome().alias("outcome")).agg(F.count("*").alias("logs"))
