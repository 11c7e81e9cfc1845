"""256-bit words as exact numbers.

A number is three limbs of 26 decimal digits, low, mid and high, all of one sign. A word is the
sum of eight 32-bit groups times powers of 2^32; the powers are split into limbs beforehand, so
each limb is a sum of eight products inside DECIMAL(38,0), with one carry at the end. Carries use
``div``, since a rounded quotient would be off near a border.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = 10**26
LIMB = f"cast('{BASE}' as decimal(27,0))"


def limbs(word: str, signed: bool) -> Column:
    """struct<low, mid, high> of a column of 64 hex digits; null for other text.

    Keep it as a column of its own before taking it apart: its text is long.
    """
    negative = f"substring({word}, 1, 1) >= '8'" if signed else "false"
    digits = f"if({negative}, translate({word}, '0123456789abcdef', 'fedcba9876543210'), {word})" if signed else word
    groups = [f"cast(conv(substring({digits}, {1 + 8 * k}, 8), 16, 10) as decimal(10,0))" for k in range(8)]

    def part(place: int) -> str:
        products = []
        for k, group in enumerate(groups):
            power = (1 << 32 * (7 - k)) // BASE**place % BASE
            if power:
                products.append(f"{group} * cast('{power}' as decimal(26,0))")
        return f"cast({' + '.join(products)} as decimal(38,0))"

    # an inverted negative u stands for -(u + 1)
    sums = f"named_struct('l', cast({part(0)} + {f'if({negative}, 1, 0)' if signed else '0'} as decimal(38,0)), 'm', {part(1)}, 'h', {part(2)})"
    sign = f"if({negative}, -1, 1)" if signed else "1"
    carried = (
        f"transform(array({sums}), s -> named_struct('l', s.l, 'm', cast(s.m + cast(s.l div {LIMB} as decimal(20,0)) as decimal(38,0)), 'h', s.h))",
        f"""named_struct(
            'low', cast((s.l % {LIMB}) * {sign} as decimal(38,0)),
            'mid', cast((s.m % {LIMB}) * {sign} as decimal(38,0)),
            'high', cast((s.h + cast(s.m div {LIMB} as decimal(20,0))) * {sign} as decimal(38,0)))""",
    )
    # most words hold a long
    last = f"substring({word}, 49, 16)"
    short = [f"when {word} rlike '^0{{48}}[0-7][0-9a-f]{{15}}$' then {_of_long(f'conv({last}, 16, 10)')}"]
    if signed:
        short.append(f"when {word} rlike '^f{{48}}[89a-f][0-9a-f]{{15}}$' then {_of_long(f'conv({last}, 16, -10)')}")
    return F.expr(f"case {' '.join(short)} when {word} rlike '^[0-9a-f]{{64}}$' then transform({carried[0]}, s -> {carried[1]})[0] end")


def _of_long(text: str) -> str:
    zero = "cast(0 as decimal(38,0))"
    return f"named_struct('low', cast({text} as decimal(38,0)), 'mid', {zero}, 'high', {zero})"


def narrow(number: Column) -> Column:
    """DECIMAL(38,0) of limbs, null where it does not fit."""
    low, mid, high = (number.getField(k) for k in ("low", "mid", "high"))
    fits = (high == 0) & (F.abs(mid) < F.lit(10**12))
    return F.when(fits, (mid.cast("decimal(12,0)") * F.expr(LIMB)).cast("decimal(38,0)") + low).cast("decimal(38,0)")


def to_text(number: Column) -> Column:
    """Decimal digits of limbs."""
    low, mid, high = (number.getField(k) for k in ("low", "mid", "high"))
    sign = F.when((low < 0) | (mid < 0) | (high < 0), "-").otherwise("")

    def digits(limb: Column) -> Column:
        return F.lpad(F.abs(limb).cast("string"), 26, "0")

    plain = F.ltrim(F.concat(F.abs(high).cast("string"), digits(mid), digits(low)), F.lit("0"))
    return F.when(number.isNull(), F.lit(None)).otherwise(F.concat(sign, F.when(plain == "", "0").otherwise(plain)))


def word_to_num(word: str, signed: bool) -> Column:
    return narrow(limbs(word, signed))


def magnitude(number: Column) -> Column:
    """Limbs without their sign."""
    return F.struct(*[F.abs(number.getField(k)).cast("decimal(38,0)").alias(k) for k in ("low", "mid", "high")])


def total(number: Column) -> Column:
    """Aggregate: the sum of limbs, exact for up to 10^12 numbers of one sign; see ``carried``."""
    return F.struct(*[F.sum(number.getField(k)).cast("decimal(38,0)").alias(k) for k in ("low", "mid", "high")])


def carried(number: Column) -> Column:
    """Limbs of 26 digits again, from sums of limbs of one sign."""
    low, mid, high = (number.getField(k) for k in ("low", "mid", "high"))
    base = F.expr(LIMB)

    def whole(x: Column) -> Column:
        return ((x - x % base) / base).cast("decimal(20,0)")

    middle = (mid + whole(low)).cast("decimal(38,0)")
    return F.struct((low % base).cast("decimal(38,0)").alias("low"), (middle % base).cast("decimal(38,0)").alias("mid"), (high + whole(middle)).cast("decimal(38,0)").alias("high"))
