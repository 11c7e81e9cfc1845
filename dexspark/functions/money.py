"""Exact money: a whole number of raw units times a price, in fixed point, rounded once.

A raw amount may have 38 digits and a price 38 with 18 places, so their product passes a decimal.
Where it fits it is taken at once. Else both are cut into limbs of 19 digits, whose products fit; limbs are carried, and the product is divided by a
power of ten by its digits, half up.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type of prices, places of a price and of money, digits of a limb.
PRICE, PLACES, MONEY, LIMB = "decimal(38,18)", 18, 8, 19
WIDE = "decimal(38,0)"
#: Products below this fit when they are doubled, and powers of ten up to this one.
FAST, TOP = 4.0e37, 37


def _power(n: int) -> Column:
    return F.lit(Decimal(10**n)).cast(WIDE)


def _whole(x: Column, by: Column) -> Column:
    """x div by, exact for wide numbers that are not negative."""
    return ((x - x % by) / by).cast(WIDE)


def _limbs(x: Column) -> tuple[Column, Column]:
    """Low and high 19 digits of a number of 38."""
    base = _power(LIMB)
    return (x % base).cast("decimal(19,0)"), _whole(x, base).cast("decimal(19,0)")


def value_exact(raw: Column, decimals: Column, price: Column) -> Column:
    """raw / 10^decimals * price as decimal(30,8), rounded half up; raw is 0 or more, decimals at most 38.

    Null where an input is; a value of over 21 digits before the point is an error.
    """
    price = price.cast(PRICE)
    before = F.floor(price).cast("decimal(20,0)")
    behind = ((price % F.lit(1)).cast("decimal(18,18)") * F.lit(Decimal(10**PLACES)).cast("decimal(19,0)")).cast("decimal(18,0)")
    whole = (before * F.lit(Decimal(10**PLACES)).cast("decimal(19,0)") + behind).cast(WIDE)
    units = _units(raw.cast(WIDE), F.lit(PLACES - MONEY) + decimals.cast("int"), whole)
    return (units.cast("decimal(29,0)") * F.lit(Decimal("0.00000001")).cast("decimal(8,8)")).cast("decimal(30,8)")


def _units(raw: Column, places: Column, price: Column) -> Column:
    """raw * price / 10^places as a whole number, half up; places from 10 to 48."""
    by = F.element_at(F.array(*[_power(n) for n in range(TOP + 1)]), F.least(places, F.lit(TOP)) + 1)
    twice = (by * F.lit(2).cast("decimal(1,0)")).cast(WIDE)
    double = ((raw * price).cast(WIDE) * F.lit(2).cast("decimal(1,0)") + by).cast(WIDE)
    small = (raw >= 0) & (price >= 0) & (raw.cast("double") * price.cast("double") < FAST) & (places <= TOP)
    given = raw.isNotNull() & price.isNotNull() & places.isNotNull()
    return F.when(small, _whole(double, twice)).when(given, _long_units(raw, places, price))


def _long_units(raw: Column, places: Column, price: Column) -> Column:
    """The same for numbers of any length, by limbs."""
    # a limb of the product with what the one below it carries, from the low one on
    ready = F.struct(raw.alias("r"), price.alias("p"), places.alias("n"))

    def work(s: Column) -> Column:
        (a0, a1), (b0, b1) = _limbs(s["r"]), _limbs(s["p"])
        base = _power(LIMB)
        low = (a0 * b0).cast(WIDE)
        # two cross products could pass 38 digits together: their own limbs are added
        cross = [(a0 * b1).cast(WIDE), (a1 * b0).cast(WIDE)]
        first = (_whole(low, base) + cross[0] % base + cross[1] % base).cast(WIDE)
        second = (_whole(first, base) + _whole(cross[0], base) + _whole(cross[1], base) + (a1 * b1).cast(WIDE) % base).cast(WIDE)
        third = (_whole(second, base) + _whole((a1 * b1).cast(WIDE), base)).cast(WIDE)
        return F.struct((low % base).alias("l0"), (first % base).alias("l1"), (second % base).alias("l2"), third.alias("l3"), s["n"].alias("n"))

    def shift(s: Column) -> Column:
        """Digits of the limbs in a row, cut ``n`` from the right, plus 1 if the first one cut is 5 or more."""
        text = F.concat(*[F.lpad(s[f"l{k}"].cast("string"), LIMB, "0") for k in (3, 2, 1, 0)])
        kept = F.substring(text, F.lit(1), F.lit(4 * LIMB) - s["n"])
        half = F.substring(text, F.lit(4 * LIMB + 1) - s["n"], F.lit(1)) >= "5"
        return (kept.cast(WIDE) + half.cast("int")).cast(WIDE)

    return F.get(F.transform(F.transform(F.array(ready), work), shift), F.lit(0))
