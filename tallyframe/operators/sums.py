"""Sums that what was added can be taken out of again without rounding: every value is split into whole numbers (longs).

A long is one part; money is counted in cents; a decimal is its unscaled value, above 18 digits in groups of 12 digits; a double is
split into digits of 2^32 between 2^-128 and 2^254, each rounded to nearest, so that digits are small and of either sign. Parts are
summed apart, in 64 bits; a window of up to 2^31 rows can't overflow them. ``whole`` puts the sums together again: longs and
decimals exactly, doubles to within the last bit of the exact sum.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(18,2)"
#: Digits of a double: 2^(32 * k) for k from LOWEST on.
BITS, LOWEST, DIGITS = 32, -4, 12
#: Doubles from here on have no digits; they count as failures of their rule.
BEYOND = 2.0**254


def kind_of(types: list[T.DataType]) -> str:
    """The type in which values of these types are summed together: bigint, decimal(p,s) or double."""
    if any(isinstance(t, (T.DoubleType, T.FloatType, T.StringType)) for t in types):
        return "double"
    places = max((t.scale for t in types if isinstance(t, T.DecimalType)), default=0)
    if not any(isinstance(t, T.DecimalType) for t in types):
        return "bigint"
    ahead = max((t.precision - t.scale if isinstance(t, T.DecimalType) else 19) for t in types)
    return f"decimal({min(38, ahead + places)},{places})"


def _decimal(kind: str) -> tuple[int, int]:
    digits, places = kind.removeprefix("decimal(").removesuffix(")").split(",")
    return int(digits), int(places)


def _power(exponent: int) -> Column:
    return F.lit(Decimal(10**exponent)).cast(f"decimal({exponent + 1},0)")


def n_parts(kind: str) -> int:
    return DIGITS if kind == "double" else 3 if kind.startswith("decimal") and _decimal(kind)[0] > 18 else 1


def parts(value: Column, kind: str) -> list[Column]:
    """The parts of a value that has been cast to kind; null has none."""
    if kind == "double":
        inside = F.when(~F.isnan(value) & (F.abs(value) < BEYOND), value)
        whole = [F.rint(inside * 2.0 ** (-BITS * (LOWEST + k))) for k in range(DIGITS)] + [F.lit(0.0)]
        return [(whole[k] - whole[k + 1] * 2.0**BITS).cast("long") for k in range(DIGITS)]
    if kind == "bigint":
        return [value.cast("long")]
    digits, places = _decimal(kind)
    unscaled = (value * _power(places)).cast(f"decimal({digits},0)") if places else value
    if digits <= 18:
        return [unscaled.cast("long")]
    group = _power(12)
    low = unscaled % group
    rest = ((unscaled - low) / group).cast("decimal(26,0)")
    mid = rest % group
    return [low.cast("long"), mid.cast("long"), ((rest - mid) / group).cast("decimal(14,0)").cast("long")]


def whole(sums: list[Column], kind: str) -> Column:
    """The sum of values from the sums of their parts."""
    if kind == "bigint":
        return sums[0]
    if kind.startswith("decimal"):
        digits, places = _decimal(kind)
        if digits <= 18:
            return (sums[0].cast("decimal(20,0)") / _power(places)).cast(f"decimal({min(38, digits + 10)},{places})")
        wide = [s.cast("decimal(20,0)") * _power(12 * i) for i, s in enumerate(sums)]
        total = (wide[0] + wide[1] + wide[2]).cast("decimal(38,0)")
        return (total / _power(places)).cast(f"decimal(38,{places})") if places else total
    # from the highest digit down, each as two doubles without rounding; what is rounded off on the way is kept apart
    terms = [t for k in reversed(range(DIGITS)) for t in (F.shiftright(sums[k], BITS).cast("double") * 2.0 ** (BITS * (LOWEST + k + 1)), sums[k].bitwiseAND((1 << BITS) - 1).cast("double") * 2.0 ** (BITS * (LOWEST + k)))]

    def add(acc: Column, x: Column) -> Column:
        sum_ = acc["h"] + x
        part = sum_ - acc["h"]
        return F.struct(sum_.alias("h"), (acc["l"] + ((acc["h"] - (sum_ - part)) + (x - part))).alias("l"))

    return F.aggregate(F.array(*terms), F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("l")), add, lambda acc: acc["h"] + acc["l"])
