"""Rounding to decimals that looks at the exact binary value, half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2 ** 27 + 1: cuts a double into two halves whose products are exact.
_CUT = 134217729.0


def round_half_even(value: Column, digits: int) -> Column:
    """The multiple of 10 ** -digits nearest to the double ``value``; of two as near the even one, and only where that is exactly so.

    ``value * 10 ** digits`` is rounded by the machine; the error of that product,
    which is itself a double, decides where the product seems to be a half. Not
    for values whose product exceeds 2 ** 52; null, NaN and infinite values stay.
    """
    x, scale = value.cast("double"), F.lit(float(10**digits))
    product = x * scale
    high = x * _CUT - (x * _CUT - x)
    error = (high * scale - product) + (x - high) * scale
    below = F.floor(product).cast("double")
    over = product - below - 0.5
    odd = below - 2 * F.floor(below / 2) == 1
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & odd)))
    plain = F.isnan(x) | (F.abs(product) >= F.lit(float(1 << 52)))
    return F.when(plain, x).otherwise((below + F.when(up, 1.0).otherwise(0.0)) / scale)
