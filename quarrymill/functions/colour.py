"""Colour columns: hex to channels, luminance, contrast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(hex_: Column, i: int) -> Column:
    """Channel i (0 red, 1 green, 2 blue) of #rgb or #rrggbb, 0 to 255; null if unreadable."""
    h = F.regexp_replace(hex_, "^#", "")
    six = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return F.when(six.rlike("^[0-9a-fA-F]{6}$"), F.conv(F.substring(six, 1 + 2 * i, 2), 16, 10).cast("int"))


def luminance(hex_: Column) -> Column:
    def linear(c: Column) -> Column:
        x = c / 255.0
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(channel(hex_, 0)) + 0.7152 * linear(channel(hex_, 1)) + 0.0722 * linear(channel(hex_, 2))


def contrast(a: Column, b: Column) -> Column:
    """Ratio of two colours to two decimals, halves up; what is compared with a threshold is the rounded ratio."""
    x, y = luminance(a), luminance(b)
    return F.floor((F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05) * 100 + 0.5) / 100
