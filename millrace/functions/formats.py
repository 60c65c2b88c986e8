"""Quantities as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(value: Column, size: Column) -> Column:
    """Two, one or no decimals, as the size is under 10, under 100 or more."""
    return F.when(size < 10, F.format_string("%.2f", value)).when(size < 100, F.format_string("%.1f", value)).otherwise(F.format_string("%.0f", value))


def count(n: Column) -> Column:
    n = n.cast("double")
    out = F.format_string("%.0f", n)
    for threshold, suffix in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        v = n / threshold
        out = F.when(F.abs(n) >= threshold, F.concat(_digits(v, F.abs(v)), F.lit(suffix))).otherwise(out)
    return out


def size(n: Column) -> Column:
    """Bytes in binary units; below zero as above, with a sign."""
    sign, n = F.when(n < 0, "-").otherwise(""), F.abs(n.cast("double"))
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        v = n / 1024.0**k
        out = F.when(n >= 1024.0**k, F.concat(_digits(v, v), F.lit(f" {unit}"))).otherwise(out)
    return F.concat(sign, out)


def whole(n: Column) -> Column:
    """To the nearest whole number (halves to the even one), with commas."""
    return F.format_number(F.rint(n.cast("double")), 0)


def parameters(n: Column) -> Column:
    n = n.cast("double")
    return F.when(n >= 1e9, F.format_string("%.2fB", n / 1e9)).when(n >= 1e6, F.format_string("%.1fM", n / 1e6)).when(n >= 1e3, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("long").cast("string"))


def duration(seconds: Column) -> Column:
    s = F.greatest(F.lit(0.0), seconds.cast("double"))
    whole = F.floor(s).cast("long")
    minutes, hours = F.floor(whole / 60), F.floor(whole / 3600)
    return (
        F.when(seconds.isNull() | F.isnan(seconds.cast("double")), F.lit("unknown"))
        .when(s == 0, F.lit("0s"))
        .when(s < 1, F.format_string("%.0fms", s * 1000))
        .when(s < 60, F.format_string("%.0fs", s))
        .when(minutes < 60, F.format_string("%dm %02ds", minutes, whole % 60))
        .when(hours < 24, F.format_string("%dh %02dm", hours, minutes % 60))
        .otherwise(F.format_string("%dd %dh", F.floor(hours / 24), hours % 24))
    )


#: The sixteen points of the compass, clockwise from north.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def compass_point(degrees: Column) -> Column:
    at = F.floor(F.pmod(degrees.cast("double"), F.lit(360.0)) / 22.5 + 0.5).cast("int") % 16
    return F.element_at(F.array(*map(F.lit, COMPASS)), at + 1)


def perplexity(loss: Column, cap: float | None = 20.0) -> Column:
    """exp of the loss; infinite where it isn't finite, or above the cap, if there is one."""
    inf = F.lit(float("inf"))
    bad = loss.isNull() | F.isnan(loss) | (loss == inf)
    return F.when(bad if cap is None else bad | (loss > cap), inf).otherwise(F.exp(loss))
