"""Column functions: clocks, tariffs, hashes, losses."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default tariff bands, as (first hour, price per kWh).
TARIFF = ((0, 0.10), (6, 0.20), (17, 0.32), (21, 0.20), (22, 0.10))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_float(c: str | Column, default: float = 0.0) -> Column:
    """The value as a finite double, or the default if it is not one."""
    x = col(c).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def finite(c: str | Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    x = col(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def hash_uniform(*parts: Column | str, seed: int | str = 0) -> Column:
    """A double in [0, 1) from the first 48 bits of SHA-256 of ``seed:part:...``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / float(2**48)


def calendar(ts: str | Column) -> dict[str, Column]:
    """Hour and day-of-week as points on a circle (Monday first), and a weekend flag."""
    t = col(ts)
    hour = F.hour(t) + F.minute(t) / 60.0
    day = F.pmod(F.dayofweek(t) + 5, F.lit(7))
    return {
        "hour_sin": F.sin(hour * (2 * pi / 24)),
        "hour_cos": F.cos(hour * (2 * pi / 24)),
        "dow_sin": F.sin(day * (2 * pi / 7)),
        "dow_cos": F.cos(day * (2 * pi / 7)),
        "is_weekend": (day >= 5).cast("int"),
    }


def slot_of_day(ts: str | Column, minutes: int = 15) -> Column:
    t = col(ts)
    return ((F.hour(t) * 60 + F.minute(t)) / minutes).cast("int")


def tariff_band(slot: str | Column, slots_per_hour: int = 4) -> Column:
    """Price of the slot's hour of the day."""
    hour = F.pmod(F.floor(col(slot) / slots_per_hour), F.lit(24))
    price = F.lit(TARIFF[0][1])
    for first, value in TARIFF[1:]:
        price = F.when(hour >= first, F.lit(value)).otherwise(price)
    return price


def slot_clock(slot: str | Column, per_hour: int = 4, style: str = "24h") -> Column:
    """``HH:MM`` of a slot, or the 12-hour clock with AM and PM."""
    s = col(slot).cast("int")
    hour = F.pmod(F.floor(s / per_hour), F.lit(24)).cast("int")
    minute = (F.pmod(s, F.lit(per_hour)) * (60 // per_hour)).cast("int")
    if style == "24h":
        return F.when(s.isNotNull(), F.format_string("%02d:%02d", hour, minute))
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("int")
    return F.when(s.isNotNull(), F.format_string("%d:%02d %s", twelve, minute, F.when(hour < 12, "AM").otherwise("PM")))


def huber(error: Column, delta: float = 1.0) -> Column:
    """Smooth L1: quadratic within delta, linear beyond."""
    a = F.abs(error)
    return F.when(a < delta, 0.5 * a * a / delta).otherwise(a - 0.5 * delta)
