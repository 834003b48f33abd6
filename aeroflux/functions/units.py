"""Units, rates and stack parameters as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kilograms in one of each input unit; the fixed lengths of a day and of a year for rates.
KILOGRAMS = {"ton": 907.185, "tonne": 1000.0, "kg": 1.0, "g": 0.001, "lb": 0.45359237}
SECONDS_PER_DAY, SECONDS_PER_YEAR = 86400.0, 31536000.0
FOOT = 0.3048


def to_kg(unit: str, monthly: bool = False, compat: bool = False) -> float:
    """Factor from an input unit to kg. Monthly files state yearly amounts, so their values count a twelfth.

    ``compat`` keeps the historic error of dividing tonnes by 1,000.
    """
    factor = 0.001 if compat and unit == "tonne" else KILOGRAMS[unit]
    return factor / 12 if monthly else factor


def annual_rate(annual: Column, average_day: Column, factor: float | Column) -> Column:
    """kg/s of a yearly amount; where there is none, of an average day."""
    factor = F.lit(factor) if isinstance(factor, float) else factor
    return F.when((annual <= 0) & (average_day >= 0), average_day * factor / SECONDS_PER_DAY).otherwise(annual * factor / SECONDS_PER_YEAR)


def seconds_between(begin: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("SECOND", begin, end).cast("double")


def period_rate(amount: Column, begin: Column, end: Column, factor: float | Column) -> Column:
    """kg/s of an amount for the interval."""
    factor = F.lit(factor) if isinstance(factor, float) else factor
    return amount * factor / seconds_between(begin, end)


def circle_area(diameter: Column) -> Column:
    return diameter * diameter * F.lit(math.pi / 4)


def stack(height: Column, diameter: Column, temperature: Column, flow: Column, velocity: Column) -> dict[str, Column]:
    """SI values of a stack given in feet, degrees Fahrenheit and seconds; flow and velocity repair each other."""
    d = diameter * FOOT
    q, v, area = flow * FOOT**3, velocity * FOOT, circle_area(d)
    return {
        "height_m": height * FOOT,
        "diam_m": d,
        "temp_k": (temperature + 459.67) * 5 / 9,
        "flow_m3s": F.when((v != 0) & (q == 0), v * area).otherwise(q),
        "vel_ms": F.when((v == 0) & (q != 0) & (d != 0), q / F.nullif(area, F.lit(0.0))).otherwise(v),
    }


def ground_level(height: Column, velocity: Column) -> Column:
    return (height == 0) & (velocity == 0)
