"""Decimal helpers: two places, HALF_UP, after every step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
TENURE = "decimal(10,4)"
RATE = "decimal(5,2)"


def dec(text: str, kind: str = MONEY) -> Column:
    return F.lit(text).cast(kind)


def half_up(value: Column) -> Column:
    """Round a decimal to the cent; Spark's ``round`` is HALF_UP on decimals."""
    return F.round(value, 2).try_cast(MONEY)


def money(value: Column | str) -> Column:
    """Any number or text as money; unreadable values become null."""
    column = F.col(value) if isinstance(value, str) else value
    return half_up(column.try_cast("decimal(38,10)"))


def percent_of(amount: Column, rate: Column | str) -> Column:
    """``rate`` percent of ``amount``, rounded to the cent."""
    rate = dec(rate, RATE) if isinstance(rate, str) else rate
    return half_up(amount * rate / F.lit(100))


def thousands(value: Column) -> Column:
    """``1234.5`` as ``1,234.50``."""
    return F.format_number(value, 2)


def plain(value: Column, places: int = 2) -> Column:
    """Fixed number of places without separators."""
    return F.round(value, places).try_cast(f"decimal(38,{places})").cast("string")


def at_most(value: Column, cap: Column) -> Column:
    """The smaller of both; unlike ``least`` a null value stays null."""
    return F.when(value > cap, cap).otherwise(value)


def at_least(value: Column, floor: Column) -> Column:
    """The larger of both; unlike ``greatest`` a null value stays null."""
    return F.when(value < floor, floor).otherwise(value)
