"""How figures are shown, and stored: fixed decimals, JSON maps, variable-length integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(number: Column, decimals: int) -> Column:
    """A number with so many decimals."""
    return F.format_string(f"%.{decimals}f", number.cast("double"))


def as_json(*columns: Column) -> Column:
    """An object of the columns, as a JSON string."""
    return F.to_json(F.struct(*columns))


def of_json(text: Column, ddl: str) -> Column:
    return F.from_json(text, ddl)


def varint_size(number: Column) -> Column:
    """Bytes that a number from 0 takes, seven bits in each."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(number < F.lit(1 << 7 * n), n).otherwise(out)
    return out
