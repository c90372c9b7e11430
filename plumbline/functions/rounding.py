"""Rounding and ratio expressions used for every reported number.

They take SQL text, a column name or an expression, and build one Spark SQL expression from it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beyond 2^52 scaled units a double has no digits left to round.
_EXACT = "4503599627370496D"
# Multiplier that splits a double into two halves of at most 27 bits.
_SPLIT = "134217729D"


def rnd(x: str, digits: int) -> Column:
    """Round a double to ``digits`` decimals as Python's ``round`` does: by its exact binary value, ties to even.

    Spark's ``round`` works on the printed decimal and gives 1.01 for 1.005, which is really a little less. Here the
    distance from the midpoint between the two candidates is computed without error, by splitting ``x`` in two halves
    whose products with the scale are exact. Adding 0 turns a negative zero into zero.
    """
    x = f"double({x})"
    scale, twice = f"{10**digits}D", f"{2 * 10**digits}D"
    below = f"double(floor({x} * {scale}))"
    high = f"({x} * {_SPLIT} - ({x} * {_SPLIT} - {x}))"
    past = f"(({high} * {twice} - ({below} * 2D + 1D)) + ({x} - {high}) * {twice})"
    up = f"if({past} > 0 OR ({past} = 0 AND pmod({below}, 2D) = 1D), 1D, 0D)"
    return F.expr(f"if(abs({x}) * {scale} < {_EXACT}, ({below} + {up}) / {scale} + 0D, {x})")


def ratio(part: str, whole: str) -> str:
    """SQL for ``part / whole`` as a double; 0.0 when the whole is zero."""
    return f"coalesce(try_divide(double({part}), double({whole})), 0D)"


def percent(part: str, whole: str, digits: int = 2) -> Column:
    """Share of the whole in percent, rounded; 0.0 when the whole is zero."""
    return rnd(f"{ratio(part, whole)} * 100D", digits)
