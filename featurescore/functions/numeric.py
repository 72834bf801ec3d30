"""Single-precision arithmetic and parsing of numbers, with the exact results of 32-bit floats."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers as text: no blanks, no type suffix, case of nan and infinity free.
NUMBER = r"(?i)\A[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)\z"
NOT_A_NUMBER = r"(?i)\A[+-]?nan\z"


def f32(x: float) -> float:
    """x rounded to 32 bits."""
    with np.errstate(over="ignore"):
        return float(np.float32(x))


def lit32(x: float) -> Column:
    return F.lit(f32(x)).cast("float")


def lits32(xs) -> Column:
    """Numbers as a literal array of 32-bit floats, parsed at once."""
    spelled = [f"{v!r}D" if math.isfinite(v) else f"double('{v}')" for v in map(f32, xs)]
    return F.expr(f"cast(array({', '.join(spelled)}) AS array<float>)")


def scaled32(x: Column, shift: float, scale: float) -> Column:
    """(x - shift) / scale in 32 bits. Spark divides floats as doubles; rounding that quotient once more gives the 32-bit quotient."""
    return ((x.cast("float") - lit32(shift)) / lit32(scale)).cast("float")


def scaled64(x: Column, shift: float, scale: float) -> Column:
    """(x - shift) / scale in 64 bits, then rounded to 32."""
    return ((x.cast("double") - F.lit(float(shift))) / F.lit(float(scale))).cast("float")


def parsed32(s: Column) -> Column:
    """The number that a text spells, rounded to 32 bits; null if it spells none."""
    return F.when(s.rlike(NOT_A_NUMBER), F.lit(float("nan")).cast("float")).when(s.rlike(NUMBER), s.try_cast("float"))


def millis(micros: Column) -> Column:
    """Microseconds as milliseconds, in 64 bits."""
    return micros.cast("double") / F.lit(1000.0)
