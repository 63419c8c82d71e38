"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-7


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded, and never a negative zero, so that results compare across engines."""
    return F.round(c, places) + F.lit(0.0)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def stable_logit(p: Column) -> Column:
    """Log-odds of a probability kept within [EPS, 1 - EPS]."""
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.ln(q / (1 - q))


def draw(id_: Column, seed: int, tag: str) -> Column:
    """A reproducible 32-bit number of a row: the only source of randomness."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", id_.cast("string"), F.lit(str(seed)), F.lit(tag))), 1, 8), 16, 10).cast("long")
