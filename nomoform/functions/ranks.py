"""Ranks and running totals over a whole table without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import staged

#: Ranges of a 32-bit draw by its upper 16 bits: of 100 billion rows each holds 1.5 million.
RANGES = 1 << 16


def global_rank(df: DataFrame, draw: Column, ties: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds rank_ (from 1) and total_, by a uniform 32-bit ``draw`` and ``ties`` within ``by``.

    Rows fall into RANGES ranges of the draw; a window ranks each range, and the
    counts of the ranges before, at most RANGES for each group, are added.
    """
    by = by or []
    ranged = df.withColumn("_draw", draw).withColumn("_range", F.shiftright("_draw", 16).cast("int"))
    counts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by)
    offsets = counts.select(
        *by, "_range",
        (F.sum("_n").over(upto.orderBy("_range")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(upto).alias("total_"),
    )
    within = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_draw", *ties))
    joined = ranged.withColumn("_in", within).join(offsets, [*by, "_range"])
    return joined.withColumn("rank_", F.col("_in") + F.col("_before")).drop("_draw", "_range", "_in", "_before")


def running_totals(df: DataFrame, order: str, sums: list[str], by: list[str] | None = None, ranges: int = 64) -> DataFrame:
    """For distinct values of ``order`` within ``by``: cum_x of each sum, itself included, and total_x.

    Ranges of ``order`` come from a bounded sketch of its values; each range has
    its own window, and the totals of the ranges before are added. Results do
    not depend on where the ranges lie. ``df`` is staged, as it is read three times.
    """
    by = by or []
    df = staged(df, "totals") if ranges > 1 else df
    bounds = sorted(set(df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.005))) if ranges > 1 else []
    number = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order))) if bounds else F.lit(0)
    ranged = df.withColumn("_range", number)
    parts = ranged.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    w = Window.partitionBy(*by)
    offsets = parts.select(
        *by, "_range",
        *[(F.sum(f"_{s}").over(w.orderBy("_range")) - F.col(f"_{s}")).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_{s}").over(w).alias(f"total_{s}") for s in sums],
    )
    inner = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"_in_{s}": F.sum(s).over(inner) for s in sums})
    joined = summed.join(offsets, [*by, "_range"])
    out = joined.withColumns({f"cum_{s}": F.col(f"_in_{s}") + F.col(f"_before_{s}") for s in sums})
    return out.drop("_range", *[f"_in_{s}" for s in sums], *[f"_before_{s}" for s in sums])


def counted_percentiles(counts: DataFrame, value: str, n: str, by: list[str], qs: dict[str, float]) -> DataFrame:
    """by and the named percentiles of ``value``, each of which stands for ``n`` rows, interpolated linearly.

    ``counts`` has one row for each ``by`` and distinct value. Running totals place
    every value in the order of the rows, so no task sees more than a range of
    the values. NaN does not count.
    """
    cum = running_totals(counts.where(~F.isnan(value)), value, [n], by)
    upto = F.col(f"cum_{n}")
    pos = {name: q * (F.col(f"total_{n}") - 1) for name, q in qs.items()}
    at = lambda rank: F.max(F.when((upto - F.col(n) <= rank) & (rank < upto), F.col(value)))
    ends = [c for name, p in pos.items() for c in (at(F.floor(p)).alias(f"_lo_{name}"), at(F.ceil(p)).alias(f"_hi_{name}"), F.max(p - F.floor(p)).alias(f"_at_{name}"))]
    between = lambda name: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_at_{name}")
    return cum.groupBy(*by).agg(*ends).select(*by, *[between(name).alias(name) for name in qs])
