"""Combining tables: predictions side by side, splits on top of each other, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine_predictions(base: DataFrame, others: dict[str, DataFrame], id_: str) -> DataFrame:
    """``base`` with p of every model as p_{model}; one shuffle by id for all models, not a join each."""
    long = reduce(DataFrame.unionByName, [d.select(id_, "p", F.lit(m).alias("_m")) for m, d in others.items()])
    wide = long.groupBy(id_).agg(*[F.max(F.when(F.col("_m") == m, F.col("p"))).alias(f"p_{m}") for m in others])
    return base.join(wide, id_, "left")


#: The names of prediction columns in files of results.
PREDICTIONS = ("pred_blackbox", "pred_blackbox_nomogram", "pred_prn", "pred_prn_nomogram")


def _named(df: DataFrame, name: str) -> str | None:
    """The column of this name in any case, an exact match first."""
    return next((c for c in df.columns if c == name), next((c for c in df.columns if c.lower() == name.lower()), None))


def combine_files(files: dict[str, DataFrame], id_: str) -> DataFrame:
    """Tables of predictions side by side: the first one's other columns, and {prediction}_{model} of all.

    The id is found in any case, or else is the first table's first column; a table
    without it is left out, as are rows whose id the first one lacks. Of several rows
    with one id in a table the largest prediction counts. All tables meet in one shuffle.
    """
    first = next(iter(files.values()))
    key = _named(first, id_) or first.columns[0]
    found = {m: (d, _named(d, key)) for m, d in files.items() if _named(d, key)}
    none = lambda p: F.lit(None).cast("double").alias(p)
    picked = [
        d.select(F.col(f"`{k}`").alias("_id"), F.lit(m).alias("_m"), *[F.col(p).cast("double").alias(p) if p in d.columns else none(p) for p in PREDICTIONS]) for m, (d, k) in found.items()
    ]
    cells = [F.max(F.when(F.col("_m") == m, F.col(p))).alias(f"{p}_{m}") for m, (d, _) in found.items() for p in PREDICTIONS if p in d.columns]
    wide = reduce(DataFrame.unionByName, picked).groupBy("_id").agg(*cells)
    base = first.drop(*PREDICTIONS)
    return base.join(wide, base[f"`{key}`"] == wide["_id"], "left").drop("_id")


def concat_splits(splits: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("datasplit", F.lit(s)) for s, d in splits.items()])


def level_difference(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Levels on one side only."""
    one = a.select(col).distinct().join(b.select(col).distinct(), col, "left_anti").withColumn("side", F.lit("first"))
    return one.unionByName(b.select(col).distinct().join(a.select(col).distinct(), col, "left_anti").withColumn("side", F.lit("second")))
