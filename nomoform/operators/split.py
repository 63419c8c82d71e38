"""Train, test and validation splits that any run repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import global_rank, running_totals
from ..functions.scalars import draw


#: Spellings of split labels.
SPELLINGS = {"train": "train", "training": "train", "test": "test", "testing": "test", "val": "val", "valid": "val", "validation": "val"}


def split_random(df: DataFrame, id_: str, by: list[str] | None = None, seed: int = 42, train: float = 0.6, test: float = 0.2) -> DataFrame:
    """Adds split: exact sizes by a seeded order of ids, within each stratum if ``by`` is given.

    What is held out is rounded up, and so is its test part, as in a two-stage split.
    """
    ranked = global_rank(df, draw(F.col(id_), seed, "split"), [id_], by)
    held = F.ceil(F.round((1 - train) * F.col("total_"), 9))
    tested = F.ceil(F.round(test / (1 - train) * held, 9))
    cut = F.col("total_") - held
    split = F.when(F.col("rank_") <= cut, "train").when(F.col("rank_") <= cut + tested, "test").otherwise("val")
    return ranked.withColumn("split", split).drop("rank_", "total_")


def temporal_cuts(df: DataFrame, bin_: str, train: float = 0.6, test: float = 0.2) -> tuple[object, object]:
    """The bins whose cumulative shares come closest to the targets, the earlier of equals."""
    kind = dict(df.dtypes)[bin_]
    place = F.col(bin_).cast("timestamp").cast("double") if kind in ("date", "timestamp") else F.col(bin_).cast("double")
    bins = df.where(F.col(bin_).isNotNull()).groupBy(bin_).agg(F.count("*").alias("n")).withColumn("_at", place)
    cum = running_totals(bins, "_at", ["n"]).withColumn("share", F.col("cum_n") / F.col("total_n"))
    row = cum.agg(*[F.min(F.struct(F.abs(F.col("share") - t), F.col(bin_))).alias(a) for a, t in (("a", train), ("b", train + test))]).first()
    return (row["a"][1], row["b"][1]) if row["a"] else (None, None)


def split_temporal(df: DataFrame, bin_: str, train: float = 0.6, test: float = 0.2) -> DataFrame:
    """Whole bins of time, in order; what equals a cut goes before it. A text column is an error."""
    if dict(df.dtypes)[bin_] == "string":
        raise TypeError(f"{bin_} is text; a time or a number is needed")
    a, b = temporal_cuts(df, bin_, train, test)
    return df.withColumn("split", F.when(F.col(bin_) <= F.lit(a), "train").when(F.col(bin_) <= F.lit(b), "test").otherwise("val"))


def split_shares(df: DataFrame, train: float = 0.6, test: float = 0.2, tolerance: float = 0.1) -> DataFrame:
    """split, n, share, wanted and whether the share is more than ``tolerance`` off."""
    n = df.groupBy("split").agg(F.count("*").alias("n"))
    want = df.sparkSession.createDataFrame([("train", train), ("test", test), ("val", round(1 - train - test, 9))], "split string, wanted double")
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy())  # three rows
    out = want.join(n, "split", "left").select("split", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) / total).alias("share"), "wanted")
    return out.withColumn("off", F.abs(F.col("share") - F.col("wanted")) > tolerance)


def split_predefined(df: DataFrame, label: Column, names: dict[str, str]) -> DataFrame:
    """Splits by a label map; null labels go, unknown ones are an error, and so is an empty train or test part.

    Labels are compared without case and outer spaces; ``SPELLINGS`` adds to ``names``.
    """
    names = SPELLINGS | {k.strip().lower(): v for k, v in names.items()}
    original, label = label, F.lower(F.trim(label.cast("string")))
    found = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), label)
    checked = F.coalesce(found, F.raise_error(F.concat(F.lit("unknown split label: "), original.cast("string"))).cast("string"))
    out = df.where(label.isNotNull()).withColumn("split", checked)
    have = {r["split"] for r in out.select("split").distinct().collect()}
    if missing := {"train", "test"} - have:
        raise ValueError(f"no rows for {sorted(missing)}")
    return out


def ranges(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
