"""Profiling aggregations: one pass over the table each, long results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles


def _melted(df: DataFrame, cols: list[str], keep: list[str] | None = None, kind: str = "double") -> DataFrame:
    """feature, v for each column, with the columns ``keep``."""
    return df.select(*(keep or []), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("v")) for c in cols])))


def feature_summary(df: DataFrame, cols: list[str], few: int = 15) -> DataFrame:
    """One row per numeric column: counts, mean, median, sample deviation, quartile range, extremes, levels.

    Moments need one aggregate, levels a shuffle of distinct values, and the
    order statistics bracketed passes, so no task holds all values of a column.
    """
    kinds = dict(df.dtypes)
    if text := [c for c in cols if kinds[c] in ("string", "binary", "date", "timestamp")]:
        raise TypeError(f"not numeric: {text}")
    q = exact_percentiles(df, cols, [0.25, 0.5, 0.75])
    order = df.sparkSession.createDataFrame([(c, q[c][1], None if q[c][0] is None else q[c][2] - q[c][0]) for c in cols], "feature string, median double, iqr double")
    counts = _melted(df, cols).groupBy("feature", "v").agg(F.count("*").alias("n"))
    levels = counts.groupBy("feature").agg(F.count("v").alias("levels"))
    of = lambda c: F.struct(
        F.lit(c).alias("feature"), F.count(c).alias("non_null"), F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(c).cast("double").alias("mean"),
        F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
    )
    moments = df.agg(F.array(*map(of, cols)).alias("s")).select(F.inline("s"))
    out = moments.join(F.broadcast(order), "feature").join(levels, "feature", "left")
    return out.withColumn("levels", F.coalesce("levels", F.lit(0).cast("long"))).withColumn("is_categorical", F.col("levels") < few)


def overview(df: DataFrame, cols: list[str]) -> DataFrame:
    """A first table of a study: per column n, missing and its share, and "mean (SD)" for numbers."""
    kinds = dict(df.dtypes)

    def of(c: str) -> Column:
        number = kinds[c] not in ("string", "boolean", "date", "timestamp")
        x = F.col(c).cast("double") if number else F.lit(None).cast("double")
        text = F.when(F.avg(x).isNotNull(), F.format_string("%.2f (%.2f)", F.avg(x), F.coalesce(F.stddev_samp(x), F.lit(0.0))))
        return F.struct(
            F.lit(c).alias("feature"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("missing"),
            (F.count_if(F.col(c).isNull()) / F.count("*") * 100).alias("missing_pct"), text.alias("mean_sd"),
        )

    return df.agg(F.array(*map(of, cols)).alias("s")).select(F.inline("s"))


def numeric_stats(df: DataFrame, cols: list[str], stage: str) -> DataFrame:
    """Statistics of numeric columns for a record, under the name of a ``stage`` (before or after imputation)."""
    s = feature_summary(df, cols).select("feature", "mean", "median", "std", "min", "max", F.col("nulls").alias("missing_count"), "non_null")
    pct = F.when(F.col("missing_count") + F.col("non_null") > 0, F.col("missing_count") / (F.col("missing_count") + F.col("non_null")) * 100).otherwise(0.0)
    return s.select(F.lit(stage).alias("stage"), *[c for c in s.columns if c != "non_null"], pct.alias("missing_pct"))


def category_frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of each level among the non-null values of its column."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "feature", "level").where("level is not null")
    counts = long.groupBy("feature", "level").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("feature")))


def histogram(df: DataFrame, col: str, bins: int = 20, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """bin, left, right, n: equal widths between the extremes or given ends, last bin closed, empty bins too."""
    x = df.select(F.col(col).cast("double").alias("x")).where("x is not null and not isnan(x)")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")) if lo is None else x.sparkSession.range(1).select(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    w = (F.col("hi") - F.col("lo")) / bins
    counts = (
        x.crossJoin(F.broadcast(ends)).where("x between lo and hi")
        .groupBy(F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / w), F.lit(bins - 1))).otherwise(0).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    )
    frame = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), (F.col("lo") + F.col("bin") * w).alias("left"), (F.col("lo") + (F.col("bin") + 1) * w).alias("right"))
    return frame.join(F.broadcast(counts), "bin", "left").select("bin", "left", "right", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def class_balance(df: DataFrame, split: str, y: str) -> DataFrame:
    """Counts and shares of each class, minority share and imbalance ratio, for each split."""
    n = df.groupBy(split, y).agg(F.count("*").alias("n"))
    w = Window.partitionBy(split)
    return n.select(split, y, "n", (F.col("n") / F.sum("n").over(w)).alias("share"), (F.min("n").over(w) / F.sum("n").over(w)).alias("minority_share"), (F.max("n").over(w) / F.min("n").over(w)).alias("imbalance"))


def compare_splits(df: DataFrame, split: str, cols: list[str]) -> DataFrame:
    """Share of every level of every column in each split, 0 where a split lacks it."""
    long = df.select(split, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot([split], cols, "feature", "level")
    n = long.groupBy(split, "feature", "level").agg(F.count("*").alias("n"))
    total = long.groupBy(split, "feature").agg(F.count("level").alias("total"))
    frame = n.where("level is not null").select("feature", "level").distinct().join(total, "feature")
    return frame.join(n, [split, "feature", "level"], "left").select(split, "feature", "level", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def compare_quartiles(df: DataFrame, split: str, cols: list[str], splits: list[str]) -> DataFrame:
    """split, feature, q1, median, q3 and missing share of continuous columns in each of the named splits."""
    rows = []
    for s in splits:
        part = df.where(F.col(split) == s)
        q = exact_percentiles(part, cols, [0.25, 0.5, 0.75])
        rows += [(s, c, *q[c]) for c in cols]
    table = df.sparkSession.createDataFrame(rows, f"{split} string, feature string, q1 double, median double, q3 double")
    missing = _melted(df, cols, [split]).groupBy(split, "feature").agg((F.count_if(F.col("v").isNull()) / F.count("*") * 100).alias("missing_pct"))
    return F.broadcast(table).join(missing, [split, "feature"], "left")


def missing_share(df: DataFrame, cols: list[str]) -> DataFrame:
    """feature and the percentage of its nulls."""
    long = _melted(df, cols, kind="string")
    return long.groupBy("feature").agg((F.count_if(F.col("v").isNull()) / F.count("*") * 100).alias("missing_pct"))


def histogram_within(df: DataFrame, col: str, lo: float, hi: float, most: int = 50) -> DataFrame:
    """A histogram of the values inside a grid's range; no more bins than distinct values there, ``most`` at most."""
    inside = df.where(F.col(col).between(lo, hi))
    n = inside.select(col).distinct().limit(most).count()
    return histogram(inside, col, max(1, n), float(lo), float(hi))


def id_uniqueness(df: DataFrame, col: str) -> DataFrame:
    per = df.groupBy(col).agg(F.count("*").alias("n"))
    known = F.col(col).isNotNull()
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(known).alias("distinct_ids"), F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
    ).withColumn("is_unique", F.col("distinct_ids") == F.col("rows"))


def binary_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Whether all non-null values of a column are 0 or 1."""
    return df.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.bool_and(F.col(c).isin(0, 1)).alias("is_binary")) for c in cols]).alias("s")).select(F.inline("s"))


def few_levels(df: DataFrame, cols: list[str], threshold: int = 15) -> DataFrame:
    """Levels of each column by the looser rules: ``found`` at or below the threshold, ``shown`` (summaries, grids) below it."""
    n = _melted(df, cols, kind="string").groupBy("feature", "v").agg(F.lit(1)).groupBy("feature").agg(F.count("v").alias("levels"))
    return n.withColumns({"found": F.col("levels") <= threshold, "shown": F.col("levels") < threshold})


def categorical_columns(df: DataFrame, cols: list[str], threshold: int = 10) -> DataFrame:
    """Levels of each column; strings, and integral numbers with 2 < levels < threshold, are categorical."""
    kinds = dict(df.dtypes)

    def of(c: str) -> Column:
        n = F.count_distinct(F.col(c))
        text = F.lit(kinds[c] == "string")
        whole = F.lit(True) if kinds[c] == "string" else F.bool_and(F.col(c) == F.floor(F.col(c)))
        return F.struct(F.lit(c).alias("feature"), n.alias("levels"), (text | ((n > 2) & (n < threshold) & whole)).alias("is_categorical"), F.when(n == 2, "binary").otherwise("multi").alias("kind"))

    return df.agg(F.array(*map(of, cols)).alias("s")).select(F.inline("s"))


def convert_categorical(df: DataFrame, cols: list[str], threshold: int = 10, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Fractional columns that hold whole numbers of 2 to ``threshold`` levels, both ends excluded, as integers.

    Nulls stay null; ``exclude`` and columns of other types stay as they are.
    """
    kinds = dict(df.dtypes)
    asked = [c for c in cols if c not in exclude and kinds[c] in ("double", "float")]
    if not asked:
        return df
    found = [r["feature"] for r in categorical_columns(df, asked, threshold).where("is_categorical").collect()]  # a row for each column
    return df.withColumns({c: F.col(c).cast("long") for c in found})


def range_check(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Extremes of each column against what is expected."""
    rows = [F.struct(F.lit(c).alias("feature"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for c, (a, b) in bounds.items()]
    return df.agg(F.array(*rows).alias("s")).select(F.inline("s")).withColumn("ok", (F.col("min") >= F.col("lo")) & (F.col("max") <= F.col("hi")))


def table_checksum(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows and the sum of a hash of each row: the same for any order of rows; fractions count to ten places."""
    kinds = dict(df.dtypes)
    value = lambda c: F.format_string("%.10f", F.round(c, 10) + F.lit(0.0)) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    text = F.concat_ws("|", *[F.coalesce(value(c), F.lit("null")) for c in cols])
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.sum(h).alias("checksum"))
