"""Typing and imputation. Fitted values come from one aggregate; transforms are column expressions."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles
from ..functions.scalars import draw
from ..functions.storage import staged, staged_path

#: Texts that stand for a missing value.
EMPTY_TOKENS = ("", " ", "NA", "N/A", "none", "None", "null", "NULL", "?")
TRUE_FALSE = {"true": 1, "1": 1, "false": 0, "0": 0}


def empty_to_null(c: Column) -> Column:
    return F.when(~c.isin(*EMPTY_TOKENS), c)


def number_if_any(df: DataFrame, col: str) -> DataFrame:
    """A string column as numbers if any of its values looks like one; what does not parse is null."""
    x = empty_to_null(F.col(col))
    any_number = df.agg(F.bool_or(x.rlike(r"^[-+]?[0-9]*\.?[0-9]+$"))).first()[0]
    return df.withColumn(col, F.expr(f"try_cast({col} as double)") if any_number else x)


def binary_target(df: DataFrame, col: str, out: str = "target") -> DataFrame:
    """Two distinct values as 0 and 1: known words by meaning, others in sorted order; nulls stay.

    A column with another number of distinct values stays as it is, with a warning.
    """
    two = [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().limit(3).collect()]
    if len(two) != 2:
        warnings.warn(f"{col} has {'no' if not two else 'one' if len(two) == 1 else 'more than two'} distinct value(s)", stacklevel=2)
        return df.withColumn(out, F.col(col))
    if {str(x).lower() for x in two} in ({"true", "false"}, {"0", "1"}):
        s = F.lower(F.col(col).cast("string"))
        value = F.element_at(F.create_map(*[F.lit(x) for kv in TRUE_FALSE.items() for x in kv]), s)
    else:
        lo, hi = sorted(two)
        value = F.when(F.col(col) == lo, 0).when(F.col(col) == hi, 1)
    return df.withColumn(out, value)


def invert_target(y: Column) -> Column:
    return 1 - y


@dataclass(frozen=True)
class Imputer:
    """Values fitted on one table that replace nulls in any table."""

    values: dict[str, object]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items()})

    def record(self, df: DataFrame, method: str) -> DataFrame:
        return df.sparkSession.createDataFrame([(c, method, str(v)) for c, v in self.values.items()], "feature string, method string, value string")


def fit_zeros(cols: list[str]) -> Imputer:
    return Imputer({c: 0.0 for c in cols})


def fit_median(train: DataFrame, cols: list[str]) -> Imputer:
    """The exact median of each column; a column without values has none and stays null."""
    return Imputer({c: m for c, (m,) in exact_percentiles(train, cols, [0.5]).items()})


def fit_mode(train: DataFrame, cols: list[str]) -> Imputer:
    """The most frequent value; the smallest of equally frequent ones."""
    best = {}
    for c in cols:
        top = train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        best[c] = top[0] if top else None
    return Imputer(best)


#: Distinct donor values up to which the intervals of all are broadcast, and positions in a block beyond that.
MAX_BROADCAST, BLOCK = 10_000, 1 << 10


@dataclass(frozen=True)
class Donors:
    """The values of a column with the positions they cover among all donors, as a table in the shared folder."""

    path: str
    total: int
    few: bool

    def transform(self, df: DataFrame, col: str, id_: str, seed: int = 42) -> DataFrame:
        """Nulls of ``col`` take the value at a position drawn by id; without donors they stay."""
        if not self.total:
            return df
        intervals = df.sparkSession.read.parquet(self.path)
        number = draw(F.col(id_), seed, col)
        if self.total > 1 << 32:  # one draw of 32 bits would not reach the last donors
            number = number * (1 << 31) + F.shiftright(draw(F.col(id_), seed, f"{col}:low"), 1)
        drawn = df.withColumn("_at", F.when(F.col(col).isNull(), number % self.total))
        covers = (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))
        if self.few:
            hit = drawn.join(F.broadcast(intervals), covers, "left")
        else:
            block = lambda c: F.floor(F.col(c) / BLOCK)
            touched = intervals.withColumn("_block", F.explode(F.sequence(block("_lo"), F.floor((F.col("_hi") - 1) / BLOCK))))
            missing = drawn.where("_at is not null").withColumn("_block", block("_at")).join(touched, "_block")
            hit = missing.where(covers).drop("_block", "_lo", "_hi").unionByName(drawn.where("_at is null"), allowMissingColumns=True)
        return hit.withColumn(col, F.coalesce(F.col(col), F.col("_v"))).select(df.columns)


def fit_random(donors: DataFrame, col: str) -> Donors:
    """Donors counted by value and placed in the order of values.

    The intervals of a few values will be broadcast; those of many are ranked by
    ranges of values, and meet rows by the blocks of positions that they touch.
    """
    seen = donors.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    placed = staged(seen.repartitionByRange("_v").withColumn("_part", F.spark_partition_id()), "donor-values")
    parts = placed.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    before = parts.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))  # a row for each range
    within = F.sum("_n").over(Window.partitionBy("_part").orderBy("_v"))
    intervals = placed.withColumn("_hi", within).join(F.broadcast(before), "_part").withColumn("_hi", F.col("_hi") + F.col("_before"))
    path = staged_path(intervals.select("_v", "_hi", (F.col("_hi") - F.col("_n")).alias("_lo")), "donor-intervals")
    total, values = placed.agg(F.sum("_n"), F.count("*")).first()
    return Donors(path, total or 0, values <= MAX_BROADCAST)


def impute_random(df: DataFrame, donors: DataFrame, col: str, id_: str, seed: int = 42) -> DataFrame:
    """Nulls of ``col`` take a value of ``donors`` drawn by id, as likely as it is frequent there."""
    return fit_random(donors, col).transform(df, col, id_, seed)
