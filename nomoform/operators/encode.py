"""Encodings and scaling. A category stays one column; dummies appear only when asked for."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles

#: Words in a level that make it the first, or the second, of two.
FIRST_WORDS = ("no", "none", "false", "0", "absent", "negative", "bad", "low", "n")
SECOND_WORDS = ("yes", "true", "1", "present", "positive", "good", "high", "y")


#: Levels of a category, at most; a column with more is no category but text or an id.
MAX_LEVELS = 100_000


def levels(df: DataFrame, col: str) -> list[str]:
    """The sorted levels of a column; more than MAX_LEVELS of them are an error."""
    found = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()]
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{col} has more than {MAX_LEVELS} levels")
    return sorted(found)


def order_binary(two: list[str]) -> list[str]:
    """Order two levels so that the one that reads as negative comes first."""
    for words, first in ((FIRST_WORDS, True), (SECOND_WORDS, False)):
        for word in words:
            for x in two:
                if word in x.lower():
                    other = next((y for y in two if y != x), x)
                    return [x, other] if first else [other, x]
    return two


def ordinal(c: Column, order: list[str]) -> Column:
    """Position in ``order``; null if unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)]), c)


def with_unlisted(order: list[str], seen: list[str]) -> list[str]:
    return [*order, *sorted(set(seen) - set(order))]


def one_hot(df: DataFrame, col: str, of: list[str]) -> DataFrame:
    return df.withColumns({f"{col}_{v}": F.coalesce(F.col(col) == v, F.lit(False)).cast("int") for v in of}).drop(col)


def reference_level(df: DataFrame, cols: list[str], how: str = "alphabetical", chosen: dict[str, str] | None = None) -> DataFrame:
    """feature, level, code, is_reference: the reference has code 0, the others follow in sorted order.

    The reference is the first level, the most common one, or the one that
    ``chosen`` names; a name that is no level is an error.
    """
    n = _level_counts(df, cols)
    w = Window.partitionBy("feature")
    by_hand = F.lit(None).cast("string")
    for c, level in (chosen or {}).items():
        if level not in levels(df.select(F.col(c).cast("string").alias(c)), c):
            raise ValueError(f"{level} is no level of {c}")
        by_hand = F.when(F.col("feature") == c, F.lit(level)).otherwise(by_hand)
    order = [F.desc(F.coalesce(F.col("level") == by_hand, F.lit(False))), *([F.desc("n")] if how == "most_common" else []), "level"]
    marked = n.withColumn("is_reference", F.row_number().over(w.orderBy(*order)) == 1)
    code = F.when(F.col("is_reference"), 0).otherwise(F.sum((~F.col("is_reference")).cast("int")).over(w.orderBy("level")))
    return marked.select("feature", "level", code.cast("int").alias("code"), "is_reference")


def _level_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "feature", "level").where("level is not null")
    return long.groupBy("feature", "level").agg(F.count("*").alias("n"))


def level_orders(df: DataFrame, cols: list[str], how: str = "alphabetical") -> DataFrame:
    """feature, level, rank from 0: two levels by their meaning, more by the alphabet or by falling frequency."""
    n = _level_counts(df, cols)
    w = Window.partitionBy("feature")
    ranked = n.withColumn("k", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(*([F.desc("n")] if how == "frequency" else []), "level")) - 1)
    pairs = ranked.where("k = 2").groupBy("feature").agg(F.sort_array(F.collect_list("level")).alias("two")).collect()  # one row per column
    rank = F.col("rank")
    for r in pairs:
        for i, level in enumerate(order_binary(r["two"])):
            rank = F.when((F.col("feature") == r["feature"]) & (F.col("level") == level), i).otherwise(rank)
    return ranked.select("feature", "level", rank.cast("int").alias("rank"))


def encode_binary(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Columns with exactly two levels as 0 and 1, and the order of the levels of each."""
    orders = {}
    for c in cols:
        two = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(3).collect()]
        if len(two) == 2:
            orders[c] = order_binary(sorted(two))
    return df.withColumns({c: ordinal(F.col(c), o) for c, o in orders.items()}), orders


def decode(code: Column, order: list[str]) -> Column:
    """The level of a code; null if there is none."""
    return F.when((code >= 0) & (code < len(order)), F.get(F.array(*map(F.lit, order)), code.cast("int")))


def union_levels(splits: dict[str, DataFrame], cols: list[str]) -> DataFrame:
    """feature, level: the levels of any part."""
    parts = [_level_counts(d, cols).select("feature", "level") for d in splits.values()]
    return reduce(DataFrame.unionByName, parts).distinct()


def display_labels(table: DataFrame, labels: DataFrame) -> DataFrame:
    """feature, code, label of a level table: from the label file by dummy name, else what follows the group's name, else the level."""
    name = F.concat_ws("_", "feature", "level")
    given = label_lookup(table.withColumn("_dummy", name), "_dummy", labels)
    suffix = F.when(F.col("level").startswith(F.concat(F.col("feature"), F.lit("_"))), F.substr("level", F.length("feature") + 2)).otherwise(F.col("level"))
    return given.select("feature", "code", F.when(F.col("label") != F.col("_dummy"), F.col("label")).otherwise(suffix).alias("label"))


def expand_mask(mask: DataFrame, members: DataFrame) -> DataFrame:
    """A mask (feature, node) over dummies: each member of a group (feature, member) has its group's nodes."""
    wide = mask.join(F.broadcast(members), "feature", "left")
    return wide.select(F.coalesce("member", "feature").alias("feature"), "node")


def harmonise(df: DataFrame, col: str, table: DataFrame) -> DataFrame:
    """Values outside the level table become null."""
    known = table.select(F.col("level").alias("_level"))
    return df.join(known, df[col] == known["_level"], "left").withColumn(col, F.col("_level")).drop("_level")


def collapse(members: list[Column]) -> Column:
    """Dummies to a code: the first largest member above one half, counted from 1, else 0; negative values are an error."""
    top = F.greatest(*members) if len(members) > 1 else members[0]
    low = F.least(*members) if len(members) > 1 else members[0]
    code = F.lit(0)
    for i, m in reversed(list(enumerate(members, 1))):
        code = F.when((m == top) & (top > 0.5), i).otherwise(code)
    return F.when(low < 0, F.raise_error(F.lit("a dummy is negative")).cast("int")).otherwise(code)


def expand(code: Column, names: list[str]) -> dict[str, Column]:
    return {n: (code == i).cast("int") for i, n in enumerate(names, 1)}


def violations(df: DataFrame, group: list[str], tol: float = 0.1) -> DataFrame:
    """Rows whose dummies sum to more than one, or to nothing."""
    total = sum((F.col(g) for g in group[1:]), F.col(group[0]))
    return df.agg(F.count_if(total > 1 + tol).alias("more_than_one"), F.count_if(total == 0).alias("all_zero"), F.count("*").alias("n"))


@dataclass(frozen=True)
class MedianStdScaler:
    """(x - median) / (sd_scale * population deviation); a deviation of 0 counts as 1."""

    fitted: dict[str, tuple[float, float]]
    sd_scale: float = 2.0

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / (s * self.sd_scale) for c, (m, s) in self.fitted.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * (s * self.sd_scale) + m for c, (m, s) in self.fitted.items()})


def fit_scaler(df: DataFrame, cols: list[str], sd_scale: float = 2.0, skip_binary: bool = True) -> MedianStdScaler:
    """Exact medians and population deviations; columns of 0 and 1 only are left out, an empty one counts as 0 and 1."""
    row = df.agg(*[F.struct(F.stddev_pop(c).alias("s"), F.bool_and(F.col(c).isin(0, 1)).alias("b")).alias(c) for c in cols]).first()
    wanted = [c for c in cols if not (skip_binary and row[c]["b"])]
    middle = exact_percentiles(df, wanted, [0.5]) if wanted else {}
    return MedianStdScaler({c: (middle[c][0] or 0.0, row[c]["s"] or 1.0) for c in wanted}, sd_scale)


@dataclass(frozen=True)
class ShiftScaler:
    """(x - shift) / scale for each column, the form of the common scalers."""

    fitted: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - a) / b for c, (a, b) in self.fitted.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * b + a for c, (a, b) in self.fitted.items()})


def fit_shift_scaler(df: DataFrame, cols: list[str], kind: str) -> ShiftScaler:
    """``none``; ``standard``: mean and population deviation; ``minmax``: 0 to 1; ``robust``: median and quartile range."""
    if kind == "none":
        return ShiftScaler({c: (0.0, 1.0) for c in cols})
    if kind == "robust":
        q = exact_percentiles(df, cols, [0.25, 0.5, 0.75])
        ends = {c: (q[c][1], None if q[c][0] is None else q[c][2] - q[c][0]) for c in cols}
    else:
        two = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, lambda c: F.max(c) - F.min(c))}[kind]
        row = df.agg(*[F.struct(two[0](c).cast("double").alias("a"), two[1](c).cast("double").alias("b")).alias(c) for c in cols]).first()
        ends = {c: (row[c]["a"], row[c]["b"]) for c in cols}
    return ShiftScaler({c: (a or 0.0, b or 1.0) for c, (a, b) in ends.items()})


def label_lookup(df: DataFrame, col: str, labels: DataFrame) -> DataFrame:
    """label of each value by a table (name, label); the value itself where there is none or a placeholder."""
    named = labels.select(F.col("name").alias("_name"), F.when(~F.col("label").startswith("[USER:"), F.replace("label", F.lit("\\n"), F.lit("\n"))).alias("_label"))
    return df.join(named, df[col] == named["_name"], "left").withColumn("label", F.coalesce("_label", F.col(col))).drop("_name", "_label")


def label_template(table: DataFrame, plain: DataFrame) -> DataFrame:
    """Rows of a label file: plain columns, each group, its reference, its members; names once."""
    group = table.select("feature").distinct().select(F.col("feature").alias("name"), F.lit("group").alias("notes"), F.lit(1).alias("rank"))
    members = table.select(F.concat_ws("_", "feature", "level").alias("name"), F.when(F.col("is_reference"), "reference").otherwise("member").alias("notes"), F.when(F.col("is_reference"), 2).otherwise(3).alias("rank"))
    rows = plain.select("name", F.lit("plain").alias("notes"), F.lit(0).alias("rank")).unionByName(group).unionByName(members)
    once = F.row_number().over(Window.partitionBy("name").orderBy("rank"))
    return rows.withColumn("_n", once).where("_n = 1").select("name", "notes", "rank")
