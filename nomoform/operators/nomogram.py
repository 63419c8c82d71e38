"""Tables that a nomogram shows, and scoring from them alone."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid
from ..functions.storage import staged
from .decompose import first_values


def curves(responses: DataFrame, betas: DataFrame) -> DataFrame:
    """term, vi, vj, r = beta * phi on the grids of the selected terms."""
    return responses.join(F.broadcast(betas), "term").select("term", "vi", "vj", (F.col("beta") * F.col("phi")).alias("r"))


def odds_ratios(curve: DataFrame) -> DataFrame:
    return curve.withColumn("odds_ratio", F.exp("r"))


def common_range(curve: DataFrame, margin: float = 0.05) -> DataFrame:
    """Shared ends of all response axes; a constant gets a tenth of its size, or 0.1 at zero."""
    lo, hi = F.min("r"), F.max("r")
    pad = F.when(hi > lo, (hi - lo) * margin).when(F.abs(lo) > 0, F.abs(lo) * 0.1).otherwise(0.1)
    return curve.agg((lo - pad).alias("lo"), (hi + pad).alias("hi"))


def conversion_line(ends: DataFrame, intercept: float, ticks: int = 11, reach: float = 4.595) -> DataFrame:
    """Even ticks of the sum of responses and the probability each stands for."""
    lo, hi = F.greatest("lo", F.lit(-reach - intercept)), F.least("hi", F.lit(reach - intercept))
    tick = lo + (hi - lo) * F.col("k") / (ticks - 1)
    return ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1))).alias("k")).select("k", tick.alias("tick"), sigmoid(tick + intercept).alias("p"))


def points(curve: DataFrame) -> DataFrame:
    """Responses as points from 0 to 100 over all curves."""
    ends = curve.agg(F.min("r").alias("_lo"), F.max("r").alias("_hi"))
    return curve.crossJoin(F.broadcast(ends)).withColumn("points", F.when(F.col("_hi") > F.col("_lo"), (F.col("r") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 100).otherwise(0.0)).drop("_lo", "_hi")


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation on a curve, clamped outside it: a column expression, also for streams."""
    out = F.lit(ys[-1])
    for (a, b), (ya, yb) in reversed(list(zip(zip(xs, xs[1:]), zip(ys, ys[1:])))):
        out = F.when(x <= b, F.lit(ya) + (x - a) * ((yb - ya) / (b - a))).otherwise(out)
    return F.when(x <= xs[0], F.lit(ys[0])).otherwise(out)


def score_rows(df: DataFrame, singles: dict[str, list[tuple[float, float]]], intercept: float) -> DataFrame:
    """Adds p: the sum of the curves' values at each row; curves are short lists of (value, r)."""
    total = F.lit(intercept)
    for f, curve in singles.items():
        curve = sorted(curve)
        total = total + interpolate(F.col(f).cast("double"), [v for v, _ in curve], [r for _, r in curve])
    return df.withColumn("p", sigmoid(total))


@dataclass(frozen=True)
class Table:
    """One curve or interaction grid: its features, (vi, vj, r) points, vj null for a curve, and which axes are categories."""

    first: str
    second: str | None
    points: list[tuple[float, float | None, float]]
    categories: frozenset[str] = frozenset()

    def value(self) -> Column:
        """r at a row, as a column expression that streams can use too.

        Numeric axes are bracketed by their neighbouring grid values and
        interpolated, both for a pair, and clamped outside the grid; categories are
        looked up, and one that the grid does not have gives null, as does a null value.
        """
        xs = sorted({p[0] for p in self.points})
        ys = sorted({p[1] for p in self.points}) if self.second else [None]
        at = {(p[0], p[1] if self.second else None): p[2] for p in self.points}
        if len(at) != len(xs) * len(ys):
            raise ValueError(f"the grid of {self.first} and {self.second} has holes")
        flat = F.array(*[F.lit(float(at[x, y])) for x in xs for y in ys])
        i, t = _bracket(F.col(self.first).cast("double"), xs, self.first in self.categories)
        if not self.second:
            return _between(F.get(flat, i), F.get(flat, i + 1), t)
        j, u = _bracket(F.col(self.second).cast("double"), ys, self.second in self.categories)
        row = lambda k: _between(F.get(flat, k * len(ys) + j), F.get(flat, k * len(ys) + j + 1), u)
        return _between(row(i), row(i + 1), t)


def _between(a: Column, b: Column, share: Column) -> Column:
    """a at share 0, so that b may be missing there."""
    return F.when(share == 0, a).otherwise(a + (b - a) * share)


def _bracket(x: Column, grid: list[float], category: bool) -> tuple[Column, Column]:
    """Place of the grid value at or below x, and how far x lies towards the next; null for an unknown category."""
    values = F.array(*[F.lit(float(v)) for v in grid])
    if category:
        place = F.array_position(values, x)
        return F.when(place > 0, place - 1).cast("int"), F.when(place > 0, F.lit(0.0))
    if len(grid) == 1:
        return F.when(x.isNotNull(), 0), F.when(x.isNotNull(), F.lit(0.0))
    below = F.size(F.filter(values, lambda v: v <= x)) - 1
    i = F.when(x.isNotNull(), F.least(F.greatest(below, F.lit(0)), F.lit(len(grid) - 2)))
    share = (x - F.get(values, i)) / (F.get(values, i + 1) - F.get(values, i))
    return i, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


def score_tables(df: DataFrame, tables: list[Table], intercept: float) -> DataFrame:
    """Adds p from the tables of a nomogram alone: curves, categories and pairs. Tables are bounded by their grid steps."""
    return df.withColumn("p", sigmoid(sum((t.value() for t in tables), F.lit(intercept))))


def grid_matrix(curve: DataFrame, term: int, columns: list[float]) -> DataFrame:
    """An interaction grid as a matrix: a row for each vi, a column r0, r1, ... for each of the values of vj in ``columns``."""
    cells = [F.max(F.when(F.col("vj") == v, F.col("r"))).alias(f"r{k}") for k, v in enumerate(columns)]
    return curve.where(F.col("term") == term).groupBy("vi").agg(*cells)


def to_json(curve: DataFrame, names: dict[int, str], intercept: float) -> DataFrame:
    """One JSON document per term; curves are bounded by their grid steps."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("term"))
    point = F.struct(F.col("vi").alias("x"), F.col("vj").alias("y"), F.col("r").alias("r"))
    doc = F.struct(F.lit("1.0").alias("schema"), F.lit(intercept).alias("intercept"), F.first("name").alias("name"), F.array_sort(F.collect_list(point)).alias("points"))
    return curve.withColumn("name", name).groupBy("term").agg(F.to_json(doc).alias("json"))


def from_json(docs: DataFrame) -> DataFrame:
    schema = "schema string, intercept double, name string, points array<struct<x: double, y: double, r: double>>"
    parsed = docs.select("term", F.from_json("json", schema).alias("d"))
    return parsed.select("term", F.col("d.name").alias("name"), F.inline("d.points")).select("term", "name", F.col("x").alias("vi"), F.col("y").alias("vj"), "r")


def descaled(curve: DataFrame, scaler: dict[int, tuple[float, float]], second: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """Curves in the units of the data: values times scale plus shift, by term; ``second`` is for the second feature of pairs."""
    for name, fitted in (("vi", scaler), ("vj", second)):
        if fitted:
            at = lambda k: F.element_at(F.create_map(*[F.lit(x) for t, p in fitted.items() for x in (t, float(p[k]))]), F.col("term"))  # noqa: B023, E731
            curve = curve.withColumn(name, F.col(name) * F.coalesce(at(1), F.lit(1.0)) + F.coalesce(at(0), F.lit(0.0)))
    return curve


def pair_kinds(catalogue: dict[str, str], which: list[tuple[int, str, str | None]]) -> dict[int, str]:
    """mixed, categories or numbers, for each pair term; ``catalogue`` names each feature's kind."""
    kind = {0: "numbers", 1: "mixed", 2: "categories"}
    return {t: kind[(catalogue[a] == "categorical") + (catalogue[b] == "categorical")] for t, a, b in which if b}


@dataclass(frozen=True)
class Nomogram:
    """The tables of one nomogram: curves (term, vi, vj, r), their shared range, and the line from sums to probabilities."""

    intercept: float
    names: dict[int, str]
    kinds: dict[int, str]
    curves: DataFrame
    common: DataFrame
    line: DataFrame


def build(responses: DataFrame, betas: DataFrame, intercept: float, names: dict[int, str], kinds: dict[int, str], scaler: dict[int, tuple[float, float]] | None = None, second: dict[int, tuple[float, float]] | None = None) -> Nomogram:
    """All tables from responses on the grids of the selected terms and their coefficients; scalers as in :func:`descaled`."""
    curve = staged(descaled(curves(responses, betas), scaler or {}, second), "curves")
    common = common_range(curve)
    return Nomogram(intercept, names, kinds, curve, common, conversion_line(common, intercept))


def build_both(responses: DataFrame, grid: DataFrame, betas: DataFrame, intercept: float, names: dict[int, str], kinds: dict[int, str], scaler: dict[int, tuple[float, float]] | None = None, second: dict[int, tuple[float, float]] | None = None) -> tuple[Nomogram, Nomogram]:
    """The nomogram to show, over a trimmed range, and the one to store, over all of it.

    ``grid`` is that of ``decompose.both_grids`` and ``responses`` are those on its points.
    """
    at = grid.select(F.col("term").alias("_t"), F.col("vi").alias("_i"), F.col("vj").alias("_j"), "shown", "stored")
    same = (F.col("term") == F.col("_t")) & (F.col("vi") == F.col("_i")) & F.col("vj").eqNullSafe(F.col("_j"))
    flagged = staged(responses.join(at, same).select("term", "vi", "vj", "phi", "shown", "stored"), "both-responses")
    shown, stored = (build(flagged.where(side), betas, intercept, names, kinds, scaler, second) for side in ("shown", "stored"))
    return shown, stored


def document(n: Nomogram, metadata: dict[str, str], selected_lambda: float, index: int) -> DataFrame:
    """The whole nomogram as one JSON document; grids are bounded by their steps."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in n.names.items() for x in kv]), F.col("term"))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in (n.kinds or {-1: ""}).items() for x in kv]), F.col("term"))
    point = F.struct(F.col("vi").alias("x"), F.col("vj").alias("y"), F.col("r").alias("r"))
    each = n.curves.groupBy("term").agg(F.max(F.col("vj").isNotNull()).alias("pair"), F.array_sort(F.collect_list(point)).alias("points"))
    entry = F.struct("term", name.alias("name"), kind.alias("kind"), "points")
    side = lambda pair: F.array_sort(F.filter(F.collect_list(F.when(F.col("pair") == pair, entry)), lambda x: x.isNotNull()))
    model = F.struct(F.lit(n.intercept).alias("intercept"), F.lit(selected_lambda).alias("selected_lambda"), F.lit(index).alias("index"))
    meta = F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv]) if metadata else F.create_map().cast("map<string,string>")
    doc = F.struct(F.lit(VERSION).alias("schema"), meta.alias("metadata"), model.alias("model"), side(False).alias("univariate"), side(True).alias("bivariate"))
    return each.agg(F.to_json(doc).alias("json"))


VERSION = "1.0"
_ENTRY = "array<struct<term: int, name: string, kind: string, points: array<struct<x: double, y: double, r: double>>>>"


def read_document(docs: DataFrame) -> DataFrame:
    """term, name, vi, vj, r, intercept of nomogram documents; another version is warned of and read, a missing intercept is 0."""
    schema = f"schema string, metadata map<string,string>, model struct<intercept: double, selected_lambda: double, index: int>, univariate {_ENTRY}, bivariate {_ENTRY}"
    parsed = docs.select(F.from_json("json", schema).alias("d"))
    other = parsed.where(~F.col("d.schema").eqNullSafe(F.lit(VERSION))).limit(1).count()
    if other:
        warnings.warn(f"a nomogram of another version than {VERSION}", stacklevel=2)
    both = F.concat(F.coalesce("d.univariate", F.array().cast(_ENTRY)), F.coalesce("d.bivariate", F.array().cast(_ENTRY)))
    rows = parsed.select(F.coalesce("d.model.intercept", F.lit(0.0)).alias("intercept"), F.explode(both).alias("e"))
    return rows.select("intercept", F.col("e.term").alias("term"), F.col("e.name").alias("name"), F.inline("e.points")).select(
        "term", "name", F.col("x").alias("vi"), F.col("y").alias("vj"), "r", "intercept"
    )


#: The settings of a document that names none.
STEPS, THRESHOLD = 50, 15


def settings(docs: DataFrame) -> DataFrame:
    """intercept, n_steps, threshold of nomogram documents; what one lacks, or has in no readable form, is 0, STEPS or THRESHOLD."""
    d = F.from_json("json", "metadata map<string,string>, model struct<intercept: double>")
    number = lambda key, default: F.coalesce(F.col("d.metadata")[key].try_cast("int"), F.lit(default))
    return docs.select(d.alias("d")).select(
        F.coalesce("d.model.intercept", F.lit(0.0)).alias("intercept"), number("n_steps", STEPS).alias("n_steps"), number("threshold", THRESHOLD).alias("threshold")
    )


def _beside(curve: DataFrame, names: dict[int, str], cells: dict[str, str]) -> DataFrame:
    """k and the ``cells`` (suffix to column) of each term beside each other, null below its last point."""
    k = F.row_number().over(Window.partitionBy("term").orderBy("vi", "vj")) - 1  # points of one grid
    cols = [F.max(F.when(F.col("term") == t, F.col(c))).alias(f"{name}_{suffix}") for t, name in names.items() for suffix, c in cells.items()]
    return curve.where(F.col("term").isin(*names)).withColumn("k", k).groupBy("k").agg(*cols).orderBy("k")


def wide_table(curve: DataFrame, names: dict[int, str]) -> DataFrame:
    """k and, for each single term, its x and r beside each other, null below its last point: the form of a CSV file."""
    return _beside(curve, names, {"x": "vi", "r": "r"})


def wide_pairs(curve: DataFrame, names: dict[int, str]) -> DataFrame:
    """The same for pair terms: x1, x2 and r of every point, first feature outermost."""
    return _beside(curve, names, {"x1": "vi", "x2": "vj", "r": "r"})


def write_csv(table: DataFrame, path: str, header: dict[str, str]) -> None:
    """A wide table as CSV with its names on top, and the header's lines as comments in a file beside it."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/table")  # a grid's rows
    lines = table.sparkSession.createDataFrame([(f"# {k}: {v}",) for k, v in header.items()], "value string")
    lines.coalesce(1).write.mode("overwrite").text(f"{path}/header")


def write_nomogram(n: Nomogram, path: str, header: dict[str, str], as_odds: bool = False) -> None:
    """The curves and the grids as two wide CSV tables, ``path/univariate`` and ``path/bivariate``, each with a header.

    The header tells the intercept and the scale of responses, log odds or odds ratios.
    A nomogram without pairs has no second table.
    """
    curve, level = (n.curves.withColumn("r", F.exp("r")), math.exp(n.intercept)) if as_odds else (n.curves, n.intercept)
    said = header | {"response scale": "odds ratio" if as_odds else "log odds ratio", "intercept": f"{level:.6f}"}
    for name, wide, pair in (("univariate", wide_table, False), ("bivariate", wide_pairs, True)):
        names = {t: x for t, x in n.names.items() if (t in n.kinds) == pair}
        if names:
            write_csv(wide(curve, names), f"{path}/{name}", {"data": name} | said)


def feature_metadata(df: DataFrame, features: list[str], threshold: int = 15) -> DataFrame:
    """feature, idx, kind, levels, min, max."""
    rows = [
        F.struct(F.lit(i).alias("idx"), F.lit(f).alias("feature"), F.when(F.count_distinct(f) < threshold, "categorical").otherwise("continuous").alias("kind"),
                 F.count_distinct(f).alias("levels"), F.min(f).cast("double").alias("min"), F.max(f).cast("double").alias("max"))
        for i, f in enumerate(features)
    ]
    return df.agg(F.array(*rows).alias("s")).select(F.inline("s"))


def feature_catalogue(
    df: DataFrame, features: list[str], originals: list[str], groups: dict[str, list[str]], labels: dict[str, str] | None = None, selected: list[str] | None = None, threshold: int = 15
) -> DataFrame:
    """A row for each of ``features``: its label, its places in all three orders, and what it holds.

    feature, label, dense_idx (place in ``selected``, null outside it), collapsed_idx
    (place in ``features``), original_idx (places in ``originals``: those of all dummies
    of a group), is_group, kind, values (sorted, of a category), min, max (of a number).
    Groups are categories, and so are features of fewer than ``threshold`` values;
    one without any value has an empty list. A name that ``originals`` lacks is an error.
    """
    place = {c: i for i, c in enumerate(originals)}
    members = {f: groups.get(f, [f]) for f in features}
    if missing := sorted({m for ms in members.values() for m in ms} - set(place)):
        raise ValueError(f"not among the original columns: {missing}")
    dense = {f: i for i, f in enumerate(features if selected is None else selected)}
    known = [(f, (labels or {}).get(f, f), dense.get(f), i, [place[m] for m in members[f]], f in groups) for i, f in enumerate(features)]
    table = df.sparkSession.createDataFrame(known, "feature string, label string, dense_idx int, collapsed_idx int, original_idx array<int>, is_group boolean")
    most = max([threshold, *(len(ms) + 1 for f, ms in members.items() if f in groups)])
    joined = table.join(first_values(df, features, most), "feature", "left")
    category = F.col("is_group") | (F.coalesce("n", F.lit(0)) < threshold)
    empty = F.array().cast("array<double>")
    return joined.select(
        *table.columns, F.when(category, "categorical").otherwise("continuous").alias("kind"), F.when(category, F.coalesce("values", empty)).alias("values"),
        F.when(~category, F.col("lo")).alias("min"), F.when(~category, F.col("hi")).alias("max"),
    )


def raw_responses(long: DataFrame, values: DataFrame, id_: list[str]) -> DataFrame:
    """Distinct (value, phi) of each term."""
    return long.join(values, [*id_, "term"]).select("term", "value", "phi").distinct()
