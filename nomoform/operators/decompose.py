"""Decomposition of a score's log-odds into one- and two-feature responses, one plan for all terms.

A score is either a Column of the features' Columns, which stays in one
code-generated stage, or a FrameScorer that adds p to a frame holding the
features: a fitted MLlib model or any function in Arrow batches (score.py).
A categorical feature is one column of codes, 0 for the reference level.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles
from ..functions.scalars import stable_logit
from ..functions.storage import staged
from .score import FrameScorer

Score = Callable[[dict[str, Column]], Column] | FrameScorer
Terms = list[tuple[int, str, str | None]]
#: Rows of the side of a cross join that is broadcast, at most.
MAX_BROADCAST = 200_000


def terms(features: list[str], singles: list[str] | None = None, pairs: list[tuple[str, str]] | None = None) -> Terms:
    """Term number, first and second feature: single terms, then pairs in order of combinations.

    With ``singles`` or ``pairs`` only those: features of a pair count as
    chosen, and without ``pairs`` all pairs among the chosen ones are taken.
    Numbers stay those of the full list; nothing chosen means all.
    """
    n = len(features)
    all_pairs = [(n + k, a, b) for k, (a, b) in enumerate(combinations(features, 2))]
    unknown = {*(singles or ()), *(f for p in pairs or () for f in p)} - set(features)
    if unknown:
        raise ValueError(f"unknown features {sorted(unknown)}")
    chosen = {*(singles or ()), *(f for p in pairs or () for f in p)} or set(features)
    wanted = {frozenset(p) for p in pairs} if pairs else None
    two = [t for t in all_pairs if {t[1], t[2]} <= chosen and (wanted is None or frozenset(t[1:]) in wanted)]
    return [(i, f, None) for i, f in enumerate(features) if f in chosen] + two


def background(df: DataFrame, features: list[str], weight: str | None = None) -> DataFrame:
    """Distinct feature tuples with their counts (or the sums of ``weight``): the average runs over these."""
    counted = F.lit(1).cast("long") if weight is None else F.col(weight)
    x = df.select(*[(F.col(f).cast("double") + F.lit(0.0)).alias(f) for f in features], counted.alias("w_"))
    return x.groupBy(*features).agg(F.sum("w_").alias("w_"))


def _values(which: Terms) -> Column:
    """term, vi, vj of a row of features, for each term."""
    each = [F.struct(F.lit(t).alias("term"), F.col(a).alias("vi"), (F.col(b) if b else F.lit(None).cast("double")).alias("vj")) for t, a, b in which]
    return F.inline(F.array(*each))


def value_grid(back: DataFrame, which: Terms) -> DataFrame:
    """term, vi, vj: the distinct values, or pairs of values, of each term, in one pass over the background."""
    return back.select(_values(which)).distinct()


def first_values(df: DataFrame, features: list[str], most: int) -> DataFrame:
    """feature, values (the ``most`` smallest distinct ones, sorted), lo, hi, n (how many there are) of features with a value.

    Values are cut in two steps, by parts of a feature first, so no row holds more than a few times ``most``.
    """
    few = F.slice(F.array_sort(F.collect_set("v")), 1, most)
    values = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))).where("v is not null")
    once = values.groupBy("feature", "v").agg(F.lit(1)).withColumn("part", F.pmod(F.xxhash64("v"), F.lit(64)))
    parts = once.groupBy("feature", "part").agg(few.alias("vs"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    joined = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("vs")))), 1, most)
    return parts.groupBy("feature").agg(joined.alias("values"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def even_grid(
    df: DataFrame, features: list[str], steps: int = 15, threshold: int = 15, trim: float | None = None, categories: dict[str, int] | None = None
) -> DataFrame:
    """feature, k, value: sorted distinct values if there are few, else even steps between the ends.

    A category with n members besides its reference has the codes 0 to n.
    ``trim`` puts the ends at that quantile and its opposite.
    """
    categories = categories or {}
    plain = [f for f in features if f not in categories]
    cut = exact_percentiles(df, plain, [trim, 1 - trim]) if trim and plain else {}
    rows = first_values(df, features, threshold)
    lo, hi = F.col("lo"), F.col("hi")
    for f, (a, b) in cut.items():
        if a is not None:
            lo, hi = F.when(F.col("feature") == f, F.lit(a)).otherwise(lo), F.when(F.col("feature") == f, F.lit(b)).otherwise(hi)
    even = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: lo + (hi - lo) * k / (steps - 1))
    chosen = F.when(F.col("n") < threshold, F.col("values")).otherwise(even)
    for f, n in categories.items():
        chosen = F.when(F.col("feature") == f, F.array(*[F.lit(float(c)) for c in range(n + 1)])).otherwise(chosen)
    return rows.select("feature", F.posexplode(chosen).alias("k", "value"))


def term_backgrounds(back: DataFrame, features: list[str], which: Terms) -> DataFrame:
    """term, features, w_: for each term the distinct tuples of the features it leaves free, with their counts.

    The average of a term runs over the other features only, so its background is
    grouped by those; the term's own features are null. One aggregate makes the
    backgrounds of all terms. A pair out of few features leaves few tuples.
    """
    free = lambda own: [(F.lit(None).cast("double") if f in own else F.col(f)).alias(f) for f in features]
    each = [F.struct(F.lit(t).alias("term"), *free((a, b)), F.col("w_")) for t, a, b in which]
    return back.select(F.inline(F.array(*each))).groupBy("term", *features).agg(F.sum("w_").alias("w_"))


def crossed(grid: DataFrame, backs: DataFrame) -> DataFrame:
    """Every grid row with every background row of its term, by an equi-join on the term.

    A side is broadcast if it has at most MAX_BROADCAST rows. Of two larger
    sides each term is cut into blocks of about MAX_BROADCAST / 8 rows, and every
    pair of a grid block and a background block is one key of a shuffled join, so
    neither a frequent term nor the size of a side fills a task.
    """
    if grid.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        return backs.join(F.broadcast(grid), "term")
    if backs.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        return grid.join(F.broadcast(backs), "term")
    block = max(1, MAX_BROADCAST // 8)
    blocks = lambda df, name: df.groupBy("term").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = F.broadcast(blocks(grid, "_g").join(blocks(backs, "_b"), "term"))  # one row for each term
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.col(n)).cast("int")
    left = grid.join(sizes, "term").withColumn("_i", own("_g", "vi", "vj")).withColumn("_j", spread("_b")).drop("_g", "_b")
    right = backs.join(sizes, "term").withColumn("_j", own("_b", *[c for c in backs.columns if c != "term"])).withColumn("_i", spread("_g")).drop("_g", "_b")
    return left.join(right, ["term", "_i", "_j"]).drop("_i", "_j")


def substituted(features: list[str], which: Terms, base: dict[str, Column]) -> dict[str, Column]:
    """Each feature's value in a crossed row: the grid's where the term has the feature, else the base."""
    out = {}
    for f in features:
        first = [t for t, a, _ in which if a == f]
        second = [t for t, _, b in which if b == f]
        c = base[f]
        if second:
            c = F.when(F.col("term").isin(*second), F.col("vj")).otherwise(c)
        if first:
            c = F.when(F.col("term").isin(*first), F.col("vi")).otherwise(c)
        out[f] = c
    return out


def _with_logit(df: DataFrame, values: dict[str, Column], score: Score, keep: list[str]) -> DataFrame:
    """``keep`` and z, the log-odds at ``values``."""
    if isinstance(score, FrameScorer):
        return score.add(df.select(*keep, *[c.cast("double").alias(f) for f, c in values.items()])).select(*keep, stable_logit(F.col("p")).alias("z"))
    return df.select(*keep, stable_logit(score(values)).alias("z"))


def baseline(back: DataFrame, features: list[str], score: Score) -> DataFrame:
    """phi0: the mean log-odds over the background."""
    z = _with_logit(back, {f: F.col(f) for f in features}, score, ["w_"])
    return z.agg((F.sum(F.col("w_") * F.col("z")) / F.sum("w_")).alias("phi0"))


def _centred(raw: DataFrame, phi0: DataFrame, which: Terms) -> DataFrame:
    """term, vi, vj, phi from average log-odds: less the baseline, and for pairs less the single responses."""
    number = {a: t for t, a, b in which if b is None}
    raw = raw.crossJoin(F.broadcast(phi0)).withColumn("d", F.col("z") - F.col("phi0"))
    single = raw.where("vj is null").select(F.col("term").alias("_t"), F.col("vi").alias("_v"), F.col("d").alias("_d"))
    one = raw.where("vj is null").select("term", "vi", "vj", F.col("d").alias("phi"))
    pairs = [(t, number[a], number[b]) for t, a, b in which if b]
    if not pairs:
        return one
    map_ = lambda k: F.element_at(F.create_map(*[F.lit(x) for p in pairs for x in (p[0], p[k])]), F.col("term"))
    two = raw.where("vj is not null").withColumns({"_a": map_(1), "_b": map_(2)})
    left = single.select(F.col("_t").alias("_a"), F.col("_v").alias("vi"), F.col("_d").alias("_da"))
    right = single.select(F.col("_t").alias("_b"), F.col("_v").alias("vj"), F.col("_d").alias("_db"))
    both = two.join(left, ["_a", "vi"]).join(right, ["_b", "vj"])
    return one.unionByName(both.select("term", "vi", "vj", (F.col("d") - F.col("_da") - F.col("_db")).alias("phi")))


def with_baseline(df: DataFrame, features: list[str], score: Score, grid: DataFrame | None = None, which: Terms | None = None, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Averaged responses (see :func:`lebesgue`) and their baseline, from one background that is grouped once."""
    which = which or terms(features)
    back = staged(background(df, features, weight), "background")
    grid = value_grid(back, which) if grid is None else grid.where(F.col("term").isin(*[t for t, _, _ in which]))
    grid = staged(grid, "grid")
    backs = staged(term_backgrounds(back, features, which), "term-backgrounds")
    z = _with_logit(crossed(grid, backs), substituted(features, which, {f: F.col(f) for f in features}), score, ["term", "vi", "vj", "w_"])
    raw = z.groupBy("term", "vi", "vj").agg((F.sum(F.col("w_") * F.col("z")) / F.sum("w_")).alias("z"))
    phi0 = baseline(back, features, score)
    return _centred(staged(raw, "responses"), phi0, which), phi0


def lebesgue(df: DataFrame, features: list[str], score: Score, grid: DataFrame | None = None, which: Terms | None = None, weight: str | None = None) -> DataFrame:
    """Responses averaged over the distribution of ``df``, per value or pair of values, for the terms ``which``."""
    return with_baseline(df, features, score, grid, which, weight)[0]


def dirac(df: DataFrame, features: list[str], score: Score, reference: dict[str, float], grid: DataFrame | None = None, which: Terms | None = None) -> DataFrame:
    """Responses at a reference point: no background, one score per grid row."""
    which = which or terms(features)
    grid = value_grid(background(df, features), which) if grid is None else grid.where(F.col("term").isin(*[t for t, _, _ in which]))
    at = {f: F.lit(float(reference[f])) for f in features}
    raw = _with_logit(grid, substituted(features, which, at), score, ["term", "vi", "vj"])
    phi0 = _with_logit(df.sparkSession.range(1), at, score, []).select(F.col("z").alias("phi0"))
    return _centred(staged(raw, "responses"), phi0, which)


def product_grid(single: DataFrame, features: list[str], which: Terms | None = None) -> DataFrame:
    """term, vi, vj from (feature, k, value): values of single terms, products for pairs, first feature outermost."""
    out = None
    for t, a, b in which or terms(features):
        va = single.where(F.col("feature") == a).select(F.lit(t).alias("term"), F.col("value").alias("vi"))
        vb = single.where(F.col("feature") == b).select(F.col("value").alias("vj")) if b else None
        g = va.withColumn("vj", F.lit(None).cast("double")) if b is None else va.crossJoin(F.broadcast(vb))
        out = g if out is None else out.unionByName(g)
    return out


def both_grids(df: DataFrame, features: list[str], which: Terms, trim: float, steps: int = 15, threshold: int = 15, categories: dict[str, int] | None = None) -> DataFrame:
    """term, vi, vj, shown, stored: the points of a trimmed display and of the full range, each once.

    Responses on this union take one pass over the background; a point that both
    grids have is averaged once.
    """
    sides = [
        product_grid(even_grid(df, features, steps, threshold, cut, categories), features, which).withColumns({"shown": F.lit(cut is not None), "stored": F.lit(cut is None)})
        for cut in (trim, None)
    ]
    points = sides[0].unionByName(sides[1]).groupBy("term", "vi", "vj").agg(F.bool_or("shown").alias("shown"), F.bool_or("stored").alias("stored"))
    return staged(points, "both-grids")


def to_rows(df: DataFrame, id_: list[str], features: list[str], responses: DataFrame, which: Terms | None = None) -> DataFrame:
    """id, term, phi for every row: responses joined back on the very values they were made for.

    The values of a term are few keys, so responses are broadcast if they have
    at most MAX_BROADCAST rows; beyond that the join shuffles.
    """
    x = df.select(*id_, *[(F.col(f).cast("double") + F.lit(0.0)).alias(f) for f in features])
    long = x.select(*id_, _values(which or terms(features)))
    r = responses.select(F.col("term").alias("_t"), F.col("vi").alias("_i"), F.col("vj").alias("_j"), "phi")
    if r.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        r = F.broadcast(r)
    same = (F.col("term") == F.col("_t")) & (F.col("vi") == F.col("_i")) & F.col("vj").eqNullSafe(F.col("_j"))
    return long.join(r, same).select(*id_, "term", "phi")
