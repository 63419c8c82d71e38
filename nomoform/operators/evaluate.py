"""Evaluation of scores. Tables are reduced to counts per score first, so windows see distinct scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles
from ..functions.ranks import running_totals
from ..functions.scalars import draw
from ..functions.storage import staged


def score_counts(df: DataFrame, p: str = "p", y: str = "y", by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """by, p, pos, neg: weighted counts of each distinct score."""
    w = F.lit(1).cast("long") if weight is None else weight
    return df.groupBy(*(by or []), F.col(p).alias("p")).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 0, w).otherwise(0)).alias("neg"))


def auc(counts: DataFrame, by: list[str] | None = None, ranges: int = 64) -> DataFrame:
    """Area under the ROC curve; ties count one half. Null where a class is missing."""
    cum = running_totals(counts, "p", ["neg"], by, ranges)
    area = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))
    pos, neg = F.sum("pos"), F.sum("neg")
    out = cum.groupBy(*by) if by else cum
    return out.agg(F.when((pos > 0) & (neg > 0), area).alias("auc"))


def roc_points(counts: DataFrame, by: list[str] | None = None, ranges: int = 64) -> DataFrame:
    """fpr and tpr of predicting 1 at each distinct score or above."""
    cum = running_totals(counts, "p", ["pos", "neg"], by, ranges)
    share = lambda c: (F.col(f"total_{c}") - F.col(f"cum_{c}") + F.col(c)) / F.col(f"total_{c}")
    return cum.select(*(by or []), "p", share("neg").alias("fpr"), share("pos").alias("tpr"))


def roc_on_grid(points: DataFrame, steps: int = 100, by: list[str] | None = None) -> DataFrame:
    """tpr on an even grid of fpr by linear interpolation; at a jump the higher point counts.

    Points between two grid values are reduced to their ends, so the window
    that finds a grid value's neighbours sees at most ``steps`` rows of each ``by``.
    """
    by = by or []
    cell = F.ceil(F.round(F.col("fpr") * (steps - 1), 9)).cast("int")
    at = F.struct("fpr", "tpr")
    cells = points.groupBy(*by, cell.alias("k")).agg(F.max(at).alias("hi"), F.min(at).alias("lo"))
    groups = points.select(*by).distinct() if by else points.sparkSession.range(1).select()
    frame = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k"))
    w = Window.partitionBy(*by).orderBy("k")
    zero = F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    last = F.greatest(F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, 0)), zero)
    following = F.min("lo").over(w.rowsBetween(1, Window.unboundedFollowing))
    near = frame.join(cells, [*by, "k"], "left").select(*by, "k", last.alias("_a"), following.alias("_b"))
    x = F.col("k") * F.lit(1.0 / (steps - 1))
    slope = F.when(F.col("_b.fpr") > F.col("_a.fpr"), (F.col("_b.tpr") - F.col("_a.tpr")) / (F.col("_b.fpr") - F.col("_a.fpr"))).otherwise(0.0)
    return near.select(*by, "k", x.alias("fpr"), (F.col("_a.tpr") + slope * (x - F.col("_a.fpr"))).alias("tpr"))


def confusion(df: DataFrame, threshold: Column | float, by: list[str] | None = None, p: str = "p", y: str = "y") -> DataFrame:
    """Counts and rates of predicting 1 strictly above the threshold; 0 where undefined."""
    hit, one = F.col(p) > threshold, F.col(y) == 1
    n = df.groupBy(*(by or [])).agg(
        F.count_if(hit & one).alias("tp"), F.count_if(hit & ~one).alias("fp"), F.count_if(~hit & one).alias("fn"), F.count_if(~hit & ~one).alias("tn")
    )
    return rates(n)


def rates(n: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1 of counts; 0 where undefined."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def count_losses(counts: DataFrame, by: list[str] | None = None, eps: float = 1e-15) -> DataFrame:
    """log_loss and brier from the counts of each distinct score."""
    q = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1 - eps))
    n = F.sum(F.col("pos") + F.col("neg"))
    ll = -(F.col("pos") * F.ln(q) + F.col("neg") * F.ln(1 - q))
    brier = F.col("pos") * (1 - F.col("p")) * (1 - F.col("p")) + F.col("neg") * F.col("p") * F.col("p")
    return counts.groupBy(*(by or [])).agg((F.sum(ll) / n).alias("log_loss"), (F.sum(brier) / n).alias("brier"))


def losses(df: DataFrame, by: list[str] | None = None, p: str = "p", y: str = "y", eps: float = 1e-15) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    ll = -(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))
    return df.groupBy(*(by or [])).agg(F.avg(ll).alias("log_loss"), F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def calibration(df: DataFrame, edges: Column, by: list[str] | None = None, weight: Column | None = None, p: str = "p", y: str = "y") -> DataFrame:
    """Mean score and rate of ones per bin of the inner ``edges``; a value on an edge is in the lower bin."""
    w = F.lit(1).cast("long") if weight is None else weight
    bin_ = F.size(F.filter(edges, lambda e: e < F.col(p)))
    return df.groupBy(*(by or []), bin_.alias("bin")).agg(F.sum(w).alias("n"), (F.sum(F.col(p) * w) / F.sum(w)).alias("mean_p"), (F.sum(F.col(y) * w) / F.sum(w)).alias("rate")).where("n > 0")


def count_calibration(counts: DataFrame, edges: Column, by: list[str] | None = None) -> DataFrame:
    """:func:`calibration` from the counts of each distinct score."""
    n = F.sum(F.col("pos") + F.col("neg"))
    bin_ = F.size(F.filter(edges, lambda e: e < F.col("p"))).alias("bin")
    return counts.groupBy(*(by or []), bin_).agg(n.alias("n"), (F.sum(F.col("p") * (F.col("pos") + F.col("neg"))) / n).alias("mean_p"), (F.sum("pos") / n).alias("rate")).where("n > 0")


def uniform_edges(bins: int) -> Column:
    return F.array(*[F.lit(i / bins) for i in range(1, bins)])


def quantile_edges(df: DataFrame, bins: int, p: str = "p") -> Column:
    """Inner quantiles of the scores; none for a table without scores."""
    edges = exact_percentiles(df, [p], [i / bins for i in range(1, bins)])[p]
    known = [e for e in edges if e is not None]
    return F.array(*map(F.lit, known)) if known else F.array().cast("array<double>")


#: Cumulative Poisson(1) probabilities in units of 2^-32: a draw at or above the k-th counts more than k times.
POISSON = (1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923275)


def replicates(counts_rows: DataFrame, id_: str, n: int, seed: int = 7) -> DataFrame:
    """Rows with b (1 to n) and w, a seeded Poisson(1) count, standing for resampling with replacement."""
    rows = counts_rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n))))
    d = draw(F.concat_ws("-", F.col(id_).cast("string"), F.col("b").cast("string")), seed, "boot")
    w = sum(((d >= t).cast("long") for t in POISSON[1:]), (d >= POISSON[0]).cast("long"))
    return rows.withColumn("w", w).where("w > 0")


#: Poisson counts of a mean below this are drawn from their exact distribution, larger ones from its expansion around a normal.
EXACT_BELOW = 16


def poisson_cuts(mean: int) -> list[int]:
    """Cumulative Poisson probabilities in units of 2^-32, rounded up: a draw at or above the k-th counts more than k times."""
    out, term, total, k = [], math.exp(-mean), math.exp(-mean), 0
    while (cut := math.ceil(total * (1 << 32))) < 1 << 32:
        out.append(cut)
        k += 1
        term *= mean / k
        total += term
    return out


def poisson(id_: Column, mean: Column, seed: int, tag: str) -> Column:
    """A seeded Poisson count of a whole ``mean``: what resampling makes of so many equal rows, without the rows."""
    digest = F.md5(F.concat_ws(":", id_, F.lit(str(seed)), F.lit(tag)))
    d1, d2 = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    few = F.size(F.filter(F.get(F.array(*[F.array(*map(F.lit, poisson_cuts(m))) for m in range(1, EXACT_BELOW)]), (mean - 1).cast("int")), lambda c: c <= d1))
    z = F.sqrt(-2 * F.ln((d1 + 0.5) / (1 << 32))) * F.cos(F.lit(2 * math.pi) * ((d2 + 0.5) / (1 << 32)))
    many = F.greatest(F.floor(mean + F.sqrt(mean.cast("double")) * z + (z * z - 1) / 6 + 0.5), F.lit(0))
    return F.when(mean < 1, F.lit(0)).when(mean < EXACT_BELOW, few).otherwise(many).cast("long")


def count_replicates(counts: DataFrame, n: int, seed: int = 7, by: list[str] | None = None, places: int = 9) -> DataFrame:
    """``counts`` (by, p, pos, neg) with b (1 to n) and resampled pos and neg.

    A row of a table resampled with replacement counts a Poisson number of times,
    and the sum over equal rows is Poisson as well, so one draw for each
    distinct score, class and replicate stands for all its rows.
    """
    drawn = counts.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n))))
    key = lambda kind: F.concat_ws("-", *(by or []), F.round(F.col("p") * 10**places).cast("long").cast("string"), F.lit(kind), F.col("b").cast("string"))
    return drawn.withColumns({c: poisson(key(c), F.col(c), seed, "boot") for c in ("pos", "neg")}).where("pos + neg > 0")


def interval(df: DataFrame, value: str, by: list[str] | None = None, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return df.groupBy(*(by or [])).agg(F.count(value).alias("replicates"), F.avg(value).alias("mean"), F.percentile(value, a).alias("lo"), F.percentile(value, 1 - a).alias("hi"))


def prevalence(df: DataFrame, y: str = "y") -> float:
    """The share of ones, the threshold of a report; 0.5 for a table without labels."""
    share = df.agg(F.avg(F.col(y).cast("double"))).first()[0]
    return 0.5 if share is None else share


def report(df: DataFrame, threshold: float | None = None, by: list[str] | None = None, p: str = "p", y: str = "y", grid: int = 100, bins: int = 10) -> DataFrame:
    """One row per ``by``: counts and rates at the threshold, AUC, losses, ROC on a grid, calibration and a histogram.

    ``threshold`` is the prevalence unless given. Everything but the calibration
    curve's means comes from the counts of each distinct score.
    """
    by = by or []
    threshold = prevalence(df, y) if threshold is None else threshold
    counts = staged(score_counts(df, p, y, by), "score-counts")
    hit, pos, neg = F.col("p") > threshold, F.col("pos"), F.col("neg")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, c)), F.lit(0)).cast("long")
    table = counts.groupBy(*by).agg(total(pos, hit).alias("tp"), total(neg, hit).alias("fp"), total(pos, ~hit).alias("fn"), total(neg, ~hit).alias("tn"))
    bin_ = F.size(F.filter(uniform_edges(bins), lambda e: e < F.col("p"))).alias("bin")
    n = F.sum(pos + neg)
    curve = counts.groupBy(*by, bin_).agg(n.alias("n"), (F.sum(F.col("p") * (pos + neg)) / n).alias("mean_p"), (F.sum(pos) / n).alias("rate"))
    roc = roc_on_grid(roc_points(counts, by), grid, by)
    one = lambda d, name, *cols: d.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    parts = [rates(table), auc(counts, by), count_losses(counts, by), one(curve, "calibration", "bin", "n", "mean_p", "rate"), one(roc, "roc", "fpr", "tpr")]
    out = parts[0].withColumn("threshold", F.lit(float(threshold)))
    for part in parts[1:]:
        out = out.join(part, by) if by else out.crossJoin(part)
    return out


def calibration_band(rows: DataFrame, edges: Column, n: int, least: int = 5, seed: int = 7) -> DataFrame:
    """The calibration curve with intervals of its rate by bin; bins with fewer than ``least`` rows have none."""
    counts = staged(score_counts(rows), "score-counts")
    ends = interval(count_calibration(count_replicates(counts, n, seed), edges, ["b"]), "rate", ["bin"]).select("bin", "lo", "hi")
    keep = lambda c: F.when(F.col("n") >= least, F.col(c)).alias(c)
    return count_calibration(counts, edges).join(ends, "bin", "left").select("bin", "n", "mean_p", "rate", keep("lo"), keep("hi"))


def stage_intervals(scored: DataFrame, stages: list[str], n: int, seed: int = 7, places: int = 9, level: float = 0.95) -> DataFrame:
    """stage, split, auc, lo, hi of several scores of the same rows (``scored``: split, y and the stages).

    All stages see the same resamples: rows with equal scores in every stage, label
    and split share one Poisson draw for each replicate, and each stage then counts
    these weights by its own score. Only distinct tuples are drawn for.
    """
    rounded = [(F.round(s, places) + F.lit(0.0)).alias(s) for s in stages]
    tuples = staged(scored.select("split", "y", *rounded).groupBy("split", "y", *stages).agg(F.count("*").alias("n")), "stage-scores")
    key = F.concat_ws("-", "split", F.col("y").cast("string"), *[F.round(F.col(s) * 10**places).cast("long").cast("string") for s in stages], F.col("b").cast("string"))
    draws = tuples.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("w", poisson(key, F.col("n"), seed, "stages")).where("w > 0")

    def by_stage(rows: DataFrame, by: list[str], weight: str) -> DataFrame:
        long = rows.select("split", "y", *by, F.col(weight).alias("_w"), F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("p")) for s in stages])))
        keys = ["stage", "split", *by]
        return auc(score_counts(long, by=keys, weight=F.col("_w")), keys, 8)

    ends = interval(by_stage(draws, ["b"], "w"), "auc", ["stage", "split"], level).select("stage", "split", "lo", "hi")
    return by_stage(tuples, [], "n").join(ends, ["stage", "split"], "left")


STAGES, SPLITS = ("model", "model_nomogram", "network", "network_nomogram"), ("train", "test", "val")


def performance_summary(aucs: DataFrame, terms: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Every stage and split with auc, lo, hi (``aucs``: stage, split and these) and the stage's counts of terms; null where a stage is missing."""
    grid = aucs.sparkSession.createDataFrame([(s, p) for s in stages for p in SPLITS], "stage string, split string")
    out = grid.join(aucs, ["stage", "split"], "left").join(terms, "stage", "left")
    return out.select("stage", "split", "auc", "lo", "hi", "n_single", "n_pair", (F.col("n_single") + F.col("n_pair")).alias("n_terms"))


def density(df: DataFrame, bins: int = 20, by: list[str] | None = None, p: str = "p") -> DataFrame:
    """Share of scores per unit in equal bins on [0, 1], empty bins included only where another group of ``by`` fills them."""
    by = by or []
    n = df.groupBy(*by, F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))  # rows are bins by now
    return n.select(*by, "bin", (F.col("n") / total * bins).alias("density"))
