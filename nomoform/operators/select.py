"""L1 path: fits, metrics of a path, and the rules that pick one lambda from it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rounded, sigmoid
from ..functions.storage import staged
from .evaluate import auc, count_losses, score_counts

THRESHOLD = 0.1


def lambda_path(n: int = 100, high: float = 1000.0, low: float = 0.001) -> list[float]:
    return [math.exp(math.log(high) + (math.log(low) - math.log(high)) * i / (n - 1)) for i in range(n)]


def tallied(rows: DataFrame, cols: list[str], weight: str | None = None) -> DataFrame:
    """The distinct rows of ``cols`` with w, how many there are (or the sum of ``weight``): sums over them are sums over all rows."""
    return rows.groupBy(*cols).agg((F.count("*") if weight is None else F.sum(weight)).alias("w"))


@dataclass(frozen=True)
class Slopes:
    """What one pass over the rows gives at some coefficients: loss, its gradient and, for ``terms``, its second derivatives.

    Position 0 is the intercept, position k + 1 is term k.
    """

    loss: float
    gradient: np.ndarray
    terms: np.ndarray
    hessian: np.ndarray


def path_slopes(rows: DataFrame, at: list[np.ndarray], terms: np.ndarray) -> list[Slopes]:
    """One pass over ``rows`` (x, y, w) at several coefficients; only sums leave a task."""
    d, k = len(at[0]), len(terms)
    width = 1 + d + k * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(at), width))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.c_[np.ones(batch.num_rows), np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, d - 1)]
            y, w = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            some = x[:, terms]
            for own, b in zip(out, at):
                z = x @ b
                p = 1 / (1 + np.exp(-z))
                own[0] += w @ (np.logaddexp(0, z) - y * z)
                own[1 : 1 + d] += x.T @ (w * (p - y))
                own[1 + d :] += (some.T @ (some * (w * p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], ["i", "v"])

    sums = dict(map(tuple, rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect()))
    each = np.array([sums[i] for i in range(len(at) * width)]).reshape(len(at), width)
    return [Slopes(float(v[0]), v[1 : 1 + d], terms, v[1 + d :].reshape(k, k)) for v in each]


def l1_step(at: Slopes, b: np.ndarray, lam: float, sweeps: int = 1000) -> np.ndarray:
    """The minimum of the quadratic model of the loss around ``b`` plus lam times the betas, over the terms of ``at``.

    Coordinate descent finds signs; for these signs the minimum is a linear
    system, which is solved when descent is slow.
    """
    g, h, start = at.gradient[at.terms], at.hessian + 1e-12 * np.eye(len(at.terms)), b[at.terms]
    free = at.terms == 0
    now, slope = start.copy(), g.copy()  # slope: g + h @ (now - start)
    for sweep in range(sweeps):
        moved = 0.0
        for j in range(len(now)):
            if h[j, j] <= 1e-11:
                continue
            want = now[j] - slope[j] / h[j, j]
            new = want if free[j] else np.sign(want) * max(abs(want) - lam / h[j, j], 0.0)
            if new != now[j]:
                moved = max(moved, abs(new - now[j]) * h[j, j])
                slope += h[:, j] * (new - now[j])
                now[j] = new
        if moved <= 1e-7 * lam:
            break
        if sweep % 20 == 19:
            on = np.flatnonzero(free | (now != 0))
            solved = np.zeros_like(now)
            rest = g[on] - h[np.ix_(on, range(len(now)))] @ start + lam * np.where(free[on], 0.0, np.sign(now[on]))
            solved[on] = np.linalg.lstsq(h[np.ix_(on, on)], -rest, rcond=None)[0]
            if (free[on] | (np.sign(solved[on]) == np.sign(now[on]))).all():
                now, slope = solved, g + h @ (solved - start)
    out = b.copy()
    out[at.terms] = now
    return out


def missed(gradient: np.ndarray, b: np.ndarray, lam: float) -> np.ndarray:
    """By how much each position misses the conditions of the minimum, as a share of lam."""
    off = np.where(b != 0, np.abs(gradient + lam * np.sign(b)), np.maximum(np.abs(gradient) - lam, 0.0))
    off[0] = abs(gradient[0])
    return off / lam


#: Lambdas whose coefficients one pass tries.
AHEAD = 4


def fit_path(
    df: DataFrame, phis: str, y: str, lambdas: list[float], max_terms: int = 100, batch: int = 10, tolerance: float = 5e-4, passes: list[dict] | None = None, most_passes: int = 50,
    weight: str | None = None,
) -> DataFrame:
    """lambda_idx, lambda, intercept, betas: the minimum of the summed loss plus lambda times the betas, per lambda.

    Rows are grouped by their responses once. Every lambda starts from the fit
    before it: the sums of the last pass predict the coefficients of the next AHEAD
    lambdas, and one pass at all of these gives the slopes that confirm them, or
    else correct the first that fails by another Newton step, halved where the
    objective rose. Second derivatives are summed only for terms that the
    sequential strong rule lets in, |slope| >= 2 * lambda - the lambda before,
    and for those that the slopes of all terms, known from every pass, show to be
    missing. ``tolerance`` is the share of lambda by which a fit may miss the
    conditions of its minimum. ``passes`` gets lambda_idx and the number of terms
    of each pass. The path ends after the batch in which any lambda has enough
    terms. A table without rows has no path; responses are never null. A row
    counts ``weight`` times, once without it.
    """
    rows = tallied(df, [phis, y], weight).select(F.col(phis).alias("x"), F.col(y).cast("double").alias("y"), F.col("w").cast("double").alias("w"))
    rows = staged(rows, "path-rows").persist()
    totals = rows.agg(F.sum("w"), F.sum(F.col("w") * F.col("y")), F.max(F.size("x"))).first()
    out, counts = [], []
    if totals[0]:
        share = min(max(totals[1] / totals[0], 1e-9), 1 - 1e-9)
        b = np.r_[math.log(share / (1 - share)), np.zeros(totals[2])]

        def visit(at: list[np.ndarray], terms: np.ndarray) -> list[Slopes]:
            if passes is not None:
                passes.append({"lambda_idx": len(out), "terms": len(terms)})
            return path_slopes(rows, at, terms)

        def worth(at: Slopes, b: np.ndarray, lam: float) -> float:
            return at.loss + lam * float(np.abs(b[1:]).sum())

        def settle(lam: float, b: np.ndarray) -> bool:
            """Keep a lambda's fit; whether the path ends with it."""
            out.append((len(out), lam, float(b[0]), [float(v) for v in b[1:]]))
            counts.append(int((np.abs(b[1:]) > THRESHOLD).sum()))
            return len(out) == len(lambdas) or (len(out) % batch == 0 and max(counts[-batch:]) >= max_terms)

        here = visit([b], np.array([0]))[0]
        before, tried = max(float(np.abs(here.gradient[1:]).max(initial=0.0)), *lambdas[:1], 0.0), 0
        over = not lambdas
        while not over:
            lam = lambdas[len(out)]
            if (missed(here.gradient, b, lam) <= tolerance).all():
                over, before, tried = settle(lam, b), lam, 0
                continue
            if (tried := tried + 1) > most_passes:
                raise ArithmeticError(f"lambda {lam} did not settle")
            ahead = lambdas[len(out) : len(out) + AHEAD]
            strong = (np.abs(here.gradient) >= 2 * ahead[-1] - before) | (b != 0) | (missed(here.gradient, b, lam) > tolerance)
            strong[0] = True
            wanted = np.flatnonzero(strong)
            if not np.isin(wanted, here.terms).all():
                here = visit([b], wanted)[0]
            news = [l1_step(here, b, x) for x in ahead]
            found = visit(news, wanted)
            limit = worth(here, b, lam)
            while worth(found[0], news[0], lam) > limit + 1e-9 * abs(limit) and np.abs(news[0] - b).max() > 1e-15:
                news = [(b + news[0]) / 2]
                found = visit(news, wanted)
            b, here = news[0], found[0]
            for x, new, there in zip(ahead[1:], news[1:], found[1:]):
                if over or (missed(here.gradient, b, lam) > tolerance).any() or worth(there, new, x) > worth(here, b, x) * (1 + 1e-9):
                    break
                over = settle(lam, b)
                b, here, before, lam, tried = new, there, lam, x, 0
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "lambda_idx int, lambda double, intercept double, betas array<double>")


def score_path(rows: DataFrame, path: DataFrame, phis: str = "phis") -> DataFrame:
    """Rows by lambda with p; the path is a short table by construction."""
    dot = F.aggregate(F.zip_with(phis, "betas", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.crossJoin(F.broadcast(path)).withColumn("p", sigmoid(F.col("intercept") + dot))


def path_metrics(rows: DataFrame, path: DataFrame, phis: str = "phis", y: str = "y", places: int = 9, weight: str | None = None) -> DataFrame:
    """lambda_idx, auc, log_loss, brier of every lambda on ``rows``, of which equal ones are scored once.

    Scores are counted to ``places`` decimals, so that sums in another order tie
    alike. A row counts ``weight`` times, once without it.
    """
    scored = score_path(tallied(rows, [phis, y], weight), path, phis).withColumn("p", rounded(F.col("p"), places))
    counts = staged(score_counts(scored, "p", y, ["lambda_idx"], F.col("w")), "path-counts")
    return auc(counts, ["lambda_idx"]).join(count_losses(counts, ["lambda_idx"]), "lambda_idx")


def term_counts(path: DataFrame, n_single: int, threshold: float = THRESHOLD) -> DataFrame:
    big = lambda lo, hi: F.size(F.filter(F.slice("betas", lo, hi), lambda b: F.abs(b) > threshold)).cast("long")
    return path.select("lambda_idx", big(1, n_single).alias("n_single"), big(n_single + 1, 10_000).alias("n_pair"))


def _first(path: DataFrame, ok: Column) -> DataFrame:
    return path.where(ok).agg(F.min("lambda_idx").alias("lambda_idx"))


def non_empty(path: DataFrame, pick: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pick, or the first lambda with a term if the pick has none."""
    has = F.exists("betas", lambda b: F.abs(b) > threshold)
    one = path.join(F.broadcast(pick), "lambda_idx").where(has).agg(F.min("lambda_idx").alias("a"))
    two = path.where(has).agg(F.min("lambda_idx").alias("b"))
    none = F.raise_error(F.lit("no lambda of the path has a term")).cast("int")
    return one.crossJoin(two).select(F.coalesce("a", "b", none).alias("lambda_idx"))


def _best(path: DataFrame) -> DataFrame:
    return path.withColumn("_best", F.max("auc").over(Window.partitionBy()))


def select_max_auc(path: DataFrame, ratio: float = 0.99) -> DataFrame:
    """The sparsest lambda with at least this share of the best AUC."""
    return non_empty(path, _first(_best(path), F.col("auc") >= ratio * F.col("_best")))


def select_min_auc(path: DataFrame, min_auc: float, ratio: float = 0.99) -> DataFrame:
    a = _first(path, F.col("auc") >= min_auc).withColumnRenamed("lambda_idx", "a")
    b = _first(_best(path), F.col("auc") >= ratio * F.col("_best")).withColumnRenamed("lambda_idx", "b")
    return non_empty(path, a.crossJoin(b).select(F.coalesce("a", "b").alias("lambda_idx")))


def select_non_inferiority(path: DataFrame, ni: float = 0.05, reference: float | None = None, ratio: float = 0.99) -> DataFrame:
    """The first lambda within ``ni`` of the reference AUC's distance to one half."""
    ref = F.col("_best") if reference is None else F.lit(reference)
    a = _first(_best(path), F.col("auc") >= ref - ni * (ref - 0.5)).withColumnRenamed("lambda_idx", "a")
    b = _first(_best(path), F.col("auc") >= ratio * F.col("_best")).withColumnRenamed("lambda_idx", "b")
    return non_empty(path, a.crossJoin(b).select(F.coalesce("a", "b").alias("lambda_idx")))


def select_by_features(path: DataFrame, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """The count of terms that is closest to ``n``, the best AUC among those, the first of equals."""
    k = F.size(F.filter("betas", lambda b: F.abs(b) > threshold))
    near = path.withColumn("_off", F.abs(k - n)).withColumn("_k", k)
    first = near.orderBy("_off", "lambda_idx").limit(1).select(F.col("_k").alias("_want"))
    best = near.join(F.broadcast(first), F.col("_k") == F.col("_want")).orderBy(F.desc("auc"), "lambda_idx").limit(1)
    return non_empty(path, best.select("lambda_idx"))


def select_by_index(path: DataFrame, idx: int) -> DataFrame:
    n = path.count()
    if not 0 <= idx < n:
        raise IndexError(f"lambda index {idx} of {n}")
    return non_empty(path, path.where(F.col("lambda_idx") == idx).select("lambda_idx"))


def selected_terms(path: DataFrame, pick: DataFrame, names: list[str], threshold: float = THRESHOLD) -> DataFrame:
    chosen = path.join(F.broadcast(pick), "lambda_idx").select(F.posexplode("betas").alias("term", "beta")).where(F.abs("beta") > threshold)
    return chosen.withColumn("name", F.get(F.array(*map(F.lit, names)), F.col("term")))


def selection_mask(chosen: DataFrame, pairs: dict[int, tuple[int, int]], n_features: int, nodes: int = 5) -> DataFrame:
    """feature, node: which hidden nodes of a masked network see which feature; ``nodes`` for each term."""
    both = {i: (i,) for i in range(n_features)} | pairs
    of = F.element_at(F.create_map(*[x for t, fs in both.items() for x in (F.lit(t), F.array(*map(F.lit, fs)))]), F.col("term"))
    rank = F.row_number().over(Window.orderBy("term")) - 1  # over the selected terms, a few
    return chosen.withColumn("_r", rank).select(F.explode(of).alias("feature"), "_r").select("feature", F.explode(F.sequence(F.col("_r") * nodes, F.col("_r") * nodes + nodes - 1)).alias("node"))


def mask_terms(chosen: set[int], pairs: dict[int, tuple[int, int]], groups: list[list[int]] | None = None, strict_pairs: bool = False, add_singles: bool = False) -> list[tuple[int, tuple[int, ...]]]:
    """Terms of a mask and the features each sees.

    ``strict_pairs`` keeps a pair only if both of its single terms are chosen,
    ``add_singles`` adds the single terms of every pair, and a feature of a group of
    dummies brings the whole group.
    """
    terms = {t for t in chosen if not (strict_pairs and t in pairs and not set(pairs[t]) <= chosen)}
    if add_singles:
        terms |= {f for t in terms if t in pairs for f in pairs[t]}
    whole = {f: tuple(g) for g in groups or [] for f in g}
    seen = lambda t: pairs.get(t, (t,))
    return [(t, tuple(sorted({x for f in seen(t) for x in whole.get(f, (f,))}))) for t in sorted(terms)]


def thresholded(path: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The path with small coefficients set to 0; intercepts stay."""
    return path.withColumn("betas", F.transform("betas", lambda b: F.when(F.abs(b) <= threshold, 0.0).otherwise(b)))


def mixed_pairs(catalogue: DataFrame, pairs: dict[int, tuple[int, int]]) -> DataFrame:
    """term and whether exactly one of its features is categorical; ``catalogue``: idx, kind."""
    table = catalogue.sparkSession.createDataFrame([(t, i, j) for t, (i, j) in pairs.items()], "term int, i int, j int")
    kind = lambda x: F.broadcast(catalogue.select(F.col("idx").alias(x), (F.col("kind") == "categorical").alias(f"{x}_cat")))
    return table.join(kind("i"), "i").join(kind("j"), "j").select("term", "i", "j", (F.col("i_cat") != F.col("j_cat")).alias("mixed"))


#: What must agree before a stored selection is used again.
SETTINGS = ("model", "method", "rule", "value", "threshold", "n_lambdas", "max_terms")


def compare_settings(stored: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """field, stored, wanted, same for each of SETTINGS; ``stored`` is one row."""
    rows = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("stored"), F.lit(None if wanted.get(f) is None else str(wanted[f])).alias("wanted")) for f in SETTINGS]
    return stored.select(F.inline(F.array(*rows))).withColumn("same", F.col("stored").eqNullSafe(F.col("wanted")))


def coefficient_bars(path: DataFrame, idx: int, least: float = 1e-3) -> DataFrame:
    """term, beta, rank of one lambda's coefficients beyond ``least``, the largest first."""
    long = path.where(F.col("lambda_idx") == idx).select(F.posexplode("betas").alias("term", "beta")).where(F.abs("beta") > least)
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round(F.abs("beta"), 9)), "term")))  # one lambda's terms


def path_table(path: DataFrame) -> DataFrame:
    """lambda_idx, lambda, term, beta: what a path plot shows."""
    return path.select("lambda_idx", "lambda", F.posexplode("betas").alias("term", "beta"))
