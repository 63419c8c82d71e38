"""Classifiers to explain: MLlib models, a one-hidden-layer network with a mask, and a point score card."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles
from ..functions.scalars import draw, sigmoid
from ..functions.storage import staged
from . import evaluate
from .score import with_callable, with_probability  # noqa: F401

MODELS = {
    "logreg": lambda **k: LogisticRegression(**{"maxIter": 100, "elasticNetParam": 0.0, **k}),
    "gbt": lambda **k: GBTClassifier(**{"maxDepth": 4, "maxIter": 280, "stepSize": 0.055, "subsamplingRate": 0.75, "featureSubsetStrategy": "0.65", "minInstancesPerNode": 9, "seed": 1, **k}),
    "forest": lambda **k: RandomForestClassifier(**{"numTrees": 250, "maxDepth": 8, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.6", "seed": 1, **k}),
}


#: Rows of a batch at which a network's rate is taken as it is; bins of scores that an epoch's AUC is told from.
BASE_BATCH, SKETCH = 1024, 512


#: Rows of a task that trees learn from: at most so many, and no fewer than LEAST_ROWS to keep all cores busy.
MOST_ROWS, LEAST_ROWS = 250_000, 50_000

#: Boosted trees learn from groups of equal rows where so many rows or more share one on average; trees between two stagings of their scores.
SHARED, STRIDE = 4, 20

#: Parameters that boosting on groups knows.
ON_GROUPS = {"maxDepth", "maxBins", "minInstancesPerNode", "minInfoGain", "maxIter", "stepSize", "seed", "subsamplingRate", "featureSubsetStrategy", "validationTol", "validationIndicatorCol"}


def dealt_evenly(df: DataFrame) -> DataFrame:
    """``df`` in tasks of about equal numbers of rows, which follow the table's size and not its files or shuffles."""
    n = df.count()
    return df.repartition(max(1, -(-n // MOST_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS)))


def rows_drawn(n: Column, row: Column, rate: float, rounds: int) -> Column:
    """How many of ``n`` equal rows take part in each round if every one is drawn for by itself; ``row`` is an md5."""

    @F.pandas_udf("array<long>")
    def run(count: pd.Series, md5: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng(int(m, 16)).binomial(c, rate, rounds) if c else np.zeros(rounds, int) for c, m in zip(count, md5)])

    return run(n, row)


def java_boosted(kind: str, uid: str, trees: list, weights: list[float]):
    """The sum of fitted trees times their weights as MLlib's own model, unwrapped: a round of boosting needs it once only."""
    gateway = SparkSession.active().sparkContext._gateway
    ml = gateway.jvm.org.apache.spark.ml
    members, shares = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees)), gateway.new_array(gateway.jvm.double, len(trees))
    for m, (tree, weight) in enumerate(zip(trees, weights)):
        members[m], shares[m] = tree, weight
    return (ml.classification.GBTClassificationModel if kind == "classes" else ml.regression.GBTRegressionModel)(uid, members, shares)


def boost_groups(groups: DataFrame, features: list[str], n: str, how: GBTClassifier) -> PipelineModel:
    """What ``how`` fits on rows, from distinct ones of which each stands for ``n`` equal ones.

    Equal rows have equal scores in every round, so a tree needs only how many
    of them were drawn for it. A leaf holds minInstancesPerNode drawn rows, not
    groups. Rounds, gradients and the early stop are MLlib's; its own sampling
    would take or leave a group as a whole. Scores are staged, and losses of the
    rows held back are summed, once for STRIDE trees; trees after the stop go.
    """
    stops = how.isDefined("validationIndicatorCol")
    held, y = F.col(how.getValidationIndicatorCol()) if stops else F.lit(False), F.col(how.getLabelCol())
    seed, least, most = how.getSeed(), how.getMinInstancesPerNode(), how.getMaxIter()
    shape = {"maxBins": how.getMaxBins(), "minInfoGain": how.getMinInfoGain(), "featureSubsetStrategy": how.getFeatureSubsetStrategy()}
    tree = RandomForestRegressor(featuresCol="_x", labelCol="_target", weightCol="_w", numTrees=1, bootstrap=False, **shape)
    key = F.concat_ws(":", *[F.col(f).cast("string") for f in features], y.cast("string"), held.cast("string"))
    x = VectorAssembler(inputCols=features, outputCol="_x")
    rows = x.transform(groups).select("_x", (2.0 * y - 1).alias("_sign"), held.alias("_held"), F.col(n).alias("_n"), key.alias("_key"), F.lit(0.0).alias("_score"))
    weights, trees, losses = [1.0] + [how.getStepSize()] * (most - 1), [], []

    def kept() -> tuple[int, bool]:
        """How many trees to keep, and whether a tree has not lowered the loss enough."""
        best, at = losses[0], 1
        for m, loss in enumerate(losses[1:], 2):
            if best - loss < how.getValidationTol() * max(loss, 0.01):
                return at, True
            best, at = min((best, at), (loss, m))
        return at, False

    def add(to: DataFrame, i: int, start: int) -> DataFrame:
        """``to`` with the sum of the trees from ``start`` up to the ``i``-th after it."""
        model = java_boosted("sums", f"{how.uid}-{start}-{i}", trees[start : start + i + 1], weights[start:])
        return DataFrame(model.setFeaturesCol("_x").setPredictionCol(f"_upto{i}").transform(to._jdf), to.sparkSession)

    while len(trees) < most and not (losses and kept()[1]):
        start, size = len(trees), min(STRIDE, most - len(trees))
        row = F.md5(F.concat_ws(":", "_key", F.lit(str(seed)), F.lit(f"trees-{start}")))
        drawn = rows_drawn(F.when(F.col("_held"), 0).otherwise(F.col("_n")), row, how.getSubsamplingRate(), size)
        rows = staged(rows.withColumn("_drawn", drawn), "boosted")
        totals = rows.agg(*[F.sum(F.col("_drawn")[i]) for i in range(size)]).first()
        for i, total in enumerate(totals):
            scored = add(rows, i - 1, start) if i else rows
            score = F.col("_score") + F.col(f"_upto{i - 1}") if i else F.col("_score")
            target = 4 * F.col("_sign") / (1 + F.exp(2 * F.col("_sign") * score)) if start + i else F.col("_sign")
            learn = scored.select("_x", target.alias("_target"), F.col("_drawn")[i].cast("double").alias("_w")).where("_w > 0")
            enough = total >= 2 * least
            tree.setSeed(seed + start + i).setMaxDepth(how.getMaxDepth() if enough else 0).setMinWeightFractionPerNode((least - 0.5) / total if enough else 0.0)
            trees.append(tree.fit(learn)._java_obj.trees()[0])
        for i in range(size) if stops else [size - 1]:
            rows = add(rows, i, start)
        if stops:
            z = [-2 * F.col("_sign") * (F.col("_score") + F.col(f"_upto{i}")) for i in range(size)]
            each = rows.where("_held").agg(*[2 * F.sum(F.col("_n") * (F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v))))) / F.sum("_n") for v in z])
            losses += [v for v in each.first() if v is not None]
        rows = rows.select("_x", "_sign", "_held", "_n", "_key", (F.col("_score") + F.col(f"_upto{size - 1}")).alias("_score"))
    n_kept = kept()[0] if losses else most
    return PipelineModel([x, GBTClassificationModel(java_boosted("classes", how.uid, trees[:n_kept], weights)).setFeaturesCol("_x")])


def fit_model(df: DataFrame, features: list[str], y: str, kind: str = "logreg", weight: str | None = None, **params: object):
    """A fitted pipeline. Boosted trees stop early where ``validationIndicatorCol`` names a boolean column.

    They then learn from the rows in which it is false and keep the trees up to
    the first that does not lower the loss of the others. A row stands for
    ``weight`` equal ones. Boosted trees take equal rows as groups where that
    saves most of them. Else trees pass over the rows for every level, so the
    columns they need are staged and dealt evenly first.
    """
    if kind == "gbt" and "validationIndicatorCol" in params:
        params = {"validationTol": 0.0, **params}
    model = MODELS[kind](featuresCol="_x", labelCol=y, **params)
    needed = [*features, y, *[params[c] for c in ("validationIndicatorCol", "weightCol") if c in params]]
    if kind == "gbt" and set(params) <= ON_GROUPS:
        counted = F.count("*") if weight is None else F.sum(weight)
        groups, weight = staged(df.groupBy(*needed).agg(counted.alias("_n")), "tree-groups"), "_n"
        n, k, known = groups.agg(F.sum("_n"), F.count("*"), F.every(F.coalesce(F.col(y).isin(0, 1), F.lit(False)))).first()
        if known and n >= SHARED * k:
            return boost_groups(staged(dealt_evenly(groups), "tree-groups"), features, "_n", model)
        df = groups
    if weight is not None:
        df = df.withColumn("_of", F.explode(F.sequence(F.lit(1).cast("long"), F.col(weight).cast("long"))))
    if kind != "logreg":
        df = dealt_evenly(staged(df.select(*needed), "tree-rows"))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), model]).fit(df)


@dataclass(frozen=True)
class Network:
    """tanh hidden layer, sigmoid output; scoring is a column expression."""

    features: list[str]
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logit(self, at: dict[str, Column]) -> Column:
        z = F.lit(float(self.b2))
        for h in range(len(self.w2)):
            s = F.lit(float(self.b1[h]))
            for k, f in enumerate(self.features):
                if self.w1[k, h]:
                    s = s + at[f] * float(self.w1[k, h])
            z = z + F.tanh(s) * float(self.w2[h])
        return z

    def score(self, at: dict[str, Column]) -> Column:
        return sigmoid(self.logit(at))


def fit_network(
    df: DataFrame, features: list[str], y: str, hidden: int = 6, mask: np.ndarray | None = None, epochs: int = 40, rate: float = 0.05, seed: int = 3,
    test: DataFrame | None = None, patience: int = 10, tolerance: float = 1e-5, history: list[dict] | None = None, batch: int | None = None, id_: str | None = None,
    weight: str | None = None,
) -> Network:
    """Adam: each step sums the gradient in the tasks; only weights travel.

    Equal rows of a batch are grouped once and count as often as they occur (or
    the sum of their ``weight``), which leaves every sum as it is over all rows.
    Without ``batch`` an epoch is one step over all rows. With it rows are dealt
    by a draw of ``id_`` to batches of about that many rows, written once in the
    order of batches, so that a step reads only its own; each epoch takes all
    batches in an order of its own, at ``rate`` times batch / BASE_BATCH.

    ``mask`` (features x hidden) is multiplied into the first layer after every
    step. Scale the features first. The loss of ``test`` (of ``df`` without one)
    decides: training stops when it has not fallen by ``tolerance`` for
    ``patience`` epochs, and a copy of the best epoch's weights is returned.
    ``history`` gets epoch, loss, test_loss, auc and test_auc, all before the
    epoch's steps; an AUC comes from SKETCH bins of scores that tasks count. A
    null AUC means that a class has no row.
    """
    rng = np.random.default_rng(seed)
    n_f = len(features)
    mask = np.ones((n_f, hidden)) if mask is None else mask
    hidden = mask.shape[1]
    shapes = [(n_f, hidden), (hidden,), (hidden,), (1,)]
    sizes = [int(np.prod(s)) for s in shapes]
    theta = np.concatenate([rng.normal(0, 0.4, sizes[0]), np.zeros(sizes[1]), rng.normal(0, 0.4, sizes[2]), np.zeros(1)])
    cuts = np.cumsum(sizes)[:-1]
    theta[: sizes[0]] *= mask.ravel()
    counted = F.lit(1).cast("long") if weight is None else F.col(weight)
    n_batches = None if batch is None else max(1, -(-(df.agg(F.sum(counted)).first()[0] or 0) // batch))
    dealt = F.lit(0).cast("long") if batch is None else draw(F.col(id_), seed, "batch") % n_batches
    pick = lambda d, held, at: d.select(*[F.col(f).cast("double") for f in features], F.col(y).cast("double").alias("_y"), F.lit(held).alias("_held"), at.alias("_batch"), counted.alias("_w"))
    rows = pick(df, False, dealt)
    rows = rows if test is None else rows.unionByName(pick(test, True, F.lit(-1).cast("long")))
    rows = rows.groupBy(*features, "_y", "_held", "_batch").agg(F.sum("_w").alias("_w"))
    rows = staged(rows, "network-rows").persist() if batch is None else staged(rows.repartitionByRange("_batch").sortWithinPartitions("_batch"), "network-batches")
    m, v, best, waited = np.zeros_like(theta), np.zeros_like(theta), (np.inf, theta.copy()), 0

    def partial(weights: np.ndarray):
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w1, b1, w2, b2 = (x.reshape(s) for x, s in zip(np.split(weights, cuts), shapes))
            g, loss, n, bins = np.zeros_like(weights), np.zeros(2), np.zeros(2, int), np.zeros(4 * SKETCH, int)
            for pdf in it:
                x, t, held, w = pdf[features].to_numpy(), pdf["_y"].to_numpy(), pdf["_held"].to_numpy(bool), pdf["_w"].to_numpy()
                h = np.tanh(x @ w1 + b1)
                p = 1 / (1 + np.exp(-(h @ w2 + b2[0])))
                d = np.where(held, 0.0, w * (p - t))
                back = np.outer(d, w2) * (1 - h * h)
                g += np.concatenate([(x.T @ back).ravel(), back.sum(0), h.T @ d, [d.sum()]])
                q = np.clip(p, 1e-12, 1 - 1e-12)
                each = -w * (t * np.log(q) + (1 - t) * np.log(1 - q))
                loss += [each[~held].sum(), each[held].sum()]
                n += [int(w[~held].sum()), int(w[held].sum())]
                np.add.at(bins, (2 * held + (t > 0.5)) * SKETCH + np.minimum((p * SKETCH).astype(int), SKETCH - 1), w)
            yield pd.DataFrame({"g": [g.tolist()], "loss": [loss.tolist()], "n": [n.tolist()], "bins": [bins.tolist()]})

        return run

    def measured(of: DataFrame) -> tuple[np.ndarray, ...]:
        parts = of.mapInPandas(partial(theta), "g array<double>, loss array<double>, n array<long>, bins array<long>").collect()  # one row per task
        return tuple(sum((np.array(r[c]) for r in parts), np.zeros(size)) for c, size in (("g", len(theta)), ("loss", 2), ("n", 2), ("bins", 4 * SKETCH)))

    def binned_auc(neg: np.ndarray, pos: np.ndarray) -> float | None:
        return float((pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum())) if pos.sum() and neg.sum() else None

    step = 0
    for epoch in range(1, epochs + 1):
        g, loss, n, bins = measured(rows)
        if not n[0]:
            break
        loss = loss / np.maximum(n, 1)
        judged = float(loss[1] if n[1] else loss[0])
        if history is not None:
            neg, pos, held_neg, held_pos = bins.reshape(4, SKETCH)
            history.append({"epoch": epoch, "loss": float(loss[0]), "test_loss": float(loss[1]) if n[1] else None, "auc": binned_auc(neg, pos), "test_auc": binned_auc(held_neg, held_pos)})
        waited = 0 if judged < best[0] - tolerance else waited + 1
        if judged < best[0]:
            best = (judged, theta.copy())
        if waited > patience:
            break
        for k in [None] if batch is None else rng.permutation(n_batches).tolist():
            if k is not None:
                g, _, n, _ = measured(rows.where(F.col("_batch") == k))
            if not n[0]:
                continue
            step, g = step + 1, g / n[0]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (1 if batch is None else batch / BASE_BATCH) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            theta[: sizes[0]] *= mask.ravel()
    if batch is None:
        rows.unpersist()
    w1, b1, w2, b2 = (x.reshape(s) for x, s in zip(np.split(best[1], cuts), shapes))
    return Network(features, w1, b1, w2, float(b2[0]))


def random_search(
    train: DataFrame, test: DataFrame, features: list[str], y: str, kind: str, ranges: dict[str, list | tuple], trials: int = 4, seed: int = 1, metric: str = "auc", parallel: int = 2
) -> DataFrame:
    """trial, params (JSON), metric, value, best: the defaults as trial 0, then seeded draws.

    A range is a list of choices or (low, high, "log" | "int" | "float"). ``train`` and
    ``test`` must be separate. Trials run a few at a time on persisted data.
    """
    rng = np.random.default_rng(seed)

    def drawn(r: list | tuple) -> object:
        if isinstance(r, list):
            return r[int(rng.integers(len(r)))]
        lo, hi, how = r
        return int(rng.integers(lo, hi + 1)) if how == "int" else float(np.exp(rng.uniform(np.log(lo), np.log(hi)))) if how == "log" else float(rng.uniform(lo, hi))

    tried = [{} if t == 0 else {k: drawn(r) for k, r in ranges.items()} for t in range(trials)]
    train, test = train.persist(), test.persist()

    def value(params: dict) -> float:
        scored = with_probability(fit_model(train, features, y, kind, **params), test)
        if metric == "auc":
            return evaluate.auc(evaluate.score_counts(scored, "p", y)).first()["auc"]
        if metric == "accuracy":
            return evaluate.confusion(scored, 0.5, p="p", y=y).first()["accuracy"]
        return evaluate.losses(scored, p="p", y=y).first()[metric]

    with ThreadPoolExecutor(parallel) as pool:
        values = list(pool.map(value, tried))
    train.unpersist()
    test.unpersist()
    out = train.sparkSession.createDataFrame([(t, json.dumps(p, sort_keys=True), metric, v) for t, (p, v) in enumerate(zip(tried, values))], "trial int, params string, metric string, value double")
    top = F.max if metric in ("auc", "accuracy") else F.min
    best = out.agg(top("value").alias("v")).first()["v"]
    first = next((t for t, v in enumerate(values) if v == best), None)
    return out.withColumn("best", F.col("trial") == F.lit(first))


def save_trials(trials: DataFrame, path: str) -> None:
    trials.write.mode("overwrite").parquet(path)


def best_parameters(spark, path: str) -> dict[str, object]:
    """The parameters of the best stored trial."""
    row = spark.read.parquet(path).where("best").select("params").first()
    if row is None:
        raise ValueError(f"no best trial in {path}")
    return json.loads(row["params"])


@dataclass(frozen=True)
class Rule:
    """Points and log-odds for values in [lo, hi) of a column."""

    column: str
    lo: float | None
    hi: float | None
    points: float
    log_odds: float


def score_card(df: DataFrame, rules: list[Rule], intercept: float, per_point: float = 0.13, at_zero: float = -2.75, groups: dict[str, tuple[list[str], bool]] | None = None) -> DataFrame:
    """Adds points, p (from log-odds) and p_points (from points); missing columns are an error.

    ``groups`` are dummies of which a row has at most one, or exactly one where
    the flag beside them says that the reference is among them.
    """
    for g, (members, exact) in (groups or {}).items():
        total = sum((F.col(m) for m in members[1:]), F.col(members[0]))
        wrong = (total != 1) if exact else (total > 1)
        df = df.where(F.when(wrong, F.raise_error(F.lit(f"dummies of {g} do not add up")).cast("boolean")).otherwise(F.lit(True)))
    missing = {r.column for r in rules} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    pts, odds = F.lit(0.0), F.lit(float(intercept))
    for r in rules:
        x = F.col(r.column)
        hit = (x >= r.lo if r.lo is not None else F.lit(True)) & (x < r.hi if r.hi is not None else F.lit(True))
        pts = pts + F.when(hit, r.points).otherwise(0.0)
        odds = odds + F.when(hit, r.log_odds).otherwise(0.0)
    return df.withColumns({"points": pts, "p": sigmoid(odds), "p_points": sigmoid(per_point * pts + at_zero)})


def overwrite_labels(df: DataFrame, p: str, y: str) -> DataFrame:
    """Labels as the classifier sees them: 1 from the (1 - prevalence) quantile of its scores."""
    share = df.agg(F.avg(y)).first()[0]
    cut = exact_percentiles(df, [p], [1 - share])[p][0]
    return df.withColumn("label", (F.col(p) >= cut).cast("int"))


def seeded_sample(df: DataFrame, id_: str, share: float, seed: int = 1) -> DataFrame:
    return df.where(draw(F.col(id_), seed, "sample") < int(share * (1 << 32)))
