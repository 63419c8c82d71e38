"""The whole chain: a score's responses, an L1 choice of them, a network masked to that choice, and its responses again."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid
from ..functions.storage import staged
from . import decompose, evaluate, select, train
from .encode import fit_scaler
from .score import FrameScorer, column_scorer


@dataclass(frozen=True)
class Phase:
    """Responses of one score, the fitted path over them, and the additive model that a rule chose from it."""

    responses: DataFrame
    path: DataFrame
    lambda_idx: int
    intercept: float
    betas: dict[int, float]


def with_arrays(rows: DataFrame, features: list[str], responses: DataFrame) -> DataFrame:
    """``rows`` with phis, the responses of all terms in order; made once per distinct tuple of features."""
    tuples = rows.select(*features).distinct().withColumn("_key", F.struct(*features))
    long = decompose.to_rows(tuples, ["_key"], features, responses)
    each = long.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("term", "phi"))).alias("s"))
    phis = each.select("_key.*", F.transform("s", lambda x: x["phi"]).alias("phis"))
    return rows.join(phis, features)


def nomogram_phase(parts: DataFrame, features: list[str], scorer: FrameScorer, lambdas: list[float], ratio: float = 0.99, max_terms: int = 100) -> tuple[Phase, DataFrame]:
    """A phase fitted on the training part and chosen on the test part, and ``parts`` with p_sum, its probability.

    ``parts``: split (train, test, val), y, the features as doubles and w, how many rows are equal. The
    background is the training part; responses cover the values of all parts.
    """
    which = decompose.terms(features)
    fit = parts.where("split = 'train'")
    grid = decompose.value_grid(decompose.background(parts, features), which)
    responses = staged(decompose.lebesgue(fit, features, scorer, grid, weight="w"), "phase-responses")
    rows = staged(with_arrays(parts, features, responses), "phase-rows")
    path = staged(select.fit_path(rows.where("split = 'train'"), "phis", "y", lambdas, max_terms, weight="w"), "phase-path")
    test = select.path_metrics(rows.where("split = 'test'"), path, weight="w")
    pick = select.select_max_auc(path.join(F.broadcast(test), "lambda_idx"), ratio).first()["lambda_idx"]
    row = path.where(F.col("lambda_idx") == pick).first()  # one lambda's coefficients
    betas = {t: b for t, b in enumerate(row["betas"]) if abs(b) > select.THRESHOLD}
    total = sum((F.get("phis", F.lit(t)) * b for t, b in betas.items()), F.lit(row["intercept"]))
    return Phase(responses, path, pick, row["intercept"], betas), rows.withColumn("p_sum", sigmoid(total)).drop("phis")


def two_phases(
    parts: DataFrame, features: list[str], scorer: FrameScorer, lambdas: list[float], nodes: int = 5, epochs: int = 60, network_lambdas: list[float] | None = None
) -> tuple[Phase, Phase, DataFrame]:
    """Both phases and every row with p of the four stages.

    All stages work on the distinct rows of split, y and the features with their
    counts; only the scaler and the scores joined back at the end see all rows.
    Features are scaled by the training part for the network; its score and the
    first one see the same values, as the scaling is part of the network's scorer.
    """
    parts = parts.withColumns({f: F.col(f).cast("double") + F.lit(0.0) for f in features})
    groups = staged(select.tallied(parts, ["split", "y", *features]), "phase-groups")
    first, rows = nomogram_phase(groups, features, scorer, lambdas)
    pairs = {t: (features.index(a), features.index(b)) for t, a, b in decompose.terms(features) if b}
    seen = select.mask_terms(set(first.betas), pairs)
    mask = np.zeros((len(features), nodes * len(seen)))
    for k, (_, fs) in enumerate(seen):
        mask[list(fs), k * nodes : (k + 1) * nodes] = 1
    scaler = fit_scaler(parts.where("split = 'train'"), features)
    scaled = scaler.transform(groups)
    net = train.fit_network(scaled.where("split = 'train'"), features, "y", mask=mask, epochs=epochs, test=scaled.where("split = 'test'"), weight="w")
    at = lambda v: {f: (v[f] - scaler.fitted[f][0]) / (scaler.fitted[f][1] * scaler.sd_scale) if f in scaler.fitted else v[f] for f in features}
    network = column_scorer(features, lambda v: net.score(at(v)))
    rows = network.add(scorer.add(rows.withColumnRenamed("p_sum", "model_nomogram")).withColumnRenamed("p", "model")).withColumnRenamed("p", "network")
    second, out = nomogram_phase(staged(rows, "phase-scores"), features, network, network_lambdas or lambdas)
    scores = staged(out.withColumnRenamed("p_sum", "network_nomogram").dropDuplicates(features).select(*features, *evaluate.STAGES), "phase-stages")
    return first, second, parts.join(scores, features)


def summary(scored: DataFrame, first: Phase, second: Phase, n_features: int, replicates: int = 100) -> DataFrame:
    """AUC with its interval for every stage and split, and the counts of terms of the two additive stages."""
    aucs = evaluate.stage_intervals(scored, list(evaluate.STAGES), replicates)
    single = lambda p: sum(t < n_features for t in p.betas)
    counts = [(s, single(p), len(p.betas) - single(p)) for s, p in (("model_nomogram", first), ("network_nomogram", second))]
    terms = scored.sparkSession.createDataFrame(counts, "stage string, n_single int, n_pair int")
    return evaluate.performance_summary(aucs, terms)


def kkt(rows: DataFrame, path: DataFrame, phis: str = "phis", y: str = "y", n_terms: int = 1, weight: str | None = None) -> DataFrame:
    """lambda_idx, lambda and off: by how much, as a share of its lambda, a fit misses the conditions of its minimum.

    The slope of the summed loss must be lambda against the sign of a term that
    is in, at most lambda for one that is not, and nothing for the intercept.
    Equal rows are scored once; a row counts ``weight`` times, once without it.
    """
    scored = select.score_path(select.tallied(rows, [phis, y], weight), path, phis)
    slope = lambda x: F.sum(F.col("w") * (F.col("p") - F.col(y)) * x)
    agg = scored.groupBy("lambda_idx", "lambda", "betas").agg(F.array(*[slope(F.get(phis, F.lit(k))) for k in range(n_terms)]).alias("g"), F.abs(slope(F.lit(1.0))).alias("g0"))
    miss = F.transform(F.arrays_zip("g", "betas"), lambda z: F.when(z["betas"] != 0, F.abs(z["g"] + F.col("lambda") * F.signum(z["betas"]))).otherwise(F.greatest(F.abs(z["g"]) - F.col("lambda"), F.lit(0.0))))
    return agg.select("lambda_idx", "lambda", (F.greatest(F.array_max(miss), "g0") / F.col("lambda")).alias("off"))
