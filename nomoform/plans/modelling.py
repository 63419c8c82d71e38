"""Queries of evaluation and of fitted models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..functions.storage import staged
from ..operators import encode, evaluate, profile, select, split, train
from .frames import LI_FEATURES, SLI, SOC, draw_sql, labelled_li, li, r6, scored_li, scored_oc
from .registry import query
from .tabular import tidy


def auc_sql(src: str, by: str = "") -> str:
    part, keys = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"(SELECT {keys}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (cum - neg / 2)) / (sum(pos) * sum(neg)) END AS auc FROM (SELECT *, sum(neg) OVER ({part} ORDER BY p) AS cum FROM {src}) {group})"


_G = ", g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM sli GROUP BY p)"


@query("WITH " + SLI + _G + f" SELECT {r6('auc')} AS auc FROM {auc_sql('g')}")
def auc(spark, sf):
    return tidy(evaluate.auc(evaluate.score_counts(scored_li(spark, sf))))


_ROC = ", ro AS (SELECT p, sum(neg) OVER (ORDER BY p DESC) / (SELECT sum(neg) FROM g) AS fpr, sum(pos) OVER (ORDER BY p DESC) / (SELECT sum(pos) FROM g) AS tpr FROM g)"


@query("WITH " + SLI + _G + _ROC + f" SELECT p, {r6('fpr')} AS fpr, {r6('tpr')} AS tpr FROM ro")
def roc_points(spark, sf):
    return evaluate.roc_points(evaluate.score_counts(scored_li(spark, sf))).select("p", rounded(F.col("fpr")).alias("fpr"), rounded(F.col("tpr")).alias("tpr"))


def grid_sql(src: str, by: str = "") -> str:
    k, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    zero = f"SELECT DISTINCT {k}0.0 AS fpr, 0.0 AS tpr FROM {src}"
    return (
        f"(SELECT {k}k::INT AS k, k / 20.0 AS fpr, CASE WHEN fpr2 IS NULL OR fpr2 = fpr THEN hi ELSE hi + (lo2 - hi) / (fpr2 - fpr) * (k / 20.0 - fpr) END AS tpr FROM "
        f"(SELECT {k}fpr, hi, lead(fpr) OVER ({part} ORDER BY fpr) AS fpr2, lead(lo) OVER ({part} ORDER BY fpr) AS lo2 FROM (SELECT {k}fpr, max(tpr) AS hi, min(tpr) AS lo FROM (SELECT {k}fpr, tpr FROM {src} UNION ALL {zero}) GROUP BY {k}fpr)) s, range(21) r(k) "
        "WHERE k >= ceil(round(fpr * 20, 9)) AND (fpr2 IS NULL OR k < ceil(round(fpr2 * 20, 9))))"
    )


@query("WITH " + SLI + _G + _ROC + f" SELECT k, {r6('fpr')} AS fpr, {r6('tpr')} AS tpr FROM {grid_sql('ro')}")
def roc_on_grid(spark, sf):
    return tidy(evaluate.roc_on_grid(evaluate.roc_points(evaluate.score_counts(scored_li(spark, sf))), 21))


_CONF = "count_if(h AND y = 1) AS tp, count_if(h AND y = 0) AS fp, count_if(NOT h AND y = 1) AS fn, count_if(NOT h AND y = 0) AS tn"
_RATE = f"tp, fp, fn, tn, {r6('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, CASE WHEN tp + fp > 0 THEN {r6('tp / (tp + fp)')} ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN {r6('tp / (tp + fn)')} ELSE 0 END AS recall, CASE WHEN tp > 0 THEN {r6('2 * tp / (2 * tp + fp + fn)')} ELSE 0 END AS f1"


@query("WITH " + SLI + f", c AS (SELECT {_CONF} FROM (SELECT y, p > (SELECT avg(y) FROM sli) AS h FROM sli)) SELECT {_RATE} FROM c")
def confusion_metrics(spark, sf):
    x = scored_li(spark, sf)
    return tidy(evaluate.confusion(x.crossJoin(F.broadcast(x.agg(F.avg("y").alias("_t")))), F.col("_t")))


_LOSS = f"{r6('avg(-(y * ln(p) + (1 - y) * ln(1 - p)))')} AS log_loss, {r6('avg((p - y) * (p - y))')} AS brier"


@query("WITH " + SLI + f" SELECT {_LOSS} FROM sli")
def log_loss_brier(spark, sf):
    return tidy(evaluate.losses(scored_li(spark, sf)))


@query("WITH " + SLI + f" SELECT greatest(ceil(round(p * 10, 9)) - 1, 0)::INT AS bin, count(*) AS n, {r6('avg(p)')} AS mean_p, {r6('avg(y)')} AS rate FROM sli GROUP BY 1")
def calibration_uniform(spark, sf):
    return tidy(evaluate.calibration(scored_li(spark, sf), evaluate.uniform_edges(10)))


@query("WITH " + SLI + f", e AS (SELECT unnest(quantile_cont(p, [{', '.join(str(i / 10) for i in range(1, 10))}])) AS e FROM sli), b AS (SELECT p, y, (SELECT count(*) FROM e WHERE e < p)::INT AS bin FROM sli) SELECT bin, count(*) AS n, {r6('avg(p)')} AS mean_p, {r6('avg(y)')} AS rate FROM b GROUP BY 1")
def calibration_quantile(spark, sf):
    x = scored_li(spark, sf)
    return tidy(evaluate.calibration(x, evaluate.quantile_edges(x, 10)))


def poisson_sql(key: str, n: str, seed: int, tag: str) -> str:
    """evaluate.poisson as SQL."""
    d1 = draw_sql(key, seed, tag)
    d2 = d1.replace("1, 8)", "9, 8)")
    table = ", ".join(f"{evaluate.poisson_cuts(m)}::BIGINT[]" for m in range(1, evaluate.EXACT_BELOW))
    z = f"(sqrt(-2 * ln(({d1} + 0.5) / {1 << 32})) * cos({2 * np.pi!r} * (({d2} + 0.5) / {1 << 32})))"
    few = f"len(list_filter(([{table}])[{n}], lambda c: c <= {d1}))"
    return f"(CASE WHEN {n} < 1 THEN 0 WHEN {n} < {evaluate.EXACT_BELOW} THEN {few} ELSE greatest(floor({n} + sqrt({n}) * {z} + ({z} * {z} - 1) / 6 + 0.5), 0) END)::BIGINT"


_KEY = "(round(p * 1000000000)::BIGINT || '-{0}-' || b)"
_BOOT = ", cn AS (SELECT p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM soc GROUP BY p)"
_BOOT += f", g AS (SELECT * FROM (SELECT b, p, {poisson_sql(_KEY.format('pos'), 'pos', 7, 'boot')} AS pos, {poisson_sql(_KEY.format('neg'), 'neg', 7, 'boot')} AS neg FROM cn, range(1, 21) r(b)) WHERE pos + neg > 0)"
_CI = lambda v: f"count({v}) AS replicates, {r6(f'avg({v})')} AS mean, {r6(f'quantile_cont({v}, 0.025)')} AS lo, {r6(f'quantile_cont({v}, 0.975)')} AS hi"


def _boot(spark, sf):
    counts = evaluate.score_counts(scored_oc(spark, sf).select("y", "p"))
    return evaluate.count_replicates(staged(counts, "score-counts"), 20)


_W = " + ".join(f"(k >= {t})::INT" for t in evaluate.POISSON)
_ROWS = ", bo AS (SELECT b, y, p, (" + _W + ")::BIGINT AS w FROM (SELECT b, y, p, " + draw_sql("(id || '-' || b)", 7, "boot") + " AS k FROM soc, range(1, 21) r(b)) WHERE " + "(" + _W + ") > 0)"
_ROWS += ", g AS (SELECT b, p, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS neg FROM bo GROUP BY b, p)"


def _resampled(spark, sf):
    """b, p, pos, neg of 20 replicates in which every row is drawn for by itself."""
    rows = evaluate.replicates(scored_oc(spark, sf).select("id", "y", "p"), "id", 20)
    return evaluate.score_counts(rows, by=["b"], weight=F.col("w"))


@query("WITH " + SOC + _ROWS + f" SELECT {_CI('auc')} FROM {auc_sql('g', 'b')}")
def bootstrap_auc_ci(spark, sf):
    return tidy(evaluate.interval(evaluate.auc(_resampled(spark, sf), ["b"], 8), "auc"))


_BROC = ", ro AS (SELECT b, p, sum(neg) OVER (PARTITION BY b ORDER BY p DESC) / sum(neg) OVER (PARTITION BY b) AS fpr, sum(pos) OVER (PARTITION BY b ORDER BY p DESC) / sum(pos) OVER (PARTITION BY b) AS tpr FROM g)"


@query("WITH " + SOC + _ROWS + _BROC + f" SELECT k, {_CI('tpr')} FROM {grid_sql('ro', 'b')} GROUP BY k")
def bootstrap_roc_band(spark, sf):
    grid = evaluate.roc_on_grid(evaluate.roc_points(_resampled(spark, sf), ["b"], 8), 21, ["b"])
    return tidy(evaluate.interval(grid, "tpr", ["k"]))


@query("WITH " + SOC + _BOOT + f", c AS (SELECT b, greatest(ceil(round(p * 5, 9)) - 1, 0)::INT AS bin, sum(pos) / sum(pos + neg) AS rate FROM g GROUP BY ALL) SELECT bin, {_CI('rate')} FROM c GROUP BY bin")
def bootstrap_calibration(spark, sf):
    c = evaluate.count_calibration(_boot(spark, sf), evaluate.uniform_edges(5), ["b"])
    return tidy(evaluate.interval(c, "rate", ["bin"]))


_TWO = ", tw AS (SELECT 'one' AS model, y, p FROM sli UNION ALL SELECT 'two', y, round(p * p, 9) FROM sli)"


def _two(spark, sf):
    x = scored_li(spark, sf).select("y", "p")
    return x.withColumn("model", F.lit("one")).unionByName(x.select("y", F.round(F.col("p") * F.col("p"), 9).alias("p")).withColumn("model", F.lit("two")))


@query("WITH " + SLI + _TWO + f", c AS (SELECT model, {_CONF}, {_LOSS} FROM (SELECT model, y, p, p > 0.5 AS h FROM tw) GROUP BY model), g AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM tw GROUP BY ALL) SELECT model, {_RATE}, log_loss, brier, {r6('auc')} AS auc FROM c JOIN {auc_sql('g', 'model')} USING (model)")
def compare_models(spark, sf):
    x = _two(spark, sf)
    a = evaluate.auc(evaluate.score_counts(x, by=["model"]), ["model"])
    return tidy(evaluate.confusion(x, 0.5, ["model"]).join(evaluate.losses(x, ["model"]), "model").join(a, "model"))


@query("WITH " + SLI + f", h AS (SELECT least(floor(p / 0.05), 19)::INT AS bin, count(*) AS n FROM sli GROUP BY 1) SELECT k::INT AS bin, {r6('k * 0.05::DOUBLE')} AS \"left\", {r6('(k + 1) * 0.05::DOUBLE')} AS \"right\", coalesce(n, 0) AS n FROM range(20) r(k) LEFT JOIN h ON bin = k")
def prediction_histogram(spark, sf):
    return tidy(profile.histogram(scored_li(spark, sf), "p", 20, 0.0, 1.0))


@query("WITH " + SLI + _TWO + f", g AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM tw GROUP BY ALL) SELECT stage, {r6('auc')} AS auc FROM (VALUES ('one'), ('two'), ('three')) s(stage) LEFT JOIN {auc_sql('g', 'model')} ON stage = model")
def performance_summary(spark, sf):
    a = evaluate.auc(evaluate.score_counts(_two(spark, sf), by=["model"]), ["model"])
    stages = spark.createDataFrame([("one",), ("two",), ("three",)], "stage string")
    return tidy(stages.join(a, stages["stage"] == a["model"], "left").select("stage", "auc"))


RULES = [train.Rule("q", None, 10, 0, 0.0), train.Rule("q", 10, 30, 2, 0.4137), train.Rule("q", 30, None, 5, 0.9731), train.Rule("d", 0.05, None, 3, 0.6113)]


@query("WITH " + SLI.split(", sli AS")[0] + f", s AS (SELECT id, CASE WHEN q >= 10 AND q < 30 THEN 2.0 WHEN q >= 30 THEN 5.0 ELSE 0.0 END::DOUBLE + CASE WHEN d >= 0.05 THEN 3.0 ELSE 0.0 END::DOUBLE AS points, CASE WHEN q >= 10 AND q < 30 THEN 0.4137 WHEN q >= 30 THEN 0.9731 ELSE 0 END::DOUBLE + CASE WHEN d >= 0.05 THEN 0.6113 ELSE 0 END::DOUBLE - 0.7 AS z FROM li) SELECT id, points, {r6('1 / (1 + exp(-z))')} AS p, {r6('1 / (1 + exp(-(0.13 * points - 2.75)))')} AS p_points FROM s")
def score_card(spark, sf):
    return tidy(train.score_card(li(spark, sf), RULES, -0.7).select("id", "points", "p", "p_points"))


@query("WITH " + SLI + ", r AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i, (count(*) OVER () - 1) * (1 - (SELECT avg(y) FROM sli)) AS k FROM sli), c AS (SELECT max(p) FILTER (WHERE i = floor(k)) AS a, max(p) FILTER (WHERE i = ceil(k)) AS b, max(k - floor(k)) AS f FROM r) SELECT id, (p >= CASE WHEN a = b THEN a ELSE (1 - f) * a + f * b END)::INT AS label FROM sli, c")
def overwrite_labels(spark, sf):
    return train.overwrite_labels(scored_li(spark, sf), "p", "y").select("id", "label")


def _scaled(spark, sf):
    x = labelled_li(spark, sf).select("id", *LI_FEATURES, "y", "p")
    return encode.fit_scaler(x, LI_FEATURES).transform(x)


def _near_truth(scored, truth: str = "p", slack: float = 0.02, weight: str | None = None):
    """One row: whether the AUC of q, a model's score on rows it has not seen, comes close to that of the score the labels were drawn by."""
    counted = F.lit(1).cast("long") if weight is None else F.col(weight)
    each = scored.select("y", counted.alias("w"), F.inline(F.array(*[F.struct(F.lit(n).alias("of"), F.col(c).alias("p")) for n, c in (("model", "q_model"), ("truth", truth))])))
    found = staged(evaluate.auc(evaluate.score_counts(each, by=["of"], weight=F.col("w")), ["of"]), "fit-auc")
    at = lambda n: F.max(F.when(F.col("of") == n, F.col("auc")))
    return found.agg(((at("model") > at("truth") - slack) & (at("truth") > 0.7)).alias("near_truth"))


def _fit(spark, sf, kind, **params):
    """A model fitted on one part and judged on another."""
    rows = split.split_random(labelled_li(spark, sf).select("id", *LI_FEATURES, "y", "p"), "id")
    parts = staged(rows.withColumnRenamed("p", "truth").drop("id"), "fit-rows")
    fitted = train.fit_model(parts.where("split = 'train'"), LI_FEATURES, "y", kind, **params)
    scored = train.with_probability(fitted, parts.where("split = 'test'")).withColumnRenamed("p", "q_model")
    return _near_truth(scored, "truth").withColumn("model", F.lit(kind))


def _fit_early(spark, sf, kind):
    """A model that stops by the rows of val, fitted and judged on distinct rows with their counts."""
    rows = split.split_random(labelled_li(spark, sf).select("id", *LI_FEATURES, "y", "p"), "id").withColumnRenamed("p", "truth")
    parts = staged(select.tallied(rows, ["split", "y", "truth", *LI_FEATURES]), "fit-rows")
    learn = parts.where("split <> 'test'").withColumn("held", F.col("split") == "val")
    fitted = train.fit_model(learn, LI_FEATURES, "y", kind, weight="w", validationIndicatorCol="held")
    scored = train.with_probability(fitted, parts.where("split = 'test'")).withColumnRenamed("p", "q_model")
    return _near_truth(scored, "truth", weight="w").withColumn("model", F.lit(kind))


def _is_near(kind: str) -> str:
    return f"SELECT '{kind}' AS model, TRUE AS near_truth"


@query(_is_near("logreg"))
def fit_logreg(spark, sf):
    return _fit(spark, sf, "logreg")


@query(_is_near("gbt"))
def fit_gbt(spark, sf):
    """All defaults, up to 280 trees, stopped early by the rows of val."""
    return _fit_early(spark, sf, "gbt")


@query(_is_near("forest"))
def fit_forest(spark, sf):
    return _fit(spark, sf, "forest", numTrees=60)  # of 250


def _network(spark, sf, mask=None):
    rows = split.split_random(_scaled(spark, sf), "id").withColumnRenamed("p", "truth")
    parts = staged(select.tallied(rows, ["split", "y", "truth", *LI_FEATURES]), "network-rows")
    one, two = parts.where("split = 'train'"), parts.where("split = 'test'")
    net = train.fit_network(one, LI_FEATURES, "y", mask=mask, epochs=60, test=two, weight="w")
    return net, _near_truth(parts.where("split = 'val'").withColumn("q_model", net.score({f: F.col(f) for f in LI_FEATURES})), "truth", weight="w")


@query("SELECT TRUE AS near_truth")
def fit_network(spark, sf):
    return _network(spark, sf)[1]


@query("SELECT TRUE AS near_truth, TRUE AS auc_rose, TRUE AS loss_fell")
def fit_network_batches(spark, sf):
    """Steps over batches of rows; the history's sketched AUC and loss of rows held back."""
    parts = staged(split.split_random(_scaled(spark, sf), "id").withColumnRenamed("p", "truth"), "network-parts")
    one, two, history = parts.where("split = 'train'"), parts.where("split = 'test'"), []
    size = max(512, one.count() // 5)  # five steps an epoch at any size
    net = train.fit_network(one, LI_FEATURES, "y", epochs=13, rate=0.05 * train.BASE_BATCH / size, test=two, history=history, batch=size, id_="id")
    out = _near_truth(parts.where("split = 'val'").withColumn("q_model", net.score({f: F.col(f) for f in LI_FEATURES})), "truth")
    first, last = history[0], history[-1]
    return out.withColumns({"auc_rose": F.lit(last["test_auc"] > max(0.7, first["test_auc"])), "loss_fell": F.lit(last["test_loss"] < first["test_loss"])})


@query("SELECT TRUE AS near_truth, 0.0::DOUBLE AS outside_mask")
def fit_masked_network(spark, sf):
    mask = np.array([[1, 1, 0, 0], [1, 0, 1, 0], [0, 0, 0, 1]])
    net, out = _network(spark, sf, mask)
    return out.withColumn("outside_mask", F.lit(float(np.abs(net.w1[mask == 0]).max())))


@query()
def random_search(spark, sf):
    parts = split.split_random(labelled_li(spark, sf).drop("p"), "id")
    one = lambda name: parts.where(F.col("split") == name).drop("split")
    return train.random_search(one("train"), one("test"), LI_FEATURES, "y", "logreg", {"regParam": (0.0001, 0.1, "log"), "elasticNetParam": [0.0, 0.5, 1.0]}, 4)


@query()
def callable_scorer(spark, sf):
    x = train.with_callable(li(spark, sf).select("id", *LI_FEATURES), LI_FEATURES, lambda f: 1 / (1 + np.exp(-(-1.5 + 0.05 * f["q"]))))
    return x.select("id", F.round("p", 6).alias("p"))


