"""Queries of column roles, preparation, stored forms, category responses, reports and fitted scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid
from ..functions.storage import staged
from ..operators import chain, clean, columns, decompose, encode, evaluate, explain, nomogram, prepare, profile, score, select, split, train
from .decomposition import _BETA, BETAS, GRID_LEBESGUE, GRID_SHOWN, LEBESGUE, _curves, logit_sql, singles
from .frames import DL, LI, LI_FEATURES, OC, SEGMENTS, SLI, SOC, dl, draw_sql, labelled_li, li, li_score, oc, r6, scored_li, scored_oc
from .modelling import _BOOT, _G, _ROC, _CONF, _LOSS, _RATE, auc_sql, grid_sql
from .registry import query
from .selection import _C, _P, _TERMS, INTERCEPT, N, PAIRS, _chosen, _contrib, groups, path, phis
from .tabular import _split, _union, tidy

_DLX = "WITH " + DL + ", n AS (SELECT doc_id, lang, CASE WHEN quality IS NOT NULL THEN n_chars END::DOUBLE AS x FROM dl)"


def _dlx(spark, sf):
    return dl(spark, sf).select("doc_id", "lang", F.when(F.col("quality").isNotNull(), F.col("n_chars")).cast("double").alias("x"))


# -- roles of columns


@query("WITH " + DL + " SELECT CASE WHEN bool_and(quality IN (0, 1)) AND min(quality) = 0 AND max(quality) = 1 THEN 'quality' ELSE 'toxic' END AS target, 'doc_id' AS id FROM dl")
def detect_columns(spark, sf):
    x = dl(spark, sf)
    found = columns.detect_target(x, ["outcome", "target"]), columns.detect(x, ["ID", "DOC_ID"], any_case=True)
    return spark.createDataFrame([found], "target string, id string")


@query("WITH " + LI + " SELECT id, 1 - y AS y FROM li")
def invert_target(spark, sf):
    return li(spark, sf).select("id", clean.invert_target(F.col("y")).alias("y"))


@query("WITH " + LI + " SELECT d, q, y, id FROM li")
def select_features(spark, sf):
    return columns.select_features(li(spark, sf), ["d", "q"], "y", ["key", "id"])


@query("WITH " + LI + " SELECT q, d, t, rf, ls FROM li")
def drop_roles(spark, sf):
    return columns.drop_roles(li(spark, sf), "y", ["id", "price"], None, "no_such_column")


@query("WITH " + OC + _union(f" SELECT '{c}' AS feature, coalesce(bool_or(abs({x}) > 0.1 AND abs({x} - 1) > 0.1), FALSE) AS is_scaled FROM oc" for c, x in (("plain", "(seg < 'F')::INT"), ("scaled", "(seg < 'F')::INT * 0.5 - 0.2"))))
def scaled_dummies(spark, sf):
    one = (F.col("seg") < "F").cast("int")
    return columns.scaled_dummies(oc(spark, sf).select(one.alias("plain"), (one * 0.5 - 0.2).alias("scaled")), ["plain", "scaled"])


@query("WITH " + OC + " SELECT 'seg' AS \"group\", count_if((seg < 'C')::INT + (status = 'F')::INT > 1) AS more_than_one, count_if((seg < 'C')::INT + (status = 'F')::INT = 0) AS all_zero, count(*) AS n FROM oc")
def group_check(spark, sf):
    x = oc(spark, sf).select((F.col("seg") < "C").cast("int").alias("a"), (F.col("status") == "F").cast("int").alias("b"))
    return columns.check_groups(x, {"seg": ["a", "b"]})


# -- profiles


@query("WITH " + DL + _union(f" SELECT '{c}' AS feature, count({c}) AS n, count(*) - count({c}) AS missing, {r6(f'(count(*) - count({c})) / count(*) * 100')} AS missing_pct, {t} AS mean_sd FROM dl" for c, t in (("n_chars", "printf('%.2f (%.2f)', avg(n_chars), stddev_samp(n_chars))"), ("quality", "printf('%.2f (%.2f)', avg(quality), stddev_samp(quality))"), ("lang", "NULL"))))
def overview(spark, sf):
    return tidy(profile.overview(dl(spark, sf), ["n_chars", "quality", "lang"]))


_STATS = "avg({0}) AS mean, median({0}) AS median, stddev_samp({0}) AS std, min({0}) AS min, max({0}) AS max, count(*) - count({0}) AS missing_count, (count(*) - count({0})) / count(*) * 100 AS missing_pct"


@query(_DLX + ", a AS (SELECT coalesce(x, (SELECT median(x) FROM n)) AS x FROM n), s AS (SELECT 'before' AS stage, " + _STATS.format("x") + " FROM n UNION ALL SELECT 'after', " + _STATS.format("x") + " FROM a) SELECT stage, 'x' AS feature, " + ", ".join(f"{r6(c)} AS {c}" for c in ("mean", "median", "std", "min", "max", "missing_pct")) + ", missing_count FROM s")
def imputation_stats(spark, sf):
    x = _dlx(spark, sf)
    return tidy(prepare.stats(x, clean.fit_median(x, ["x"]).transform(x), ["x"]))


@query("WITH " + DL + _union(f" SELECT '{c}' AS feature, {r6(f'(count(*) - count({c})) / count(*) * 100')} AS missing_pct FROM dl" for c in ("quality", "lang")))
def missing_share(spark, sf):
    return tidy(profile.missing_share(dl(spark, sf), ["quality", "lang"]))


@query("WITH " + OC + f" SELECT status AS split, 'bal' AS feature, {r6('quantile_cont(bal, 0.25)')} AS q1, {r6('median(bal)')} AS median, {r6('quantile_cont(bal, 0.75)')} AS q3, {r6('(count(*) - count(bal)) / count(*) * 100')} AS missing_pct FROM oc WHERE status IN ('F', 'O') GROUP BY status")
def split_quartiles(spark, sf):
    return tidy(profile.compare_quartiles(oc(spark, sf).withColumnRenamed("status", "split"), "split", ["bal"], ["F", "O"]))


@query("WITH " + LI + f", b AS (SELECT least(floor((t - 0.01) / (0.06 / 7)), 6)::INT AS bin, count(*) AS n FROM li WHERE t BETWEEN 0.01 AND 0.07 GROUP BY 1) SELECT k::INT AS bin, {r6('0.01 + k * (0.06 / 7)')} AS \"left\", {r6('0.01 + (k + 1) * (0.06 / 7)')} AS \"right\", coalesce(n, 0) AS n FROM range(7) r(k) LEFT JOIN b ON bin = k")
def histogram_in_grid(spark, sf):
    return tidy(profile.histogram_within(li(spark, sf), "t", 0.01, 0.07))


@query("WITH " + LI + _union(f" SELECT '{c}' AS feature, count(DISTINCT {c}) AS levels, count(DISTINCT {c}) <= 11 AS found, count(DISTINCT {c}) < 11 AS shown FROM li" for c in ("q", "d", "t")))
def few_levels(spark, sf):
    return profile.few_levels(li(spark, sf), LI_FEATURES, 11)


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN NULL WHEN lang = 'en' THEN n_chars::DOUBLE ELSE 0.5 END AS x FROM documents")
def numbers_in_text(spark, sf):
    raw = F.when(F.col("lang") == "de", "N/A").when(F.col("lang") == "en", F.col("n_chars").cast("string")).otherwise(".5")
    return clean.number_if_any(dl(spark, sf).select("doc_id", raw.alias("x")), "x")


# -- encodings and preparation


@query("WITH " + OC + " SELECT id, y AS risk, (seg < 'F')::INT AS \"first\" FROM oc")
def binary_encode(spark, sf):
    x = oc(spark, sf).select("id", F.when(F.col("y") == 1, "High risk").otherwise("Low risk").alias("risk"), F.when(F.col("seg") < "F", "Yes").otherwise("No").alias("first"))
    return encode.encode_binary(x, ["risk", "first"])[0]


@query("WITH " + OC + ", n AS (SELECT 'pri' AS feature, pri AS level, count(*) AS n FROM oc GROUP BY ALL) SELECT feature, level, (row_number() OVER (ORDER BY n DESC, level) - 1)::INT AS rank FROM n UNION ALL SELECT DISTINCT 'flag', CASE WHEN y = 1 THEN 'absent' ELSE 'present' END, (y = 0)::INT FROM oc")
def level_orders(spark, sf):
    x = oc(spark, sf).select("pri", F.when(F.col("y") == 1, "absent").otherwise("present").alias("flag"))
    return encode.level_orders(x, ["pri", "flag"], "frequency")


@query("WITH " + OC + " SELECT id, CASE WHEN pri < '4' THEN pri END AS level FROM oc")
def decode_ordinal(spark, sf):
    x = oc(spark, sf)
    order = encode.levels(x, "pri")
    return x.select("id", encode.decode(encode.ordinal(F.col("pri"), order), [v for v in order if v < "4"]).alias("level"))


@query("WITH " + OC + ", m AS (SELECT DISTINCT seg FROM oc), k AS (SELECT 'seg' AS feature, node FROM range(5) r(node) UNION ALL SELECT 'bal', node FROM range(5, 10) r(node)) SELECT CASE WHEN feature = 'seg' THEN 'seg_' || seg ELSE feature END AS feature, node::INT AS node FROM k LEFT JOIN m ON feature = 'seg'")
def expand_mask(spark, sf):
    x = oc(spark, sf)
    members = x.select(F.lit("seg").alias("feature"), F.concat(F.lit("seg_"), F.col("seg")).alias("member")).distinct()
    mask = spark.range(10).select(F.when(F.col("id") < 5, "seg").otherwise("bal").alias("feature"), F.col("id").cast("int").alias("node"))
    return encode.expand_mask(mask, members)


@query("WITH " + LI + f", s AS (SELECT avg(price) AS m, stddev_pop(price) AS s, min(price) AS lo, max(price) AS hi, median(price) AS med, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS iqr FROM li) SELECT id, {r6('(price - m) / s')} AS standard, {r6('(price - lo) / (hi - lo)')} AS minmax, {r6('(price - med) / iqr')} AS robust FROM li, s")
def other_scalers(spark, sf):
    x = li(spark, sf).select("id", *[F.col("price").alias(k) for k in ("standard", "minmax", "robust")])
    for k in ("standard", "minmax", "robust"):
        x = encode.fit_shift_scaler(x, [k], k).transform(x)
    return tidy(x)


@query("SELECT DISTINCT 'lang' AS feature, lang AS level FROM documents WHERE lang IS NOT NULL UNION SELECT DISTINCT 'source', source FROM documents WHERE source IS NOT NULL")
def union_levels(spark, sf):
    x = dl(spark, sf)
    return encode.union_levels({"a": x.where("doc_id % 2 = 0"), "b": x.where("doc_id % 2 = 1")}, ["lang", "source"])


def _parts(spark, sf):
    x = split.split_random(oc(spark, sf), "id").withColumn("bal", F.when(F.col("year") != 1996, F.col("bal"))).withColumn("seg", F.when(F.col("year") != 1997, F.col("seg")))
    x = staged(x.select("id", "split", "bal", "seg", "pri", "y"), "split-orders")
    return {s: x.where(F.col("split") == s) for s in ("train", "test", "val")}


def _prepared(spark, sf):
    parts = _parts(spark, sf)
    fitted = prepare.fit(parts["train"], ["bal"], {"pri": ["3-MEDIUM"]}, ["seg"], chosen={"seg": "HOUSEHOLD"})
    return prepare.prepare(parts, fitted), fitted


_SEGS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")
_PREP = "WITH s AS (" + _split("") + "), " + OC + """, x AS (SELECT id, split, CASE WHEN year <> 1996 THEN bal END AS bal, CASE WHEN year <> 1997 THEN seg END AS seg, pri, y FROM oc JOIN s USING (id)),
t AS (SELECT * FROM x WHERE split = 'train'), m AS (SELECT median(bal) AS bal, (SELECT seg FROM t WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1) AS seg FROM t),
p AS (SELECT pri, (row_number() OVER (ORDER BY pri <> '3-MEDIUM', pri) - 1)::INT AS code FROM (SELECT DISTINCT pri FROM t)),
z AS (SELECT x.id, x.split, coalesce(x.bal, m.bal) AS bal, coalesce(x.seg, m.seg) AS seg, code AS pri, y FROM x CROSS JOIN m LEFT JOIN p ON p.pri = x.pri)"""


@query(_PREP + " SELECT id, split, bal, pri, y, " + ", ".join(f"(seg = '{s}')::INT AS \"seg_{s}\"" for s in _SEGS) + " FROM z")
def preprocess_splits(spark, sf):
    parts, _ = _prepared(spark, sf)
    return parts["train"].unionByName(parts["test"]).unionByName(parts["val"])


_DUMMIES = ", ".join(f"(seg = '{s}')::INT AS \"seg_{s}\"" for s in _SEGS)
_OWN = _PREP[: _PREP.index("t AS (")] + """t AS (SELECT * FROM x WHERE split = 'train'), c AS (SELECT split, seg FROM x WHERE seg IS NOT NULL GROUP BY split, seg QUALIFY row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, seg) = 1),
m AS (SELECT split, median(bal) AS bal FROM x GROUP BY split),""" + _PREP[_PREP.index("\np AS (") : _PREP.index("z AS (")]
_OWN += "z AS (SELECT x.id, x.split, coalesce(x.bal, m.bal) AS bal, coalesce(x.seg, c.seg) AS seg, code AS pri, y FROM x JOIN m USING (split) LEFT JOIN c USING (split) LEFT JOIN p ON p.pri = x.pri)"


@query(_OWN + f" SELECT id, split, bal, pri, y, {_DUMMIES} FROM z")
def preprocess_by_own_values(spark, sf):
    """Each part's nulls filled by its own median and mode; levels and references from the training part."""
    parts = _parts(spark, sf)
    fitted = prepare.fit(parts["train"], ["bal"], {"pri": ["3-MEDIUM"]}, ["seg"], chosen={"seg": "HOUSEHOLD"})
    out = prepare.prepare_by_own(parts, fitted)
    return out["train"].unionByName(out["test"]).unionByName(out["val"])


def _donor_sql(c: str) -> str:
    return f"{c}_r AS (SELECT {c} AS v, (sum(count(*)) OVER (ORDER BY {c}))::BIGINT AS hi, hi - count(*) AS lo, (sum(count(*)) OVER ())::BIGINT AS total FROM t WHERE {c} IS NOT NULL GROUP BY {c})"


def _place_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN {draw_sql('id', 42, c)} % (SELECT max(total) FROM {c}_r) END AS {c}_k"


_RANDOM = _PREP[: _PREP.index(", m AS (")] + f", {_donor_sql('bal')}, {_donor_sql('seg')}, k AS (SELECT *, {_place_sql('bal')}, {_place_sql('seg')} FROM x)," + _PREP[_PREP.index("\np AS (") : _PREP.index("z AS (")]
_RANDOM += """z AS (SELECT k.id, split, coalesce(bal, bal_r.v) AS bal, coalesce(seg, seg_r.v) AS seg, code AS pri, y
FROM k ASOF LEFT JOIN bal_r ON bal_k >= bal_r.lo ASOF LEFT JOIN seg_r ON seg_k >= seg_r.lo LEFT JOIN p ON p.pri = k.pri)"""


@query(_RANDOM + f" SELECT id, split, bal, pri, y, {_DUMMIES} FROM z")
def preprocess_random(spark, sf):
    """All parts' nulls filled by values drawn from the training part, numbers and categories, by a preparation that went through JSON."""
    parts = _parts(spark, sf)
    fitted = prepare.fit(parts["train"], ["bal"], {"pri": ["3-MEDIUM"]}, ["seg"], method="random", chosen={"seg": "HOUSEHOLD"}, category_method="random", id_="id")
    out = prepare.prepare(parts, prepare.from_json(fitted.to_json()))
    return out["train"].unionByName(out["test"]).unionByName(out["val"])


@query("WITH l(code, level) AS (VALUES (0, 'HOUSEHOLD'), " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(_SEGS, 1)) + ") SELECT 'seg' AS feature, code, level, code = 0 AS is_reference FROM l WHERE EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = level)")
def preparation_record(spark, sf):
    again = prepare.from_json('{"metadata": ' + _prepared(spark, sf)[1].to_json() + "}")
    return spark.createDataFrame(again.categories(), "feature string, code int, level string, is_reference boolean")


# -- selection and explanation


@query(_P + " SELECT lambda_idx, " + ", ".join(f"{r6(f'CASE WHEN abs(b{k}) <= 0.1 THEN 0 ELSE b{k} END')} AS b{k}" for k in range(N)) + " FROM pa")
def thresholded_path(spark, sf):
    return tidy(select.thresholded(path(groups(spark, sf))).select("lambda_idx", *[F.get("betas", F.lit(k)).alias(f"b{k}") for k in range(N)]))


@query(_P + " SELECT lambda_idx, k::INT AS term, " + r6("([b0, b1, b2, b3])[k + 1]") + " AS beta FROM pa, range(4) r(k)")
def path_table(spark, sf):
    return tidy(select.path_table(path(groups(spark, sf))).select("lambda_idx", "term", "beta"))


@query(_P + ", u AS (SELECT k::INT AS term, ([b0, b1, b2, b3])[k + 1] AS beta FROM pa, range(4) r(k) WHERE lambda_idx = 7) SELECT term, " + r6("beta") + " AS beta, row_number() OVER (ORDER BY round(abs(beta), 9) DESC, term)::INT AS rank FROM u WHERE abs(beta) > 0.001")
def coefficient_bars(spark, sf):
    return tidy(select.coefficient_bars(path(groups(spark, sf)), 7))


_PAIRS3 = {3: (0, 1), 4: (0, 2), 5: (1, 2)}
_KINDS = "ki AS (SELECT * FROM (" + _union(f"SELECT {i} AS idx, count(DISTINCT {f}) < 15 AS cat FROM li" for i, f in enumerate("qdt")) + "))"


@query("WITH " + LI + ", " + _KINDS + ", pr(term, i, j) AS (VALUES " + ", ".join(f"({t}, {i}, {j})" for t, (i, j) in _PAIRS3.items()) + ") SELECT term, i, j, a.cat <> b.cat AS mixed FROM pr JOIN ki a ON a.idx = i JOIN ki b ON b.idx = j")
def mixed_pairs(spark, sf):
    return select.mixed_pairs(nomogram.feature_metadata(li(spark, sf), LI_FEATURES), _PAIRS3)


@query("WITH n AS (SELECT count(*)::VARCHAR AS n FROM orders) SELECT field, stored, wanted, stored IS NOT DISTINCT FROM wanted AS same FROM (" + _union(f"SELECT '{f}' AS field, {a} AS stored, {b} AS wanted FROM n" for f, a, b in (("model", "'forest'", "'forest'"), ("method", "'lebesgue'", "'dirac'"), ("rule", "NULL", "NULL"), ("value", "'0.99'", "NULL"), ("threshold", "'0.1'", "'0.1'"), ("n_lambdas", "n", "n"), ("max_terms", "'100'", "'60'"))) + ")")
def compare_settings(spark, sf):
    n = oc(spark, sf).count()
    stored = spark.createDataFrame([("forest", "lebesgue", None, 0.99, 0.1, n, 100)], "model string, method string, rule string, value double, threshold double, n_lambdas long, max_terms int")
    return select.compare_settings(stored, {"model": "forest", "method": "dirac", "rule": None, "threshold": 0.1, "n_lambdas": n, "max_terms": 60})


@query(_C + ", su AS (SELECT id, sum(c) + " + str(INTERCEPT) + " AS s FROM co GROUP BY id) SELECT count(*) AS n, count_if(abs(s - " + logit_sql("q", "d", "t") + ") <= 0.01) AS agree, " + r6("max(s)") + " AS highest FROM su JOIN li USING (id)")
def explanation_check(spark, sf):
    x = li(spark, sf).withColumn("p", li_score({f: F.col(f) for f in LI_FEATURES}))
    checked = explain.check_explanation(_contrib(spark, sf), ["id"], INTERCEPT, x)
    return tidy(checked.agg(F.count("*").alias("n"), F.count_if("agrees").alias("agree"), F.max("summed").alias("highest")))


@query(_P + " SELECT term, " + r6("mean") + " AS mean FROM (" + _union(f"SELECT {k} AS term, avg(abs(x{k})) AS mean FROM ph" for k in range(3)) + ")")
def unweighted_contributions(spark, sf):
    long = phis(spark, sf).select("id", F.posexplode("phis").alias("term", "phi"))
    return tidy(explain.mean_contributions(explain.unweighted(long, [0, 1, 2])).select("term", F.col("mean_abs").alias("mean")))


@query(_C + ", m AS (SELECT avg(c) AS mean FROM co WHERE term = 3) SELECT i::INT AS i, j::INT AS j, CASE WHEN i + j = 1 THEN " + r6("coalesce(mean, 0)") + " ELSE 0 END AS mean FROM range(3) a(i), range(3) b(j), m")
def interaction_table(spark, sf):
    return tidy(explain.full_matrix(_contrib(spark, sf), PAIRS, 3))


@query(_P + _TERMS + ", te AS (SELECT term FROM tm UNION SELECT unnest([0, 1]) FROM tm WHERE term = 3) SELECT term, unnest(CASE term WHEN 0 THEN [0] WHEN 3 THEN [0, 1, 2] ELSE [1, 2] END) AS feature FROM te")
def mask_terms(spark, sf):
    chosen = {r["term"] for r in _chosen(spark, sf).collect()}  # a handful
    rows = [(t, f) for t, fs in select.mask_terms(chosen, PAIRS, groups=[[1, 2]], add_singles=True) for f in fs]
    return spark.createDataFrame(rows, "term int, feature int")


# -- responses with categories, with chosen terms, and of fitted models


_CAT = {"bal": 0.0937, "seg_BUILDING": 0.3137, "seg_FURNITURE": -0.2719, "seg_MACHINERY": 0.0713}


def _cat_frame(spark, sf):
    code = encode.ordinal(F.col("seg"), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).cast("double")
    return oc(spark, sf).select("id", "bal", code.alias("seg"), "y")


def _cat_scorer():
    names = ["seg_BUILDING", "seg_FURNITURE", "seg_HOUSEHOLD", "seg_MACHINERY"]
    z = lambda at: sum((at[f] * b for f, b in _CAT.items()), F.lit(-0.4137)) + at["bal"] * at["seg_HOUSEHOLD"] * 0.0531
    return score.with_dummies(score.column_scorer(["bal", *names], lambda at: sigmoid(z(at))), {"seg": names})


def _cat_z(bal: str, seg: str) -> str:
    dummies = " + ".join(f"CASE WHEN {seg} = {k} THEN {v} ELSE 0 END" for k, v in ((1, 0.3137), (2, -0.2719), (4, 0.0713)))
    p = f"least(greatest(1 / (1 + exp(-(-0.4137 + {bal} * 0.0937 + {dummies} + CASE WHEN {seg} = 3 THEN {bal} * 0.0531 ELSE 0 END))), 1e-7), 1 - 1e-7)"
    return f"ln({p} / (1 - {p}))"


_CODE = "CASE seg WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END::DOUBLE"
_CATS = "WITH " + OC + f""", cf AS (SELECT bal, {_CODE} AS seg FROM oc), bg AS (SELECT bal, seg, count(*) AS w FROM cf GROUP BY ALL), z0 AS (SELECT sum(w * {_cat_z('bal', 'seg')}) / sum(w) AS phi0 FROM bg),
gr AS (SELECT 0 AS term, v.bal AS vi, NULL::DOUBLE AS vj FROM (SELECT DISTINCT bal FROM bg) v UNION ALL SELECT 1, v.seg, NULL FROM (SELECT DISTINCT seg FROM bg) v UNION ALL SELECT 2, bal, seg FROM bg),
raw AS (SELECT 0 AS term, vi, vj, sum(w * {_cat_z('vi', 'bg.seg')}) / sum(w) - any_value(phi0) AS d FROM gr, bg, z0 WHERE term = 0 GROUP BY vi, vj
  UNION ALL SELECT 1, vi, vj, sum(w * {_cat_z('bg.bal', 'vi')}) / sum(w) - any_value(phi0) FROM gr, bg, z0 WHERE term = 1 GROUP BY vi, vj
  UNION ALL SELECT 2, vi, vj, {_cat_z('vi', 'vj')} - phi0 FROM gr, z0 WHERE term = 2)"""


@query(_CATS + " SELECT term, " + r6("vi") + " AS vi, " + r6("vj") + " AS vj, " + r6("d") + " AS phi FROM raw WHERE vj IS NULL UNION ALL SELECT x.term, " + r6("x.vi") + ", " + r6("x.vj") + ", " + r6("x.d - a.d - b.d") + " FROM raw x JOIN raw a ON a.term = 0 AND a.vi = x.vi JOIN raw b ON b.term = 1 AND b.vi = x.vj WHERE x.term = 2")
def category_responses(spark, sf):
    return tidy(decompose.lebesgue(_cat_frame(spark, sf), ["bal", "seg"], _cat_scorer()))


@query("WITH " + OC + f", b AS (SELECT DISTINCT bal FROM oc) SELECT 'seg' AS feature, k::INT AS k, k::DOUBLE AS value FROM range(5) r(k) UNION ALL SELECT 'bal', (row_number() OVER (ORDER BY bal) - 1)::INT, bal FROM b WHERE (SELECT count(*) FROM b) < 15")
def category_grid(spark, sf):
    return decompose.even_grid(_cat_frame(spark, sf), ["bal", "seg"], categories={"seg": 4})


@query(GRID_LEBESGUE + f" SELECT term, {r6('vi')} AS vi, {r6('vj')} AS vj, {r6('phi')} AS phi FROM phi WHERE term IN (0, 2, 4)")
def selected_responses(spark, sf):
    x = li(spark, sf)
    which = decompose.terms(LI_FEATURES, pairs=[("t", "q")])
    grid = decompose.product_grid(decompose.even_grid(x, LI_FEATURES), LI_FEATURES, which)
    return tidy(decompose.lebesgue(x, LI_FEATURES, li_score, grid, which))


_FITTED = "WITH " + LI + _union(f" SELECT {i} AS term, count(DISTINCT {f}) AS n, 0.0 AS bend FROM li" for i, f in enumerate("qdt")) + _union(["", *[f" SELECT {t} AS term, count(DISTINCT ({'qdt'[a]}, {'qdt'[b]})) AS n, 0.0 AS bend FROM li" for t, (a, b) in _PAIRS3.items()]])


def _bend(responses, means):
    """n and bend of each term: how far the responses of a linear model are from lines through the means, or pairs from 0."""
    mean = F.element_at(F.create_map(*[F.lit(x) for kv in enumerate(means) for x in kv]), F.col("term"))
    slope = F.when(F.abs(F.col("vi") - mean) > 1e-9, F.col("phi") / (F.col("vi") - mean))
    bend = F.when(F.col("term") < 3, F.max(slope) - F.min(slope)).otherwise(F.max(F.abs("phi")))
    return responses.groupBy("term").agg(F.count("*").alias("n"), F.round(bend, 4).alias("bend"))


@query(_FITTED)
def explain_logreg(spark, sf):
    """Responses of a fitted logistic regression are straight lines, and its pairs are nothing."""
    x = li(spark, sf)
    fitted = train.fit_model(x, LI_FEATURES, "y", "logreg")
    means = [x.agg(F.avg(f)).first()[0] for f in LI_FEATURES]
    return _bend(decompose.lebesgue(x, LI_FEATURES, score.model_scorer(fitted)), means)


@query(_FITTED)
def explain_function(spark, sf):
    """The same for a Python function in Arrow batches."""
    x = li(spark, sf)
    means = [x.agg(F.avg(f)).first()[0] for f in LI_FEATURES]
    scorer = score.function_scorer(LI_FEATURES, lambda f: 1 / (1 + np.exp(-(0.3 + 0.02 * f["q"] - 3 * f["d"] + 2 * f["t"]))))
    return _bend(decompose.lebesgue(x, LI_FEATURES, scorer), means)


@query("WITH " + LI + _union(f" SELECT {i} AS term, count(DISTINCT {f}) AS n FROM li" for i, f in enumerate("qdt")))
def explain_forest(spark, sf):
    """Responses of boosted trees, for single features; their values are checked by tests."""
    x = li(spark, sf)
    fitted = train.fit_model(x, LI_FEATURES, "y", "gbt", maxIter=5)
    which = [t for t in decompose.terms(LI_FEATURES) if t[2] is None]
    return decompose.lebesgue(x, LI_FEATURES, score.model_scorer(fitted), which=which).groupBy("term").agg(F.count("phi").alias("n"))


# -- nomograms


_NAMES = {0: "q", 1: "d", 3: "q : d"}


def _built(spark, sf):
    """The curves of the selected terms, with q shown in dozens."""
    which = decompose.terms(LI_FEATURES, pairs=[("q", "d")])
    x = li(spark, sf)
    grid = decompose.product_grid(decompose.even_grid(x, LI_FEATURES), LI_FEATURES, which)
    responses = decompose.lebesgue(x, LI_FEATURES, li_score, grid, which)
    kinds = nomogram.pair_kinds({"q": "continuous", "d": "categorical"}, which)
    return nomogram.build(responses, spark.createDataFrame(BETAS, "term int, beta double"), -0.5317, _NAMES, kinds, {0: (0.0, 1 / 12), 3: (0.0, 1 / 12)})


@query(GRID_LEBESGUE + _BETA + f" SELECT term, CASE term WHEN 0 THEN 'q' WHEN 1 THEN 'd' ELSE 'q : d' END AS name, {r6('CASE WHEN term = 1 THEN vi ELSE vi / 12 END')} AS vi, {r6('vj')} AS vj, {r6('r')} AS r, -0.5317::DOUBLE AS intercept FROM cu")
def nomogram_document(spark, sf):
    return tidy(nomogram.read_document(nomogram.document(_built(spark, sf), {"model": "closed form"}, 0.5, 3)))


@query(GRID_LEBESGUE + _BETA + f", x AS (SELECT term, vi, r, row_number() OVER (PARTITION BY term ORDER BY vi) - 1 AS k FROM cu WHERE vj IS NULL) SELECT k::INT AS k, {r6('max(vi) FILTER (WHERE term = 0)')} AS q_x, {r6('max(r) FILTER (WHERE term = 0)')} AS q_r, {r6('max(vi) FILTER (WHERE term = 1)')} AS d_x, {r6('max(r) FILTER (WHERE term = 1)')} AS d_r FROM x GROUP BY k")
def nomogram_csv(spark, sf):
    return tidy(nomogram.wide_table(_curves(spark, sf, singles()), {0: "q", 1: "d"}))


@query(GRID_LEBESGUE + _BETA + f", x AS (SELECT vi, vj, r, row_number() OVER (ORDER BY vi, vj) - 1 AS k FROM cu WHERE term = 3) SELECT k::INT AS k, {r6('vi')} AS q_d_x1, {r6('vj')} AS q_d_x2, {r6('r')} AS q_d_r FROM x")
def nomogram_pairs_csv(spark, sf):
    which = decompose.terms(LI_FEATURES, pairs=[("q", "d")])
    return tidy(nomogram.wide_pairs(_curves(spark, sf, which), {3: "q_d"}))


_CUT = (GRID_SHOWN + _BETA, GRID_LEBESGUE + _BETA)


@query(" UNION ALL ".join(f"SELECT '{side}' AS side, term, {r6('vi')} AS vi, {r6('vj')} AS vj, {r6('r')} AS r FROM ({sql} SELECT * FROM cu)" for side, sql in zip(("shown", "stored"), _CUT)))
def nomogram_shown_and_stored(spark, sf):
    """Curves over the trimmed range and, read back from JSON, over the full range, from one pass over both grids."""
    which = decompose.terms(LI_FEATURES, pairs=[("q", "d")])
    x = li(spark, sf)
    grid = decompose.both_grids(x, LI_FEATURES, which, 0.05)
    responses = decompose.lebesgue(x, LI_FEATURES, li_score, grid.select("term", "vi", "vj"), which)
    kinds = nomogram.pair_kinds({"q": "continuous", "d": "categorical"}, which)
    shown, stored = nomogram.build_both(responses, grid, spark.createDataFrame(BETAS, "term int, beta double"), -0.5317, _NAMES, kinds)
    back = nomogram.read_document(nomogram.document(stored, {"model": "closed form"}, 0.5, 3))
    sides = [d.select(F.lit(side).alias("side"), "term", "vi", "vj", "r") for side, d in (("shown", shown.curves), ("stored", back))]
    return tidy(sides[0].unionByName(sides[1]))


def _entry(f: str, label: str, dense: str, at: int, places: str, group: bool, numbers: bool) -> str:
    values = "NULL::VARCHAR" if numbers else f"(SELECT string_agg(v::VARCHAR, ',' ORDER BY v) FROM (SELECT DISTINCT {f}::BIGINT AS v FROM c))"
    ends = f"(SELECT min({f}) FROM c) AS min, (SELECT max({f}) FROM c) AS max" if numbers else "NULL::DOUBLE AS min, NULL::DOUBLE AS max"
    return f"SELECT '{f}' AS feature, '{label}' AS label, {dense}::INT AS dense_idx, {at} AS collapsed_idx, '{places}' AS original_idx, {group} AS is_group, '{'continuous' if numbers else 'categorical'}' AS kind, {values} AS levels, {ends}"


_CODES = ", c AS (SELECT bal, list_position([" + ", ".join(f"'{s}'" for s in SEGMENTS) + "], seg) - 1 AS seg, year, price FROM oc) "


@query("WITH " + OC + _CODES + _union([_entry("bal", "bal", "NULL", 0, "0", False, False), _entry("seg", "Segment", "1", 1, "1,2,3,4", True, False), _entry("year", "year", "NULL", 2, "5", False, False), _entry("price", "Total price", "0", 3, "6", False, True)]))
def feature_catalogue(spark, sf):
    """Orders with their segment collapsed to codes; the price and the segment are selected."""
    x = oc(spark, sf).withColumn("seg", encode.ordinal(F.col("seg"), SEGMENTS))
    dummies = [f"seg_{s}" for s in SEGMENTS[1:]]
    found = nomogram.feature_catalogue(x, ["bal", "seg", "year", "price"], ["bal", *dummies, "year", "price"], {"seg": dummies}, {"seg": "Segment", "price": "Total price"}, ["price", "seg"])
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("long").cast("string")), ",")
    return found.withColumns({"original_idx": text("original_idx"), "levels": text("values")}).drop("values")


@query("WITH " + OC + " SELECT id, bal::BIGINT AS bal, price, seg FROM oc")
def convert_categorical(spark, sf):
    """The balance in thousands has 11 levels and is whole; the price has too many, the segment is text."""
    return profile.convert_categorical(oc(spark, sf), ["bal", "price", "seg"], 15).select("id", "bal", "price", "seg")


@query(LEBESGUE + f" SELECT 0 AS term, {r6('vi')} AS value, {r6('phi')} AS phi FROM phi WHERE term = 0")
def raw_responses(spark, sf):
    x = li(spark, sf)
    which = singles(["q"])
    long = decompose.to_rows(x, ["id"], LI_FEATURES, decompose.lebesgue(x, LI_FEATURES, li_score, which=which), which)
    values = x.select("id", F.lit(0).alias("term"), F.col("q").alias("value"))
    return tidy(nomogram.raw_responses(long, values, ["id"]))


# -- reports


@query("WITH " + SLI + _G + _ROC + f", c AS (SELECT {_CONF}, {_LOSS} FROM (SELECT y, p, p > (SELECT avg(y) FROM sli) AS h FROM sli)) SELECT {_RATE}, log_loss, brier, {r6('auc')} AS auc, {r6('(SELECT avg(y) FROM sli)')} AS threshold, (SELECT count(DISTINCT greatest(ceil(round(p * 10, 9)) - 1, 0)) FROM sli)::INT AS bins, {r6('(SELECT avg(tpr) FROM ' + grid_sql('ro') + ')', 5)} AS mean_tpr FROM c, {auc_sql('g')}")
def one_model_report(spark, sf):
    r = evaluate.report(scored_li(spark, sf), grid=21)
    mean = F.aggregate("roc", F.lit(0.0), lambda s, x: s + x["tpr"]) / F.size("roc")
    return tidy(r.withColumns({"bins": F.size("calibration"), "mean_tpr": mean}).drop("calibration", "roc"), mean_tpr=5)


@query("WITH s AS (" + _split("") + "), " + SOC + ", z AS (SELECT split, y, p FROM soc JOIN s USING (id)), g AS (SELECT split, p, sum(y) AS pos, sum(1 - y) AS neg FROM z GROUP BY ALL), st(stage, o, n_single, n_pair) AS (VALUES ('model', 0, NULL, NULL), ('model_nomogram', 1, 3, 1), ('network', 2, NULL, NULL), ('network_nomogram', 3, NULL, NULL)), sp(split) AS (VALUES ('train'), ('test'), ('val')) SELECT stage, sp.split, CASE WHEN stage = 'model' THEN " + r6("auc") + " END AS auc, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, n_single::INT AS n_single, n_pair::INT AS n_pair, (n_single + n_pair)::INT AS n_terms FROM st CROSS JOIN sp LEFT JOIN " + auc_sql("g", "split") + " a ON a.split = sp.split")
def stage_summary(spark, sf):
    parts = split.split_random(scored_oc(spark, sf), "id")
    aucs = evaluate.auc(evaluate.score_counts(parts, by=["split"]), ["split"])
    none = F.lit(None).cast("double")
    aucs = aucs.select(F.lit("model").alias("stage"), "split", "auc", none.alias("lo"), none.alias("hi"))
    return tidy(evaluate.performance_summary(aucs, spark.createDataFrame([("model_nomogram", 3, 1)], "stage string, n_single int, n_pair int")))


@query("WITH " + SOC + _BOOT + f", c AS (SELECT b, greatest(ceil(round(p * 5, 9)) - 1, 0)::INT AS bin, sum(pos) / sum(pos + neg) AS rate FROM g GROUP BY ALL), i AS (SELECT bin, quantile_cont(rate, 0.025) AS lo, quantile_cont(rate, 0.975) AS hi FROM c GROUP BY bin), n AS (SELECT greatest(ceil(round(p * 5, 9)) - 1, 0)::INT AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM soc GROUP BY 1) SELECT bin, n, {r6('mean_p')} AS mean_p, {r6('rate')} AS rate, CASE WHEN n >= 5 THEN {r6('lo')} END AS lo, CASE WHEN n >= 5 THEN {r6('hi')} END AS hi FROM n LEFT JOIN i USING (bin)")
def calibration_band(spark, sf):
    return tidy(evaluate.calibration_band(scored_oc(spark, sf).select("y", "p"), evaluate.uniform_edges(5), 20))


@query("WITH " + SLI + f", h AS (SELECT y, least(floor(p * 20), 19)::INT AS bin, count(*) AS n FROM sli GROUP BY ALL) SELECT y, bin, {r6('n / sum(n) OVER (PARTITION BY y) * 20')} AS density FROM h")
def prediction_density(spark, sf):
    return tidy(evaluate.density(scored_li(spark, sf), 20, ["y"]))


@query("WITH s AS (" + _split("") + "), w(split, wanted) AS (VALUES ('train', 0.6), ('test', 0.2), ('val', 0.2)), n AS (SELECT split, count(*) AS n FROM s GROUP BY split) SELECT split, coalesce(n, 0) AS n, " + r6("coalesce(n, 0) / (SELECT count(*) FROM s)") + " AS share, wanted::DOUBLE AS wanted, abs(coalesce(n, 0) / (SELECT count(*) FROM s) - wanted) > 0.1 AS off FROM w LEFT JOIN n USING (split)")
def split_shares(spark, sf):
    return tidy(split.split_shares(split.split_random(oc(spark, sf), "id")))


# -- the whole chain


LAMBDAS = 24


@query("SELECT k::INT AS lambda_idx, " + r6(f"exp(ln(1000.0) + (ln(0.05) - ln(1000.0)) * k / {LAMBDAS - 1})", 4) + f" AS lambda, TRUE AS at_minimum FROM range({LAMBDAS}) r(k) WHERE EXISTS (SELECT 1 FROM lineitem)")
def l1_path_conditions(spark, sf):
    """Every fit of a path meets the conditions of its minimum, to 1 in 1,000 of its own lambda."""
    rows = groups(spark, sf)
    fitted = select.fit_path(rows, "phis", "y", select.lambda_path(LAMBDAS, 1000.0, 0.05), weight="w")
    off = chain.kkt(rows, fitted, n_terms=N, weight="w")
    return off.select("lambda_idx", F.round("lambda", 4).alias("lambda"), (F.col("off") <= 1e-3).alias("at_minimum"))


def _two_phases(spark, sf):
    x = labelled_li(spark, sf).select("id", "y", *LI_FEATURES)
    shown = staged(split.split_random(x, "id").select("split", "y", *LI_FEATURES), "phase-parts")
    scorer = score.column_scorer(LI_FEATURES, li_score)
    return chain.two_phases(shown, LI_FEATURES, scorer, select.lambda_path(), epochs=30)


@query()
def two_phase_summary(spark, sf):
    """A score, its additive form, a network masked to the chosen terms, and its additive form, on all parts."""
    first, second, rows = _two_phases(spark, sf)
    return tidy(chain.summary(rows, first, second, len(LI_FEATURES), replicates=20))
