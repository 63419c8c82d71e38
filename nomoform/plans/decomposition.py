"""Queries of responses, grids and nomogram tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import stable_logit
from ..operators import decompose, nomogram
from .frames import LI, LI_FEATURES, li, li_score, r6, z_sql
from .registry import query
from .tabular import tidy

EPS = 1e-7
REFERENCE = {"q": 25.0137, "d": 0.05031, "t": 0.04017}
BETAS = [(0, 0.9137), (1, 1.1271), (3, 0.4733)]


def logit_sql(q: str, d: str, t: str) -> str:
    p = f"least(greatest(1 / (1 + exp(-{z_sql(q, d, t)})), {EPS}), {1 - EPS})"
    return f"ln({p} / (1 - {p}))"


_BACK = LI + ", bg AS (SELECT q, d, t, count(*) AS w FROM li GROUP BY q, d, t), z0 AS (SELECT sum(w * " + logit_sql("q", "d", "t") + ") / sum(w) AS phi0 FROM bg)"
_AT = {0: ("g.vi", "bg.d", "bg.t"), 1: ("bg.q", "g.vi", "bg.t"), 2: ("bg.q", "bg.d", "g.vi"), 3: ("g.vi", "g.vj", "bg.t"), 4: ("g.vi", "bg.d", "g.vj"), 5: ("bg.q", "g.vi", "g.vj")}
_PAIR = {3: (0, 1), 4: (0, 2), 5: (1, 2)}
_VALUES = "gv AS (" + " UNION ALL ".join([f"SELECT DISTINCT {i} AS term, {f} AS vi, NULL::DOUBLE AS vj FROM li" for i, f in enumerate("qdt")] + [f"SELECT DISTINCT {t}, {'qdt'[a]}, {'qdt'[b]} FROM li" for t, (a, b) in _PAIR.items()]) + ")"


def _raw(grid: str, source: str, weight: str) -> str:
    return "raw AS (" + " UNION ALL ".join(f"SELECT {t} AS term, g.vi, g.vj, sum({weight} * {logit_sql(*a)}) / sum({weight}) AS z FROM {grid} g, {source} bg WHERE g.term = {t} GROUP BY g.vi, g.vj" for t, a in _AT.items()) + ")"


_PHI = "dd AS (SELECT term, vi, vj, z - phi0 AS d FROM raw, z0), phi AS (SELECT term, vi, vj, d AS phi FROM dd WHERE vj IS NULL UNION ALL " + " UNION ALL ".join(f"SELECT x.term, x.vi, x.vj, x.d - a.d - b.d FROM dd x JOIN dd a ON a.term = {a} AND a.vi = x.vi JOIN dd b ON b.term = {b} AND b.vi = x.vj WHERE x.term = {t}" for t, (a, b) in _PAIR.items()) + ")"
LEBESGUE = "WITH " + ", ".join([_BACK, _VALUES, _raw("gv", "bg", "bg.w"), _PHI])
_REF = LI + ", rf0 AS (SELECT 25.0137::DOUBLE AS q, 0.05031::DOUBLE AS d, 0.04017::DOUBLE AS t, 1 AS w), z0 AS (SELECT " + logit_sql("q", "d", "t") + " AS phi0 FROM rf0)"
DIRAC = "WITH " + ", ".join([_REF, _VALUES, _raw("gv", "rf0", "bg.w"), _PHI])

def _even(lo: str, hi: str) -> str:
    """The grid of each feature, between two aggregates of it."""
    return "ge AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, k, v AS value FROM (SELECT (row_number() OVER (ORDER BY v) - 1)::INT AS k, v FROM (SELECT DISTINCT {f} AS v FROM li)) WHERE (SELECT count(DISTINCT {f}) FROM li) < 15 UNION ALL SELECT '{f}', k::INT, lo + (hi - lo) * k / 14 FROM (SELECT {lo.format(f)} AS lo, {hi.format(f)} AS hi, count(DISTINCT {f}) AS n FROM li), range(15) r(k) WHERE n >= 15" for f in "qdt") + ")"


_EVEN = _even("min({})", "max({})")
_PRODUCT = "gv AS (" + " UNION ALL ".join([f"SELECT {i} AS term, value AS vi, NULL::DOUBLE AS vj FROM ge WHERE feature = '{f}'" for i, f in enumerate("qdt")] + [f"SELECT {t}, a.value, b.value FROM ge a, ge b WHERE a.feature = '{'qdt'[x]}' AND b.feature = '{'qdt'[y]}'" for t, (x, y) in _PAIR.items()]) + ")"
GRID_LEBESGUE = "WITH " + ", ".join([_BACK, _EVEN, _PRODUCT, _raw("gv", "bg", "bg.w"), _PHI])
GRID_SHOWN = "WITH " + ", ".join([_BACK, _even("quantile_cont({}, 0.05)", "quantile_cont({}, 0.95)"), _PRODUCT, _raw("gv", "bg", "bg.w"), _PHI])
GRID_DIRAC = "WITH " + ", ".join([_REF, _EVEN, _PRODUCT, _raw("gv", "rf0", "bg.w"), _PHI])
_OUT = f" SELECT term, {r6('vi')} AS vi, {r6('vj')} AS vj, {r6('phi')} AS phi FROM phi"


def lebesgue(spark, sf, which=None):
    return decompose.lebesgue(li(spark, sf), LI_FEATURES, li_score, which=which)


def singles(features=LI_FEATURES):
    """The single terms of ``features`` alone, with their numbers in the full list."""
    return [t for t in decompose.terms(LI_FEATURES) if t[2] is None and t[1] in features]


def dirac(spark, sf, which=None):
    return decompose.dirac(li(spark, sf), LI_FEATURES, li_score, REFERENCE, which=which)


def grid(spark, sf):
    return decompose.product_grid(decompose.even_grid(li(spark, sf), LI_FEATURES), LI_FEATURES)


@query("WITH " + _BACK + f" SELECT {r6('phi0')} AS phi0 FROM z0")
def lebesgue_baseline(spark, sf):
    return tidy(decompose.baseline(decompose.background(li(spark, sf), LI_FEATURES), LI_FEATURES, li_score))


@query(LEBESGUE + _OUT + " WHERE vj IS NULL")
def lebesgue_univariate(spark, sf):
    return tidy(lebesgue(spark, sf, singles()))


@query(LEBESGUE + _OUT + " WHERE vj IS NOT NULL")
def lebesgue_bivariate(spark, sf):
    return tidy(lebesgue(spark, sf).where("vj is not null"))


_LONG = ", long AS (" + " UNION ALL ".join([f"SELECT id, phi.term, phi FROM li JOIN phi ON term = {i} AND vi = {f}" for i, f in enumerate("qdt")] + [f"SELECT id, phi.term, phi FROM li JOIN phi ON term = {t} AND vi = {'qdt'[a]} AND vj = {'qdt'[b]}" for t, (a, b) in _PAIR.items()]) + ")"


@query(LEBESGUE + _LONG + f" SELECT id, term, {r6('phi')} AS phi FROM long")
def response_table(spark, sf):
    return tidy(decompose.to_rows(li(spark, sf), ["id"], LI_FEATURES, lebesgue(spark, sf)))


@query(LEBESGUE + _LONG + ", s AS (SELECT id, sum(phi) AS s FROM long GROUP BY id), e AS (SELECT abs(s + phi0 - " + logit_sql("q", "d", "t") + f") AS e FROM li JOIN s USING (id), z0) SELECT count(*) AS n, {r6('max(e)')} AS worst, {r6('avg(e)')} AS mean FROM e")
def reconstruction_error(spark, sf):
    x = li(spark, sf)
    responses, phi0 = decompose.with_baseline(x, LI_FEATURES, li_score)
    sums = decompose.to_rows(x, ["id"], LI_FEATURES, responses).groupBy("id").agg(F.sum("phi").alias("s"))
    e = F.abs(F.col("s") + F.col("phi0") - stable_logit(li_score({f: F.col(f) for f in LI_FEATURES})))
    return tidy(x.join(sums, "id").crossJoin(F.broadcast(phi0)).agg(F.count("*").alias("n"), F.max(e).alias("worst"), F.avg(e).alias("mean")))


@query(DIRAC + _OUT + " WHERE vj IS NULL")
def dirac_univariate(spark, sf):
    return tidy(dirac(spark, sf, singles()))


@query(DIRAC + _OUT + " WHERE vj IS NOT NULL")
def dirac_bivariate(spark, sf):
    return tidy(dirac(spark, sf).where("vj is not null"))


@query("WITH " + LI + ", " + _EVEN + f" SELECT feature, k, {r6('value')} AS value FROM ge")
def feature_grid(spark, sf):
    return tidy(decompose.even_grid(li(spark, sf), LI_FEATURES))


@query(GRID_DIRAC + _OUT)
def grid_responses_dirac(spark, sf):
    return tidy(decompose.dirac(li(spark, sf), LI_FEATURES, li_score, REFERENCE, grid(spark, sf)))


@query(GRID_LEBESGUE + _OUT)
def grid_responses_lebesgue(spark, sf):
    return tidy(decompose.lebesgue(li(spark, sf), LI_FEATURES, li_score, grid(spark, sf)))


_BETA = ", be(term, beta) AS (VALUES " + ", ".join(map(str, BETAS)) + "), cu AS (SELECT term, vi, vj, beta * phi AS r FROM phi JOIN be USING (term))"


def _curves(spark, sf, which=None):
    full = decompose.lebesgue(li(spark, sf), LI_FEATURES, li_score, grid(spark, sf), which)
    return nomogram.curves(full, spark.createDataFrame(BETAS, "term int, beta double"))


@query(GRID_LEBESGUE + _BETA + f" SELECT term, {r6('vi')} AS vi, {r6('r')} AS r FROM cu WHERE vj IS NULL")
def nomogram_curves(spark, sf):
    return tidy(_curves(spark, sf, singles()).select("term", "vi", "r"))


@query(GRID_LEBESGUE + _BETA + f" SELECT term, {r6('vi')} AS vi, {r6('vj')} AS vj, {r6('r')} AS r FROM cu WHERE vj IS NOT NULL")
def nomogram_pairs(spark, sf):
    return tidy(_curves(spark, sf).where("vj is not null"))


_ENDS = ", en AS (SELECT min(r) - (max(r) - min(r)) * 0.05 AS lo, max(r) + (max(r) - min(r)) * 0.05 AS hi FROM cu)"


@query(GRID_LEBESGUE + _BETA + _ENDS + f", tk AS (SELECT k::INT AS k, greatest(lo, -4.595 + 0.5317) + (least(hi, 4.595 + 0.5317) - greatest(lo, -4.595 + 0.5317)) * k / 10 AS tick FROM en, range(11) r(k)) SELECT k, {r6('tick')} AS tick, {r6('1 / (1 + exp(-(tick - 0.5317)))')} AS p FROM tk")
def conversion_line(spark, sf):
    return tidy(nomogram.conversion_line(nomogram.common_range(_curves(spark, sf)), -0.5317))


@query(GRID_LEBESGUE + _BETA + f" SELECT term, {r6('vi')} AS vi, {r6('exp(r)')} AS odds_ratio, {r6('(r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) * 100')} AS points FROM cu WHERE vj IS NULL")
def odds_ratio_curves(spark, sf):
    one = nomogram.odds_ratios(_curves(spark, sf, singles()))
    return tidy(nomogram.points(one).select("term", "vi", "odds_ratio", "points"))


_SEG = ", sg AS (SELECT term, vi, r, lead(vi) OVER w AS vi2, lead(r) OVER w AS r2 FROM cu WHERE vj IS NULL WINDOW w AS (PARTITION BY term ORDER BY vi))"


def _interp(term: int, x: str) -> str:
    return f"(SELECT max(CASE WHEN s.vi2 IS NULL OR s.vi2 = s.vi THEN s.r ELSE s.r + (li.{x} - s.vi) * (s.r2 - s.r) / (s.vi2 - s.vi) END) FROM sg s WHERE s.term = {term} AND s.vi = (SELECT max(vi) FROM sg z WHERE z.term = {term} AND z.vi <= li.{x}))"


@query(GRID_LEBESGUE + _BETA + _SEG + f", u AS (SELECT DISTINCT q, d FROM li), v AS (SELECT q, d, {_interp(0, 'q')} + {_interp(1, 'd')} AS s FROM u AS li) SELECT id, {r6('1 / (1 + exp(-(s - 0.5)))')} AS p FROM li JOIN v USING (q, d)")
def nomogram_score(spark, sf):
    one = _curves(spark, sf, singles(["q", "d"])).collect()  # curves of bounded grids
    at = lambda t: [(r["vi"], r["r"]) for r in one if r["term"] == t]
    return tidy(nomogram.score_rows(li(spark, sf), {"q": at(0), "d": at(1)}, -0.5).select("id", "p"))


_CELLS = ", ".join(f"(SELECT max(r) FROM cu WHERE term = 3 AND vi = c.{x} AND vj = c.{y}) AS r_{x}_{y}" for x in ("x0", "x1") for y in ("y0", "y1"))
_BILINEAR = (
    ", u AS (SELECT DISTINCT q, d FROM li), b AS (SELECT q, d, (SELECT max(vi) FROM cu WHERE term = 3 AND vi <= q) AS x0, (SELECT min(vi) FROM cu WHERE term = 3 AND vi > q) AS x2,"
    " (SELECT max(vj) FROM cu WHERE term = 3 AND vj <= d) AS y0, (SELECT min(vj) FROM cu WHERE term = 3 AND vj > d) AS y2 FROM u),"
    " c AS (SELECT *, coalesce(x2, x0) AS x1, coalesce(y2, y0) AS y1, CASE WHEN x2 IS NULL THEN 0 ELSE (q - x0) / (x2 - x0) END AS t, CASE WHEN y2 IS NULL THEN 0 ELSE (d - y0) / (y2 - y0) END AS s FROM b),"
    f" e AS (SELECT q, d, t, s, {_CELLS} FROM c), pr AS (SELECT q, d, (1 - t) * ((1 - s) * r_x0_y0 + s * r_x0_y1) + t * ((1 - s) * r_x1_y0 + s * r_x1_y1) AS r FROM e)"
)


@query(GRID_LEBESGUE + _BETA + _SEG + _BILINEAR + f", v AS (SELECT li.q, li.d, {_interp(0, 'q')} + {_interp(1, 'd')} AS one FROM u AS li) SELECT id, {r6('1 / (1 + exp(-(one + r - 0.5)))')} AS p FROM li JOIN v USING (q, d) JOIN pr USING (q, d)")
def nomogram_pair_score(spark, sf):
    """Rows scored from the curves of q and d and the grid of their pair."""
    which = decompose.terms(LI_FEATURES, pairs=[("q", "d")])
    points: dict = {}
    for r in _curves(spark, sf, which).collect():  # bounded by the grid steps
        points.setdefault(r["term"], []).append((r["vi"], r["vj"], r["r"]))
    tables = [nomogram.Table(a, b, points[t]) for t, a, b in which]
    return tidy(nomogram.score_tables(li(spark, sf), tables, -0.5).select("id", "p"))


@query(GRID_LEBESGUE + _BETA + f" SELECT term, 'term' || term AS name, {r6('vi')} AS vi, {r6('vj')} AS vj, {r6('r')} AS r FROM cu")
def nomogram_json(spark, sf):
    docs = nomogram.to_json(_curves(spark, sf), {t: f"term{t}" for t in range(6)}, -0.5)
    return tidy(nomogram.from_json(docs))


@query("WITH " + LI + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT {i} AS idx, '{f}' AS feature, CASE WHEN count(DISTINCT {f}) < 15 THEN 'categorical' ELSE 'continuous' END AS kind, count(DISTINCT {f}) AS levels, min({f}) AS min, max({f}) AS max FROM li" for i, f in enumerate("qdt")) + ")")
def feature_metadata(spark, sf):
    return nomogram.feature_metadata(li(spark, sf), LI_FEATURES)
