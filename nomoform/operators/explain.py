"""Contributions of the selected terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import counted_percentiles
from ..functions.scalars import sigmoid, stable_logit
from ..functions.storage import staged


def contributions(responses: DataFrame, betas: DataFrame) -> DataFrame:
    """Rows (id, term, phi) with c = beta * phi; ``betas`` (term, beta) is one row per selected term."""
    return responses.join(F.broadcast(betas), "term").withColumn("c", F.col("beta") * F.col("phi"))


def additive_prediction(contrib: DataFrame, id_: list[str], intercept: float) -> DataFrame:
    return contrib.groupBy(*id_).agg(sigmoid(F.sum("c") + intercept).alias("p"))


def row_explanation(contrib: DataFrame, id_: list[str]) -> DataFrame:
    """Terms of each row by the size of their contribution."""
    return contrib.withColumn("rank", F.row_number().over(Window.partitionBy(*id_).orderBy(F.desc(F.round(F.abs("c"), 9)), "term")))


def check_explanation(contrib: DataFrame, id_: list[str], intercept: float, scored: DataFrame, tol: float = 1e-2) -> DataFrame:
    """id, summed (intercept and contributions), logit (of the score p) and whether they agree within ``tol``, for every row."""
    total = contrib.groupBy(*id_).agg((F.sum("c") + intercept).alias("summed"))
    both = scored.select(*id_, stable_logit(F.col("p")).alias("logit")).join(total, id_, "left")
    summed = F.coalesce("summed", F.lit(float(intercept)))
    return both.select(*id_, summed.alias("summed"), "logit", (F.abs(summed - F.col("logit")) <= tol).alias("agrees"))


def unweighted(responses: DataFrame, terms: list[int]) -> DataFrame:
    """The responses themselves as contributions, for a model without a selection."""
    return responses.where(F.col("term").isin(*terms)).withColumn("c", F.col("phi"))


def full_matrix(contrib: DataFrame, pairs: dict[int, tuple[int, int]], n_features: int) -> DataFrame:
    """i, j, mean for all pairs of features, symmetric, 0 where there is no term."""
    cells = contrib.sparkSession.range(n_features * n_features).select((F.col("id") / n_features).cast("int").alias("i"), (F.col("id") % n_features).cast("int").alias("j"))
    return cells.join(F.broadcast(interaction_matrix(contrib, pairs)), ["i", "j"], "left").select("i", "j", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def mean_contributions(contrib: DataFrame) -> DataFrame:
    m = contrib.groupBy("term").agg(F.avg(F.abs("c")).alias("mean_abs"), F.avg("c").alias("mean"))
    return m.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("mean_abs", 9)), "term")))


def quartiles(contrib: DataFrame) -> DataFrame:
    """Quartiles, mean and extremes of each term's contributions, from the counts of its distinct ones."""
    counts = staged(contrib.where("c is not null").groupBy("term", "c").agg(F.count("*").alias("n")), "contribution-counts")
    q = counted_percentiles(counts, "c", "n", ["term"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    mean = F.sum(F.col("c") * F.col("n")) / F.sum("n")
    return q.join(counts.groupBy("term").agg(mean.alias("mean"), F.min("c").alias("min"), F.max("c").alias("max")), "term")


def interaction_matrix(contrib: DataFrame, pairs: dict[int, tuple[int, int]]) -> DataFrame:
    """Mean contribution of each pair, both ways round."""
    m = contrib.where(F.col("term").isin(*pairs)).groupBy("term").agg(F.avg("c").alias("mean"))
    at = lambda k: F.element_at(F.create_map(*[F.lit(x) for t, p in pairs.items() for x in (t, p[k])]), F.col("term"))
    one = m.select(at(0).alias("i"), at(1).alias("j"), "mean")
    return one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "mean"))


def correlation(contrib: DataFrame, id_: list[str], terms: list[int]) -> DataFrame:
    """Pearson correlation of the contributions of two terms over the rows."""
    wide = contrib.groupBy(*id_).agg(*[F.max(F.when(F.col("term") == t, F.col("c"))).alias(f"c{t}") for t in terms])
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(f"c{a}", f"c{b}").alias("r")) for a in terms for b in terms]
    return wide.agg(F.array(*pairs).alias("s")).select(F.inline("s"))
