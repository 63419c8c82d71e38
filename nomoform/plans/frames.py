"""The frames that queries run on, for Spark and as SQL: line items, orders with customers, labelled documents, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles
from ..functions.scalars import draw, rounded, sigmoid

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
LI_FEATURES = ["q", "d", "t"]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def with_median_target(df: DataFrame, value: str) -> DataFrame:
    """y: 1 above the median of ``value``."""
    middle = exact_percentiles(df, [value], [0.5])[value][0]
    return df.withColumn("y", (F.col(value) > F.lit(middle)).cast("int"))


def li_rows(spark: SparkSession, sf: str) -> DataFrame:
    """li without y, whose median takes passes of its own."""
    return read(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("id"),
        F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"),
        F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), F.col("l_extendedprice").alias("price"),
    )


def li(spark: SparkSession, sf: str) -> DataFrame:
    return with_median_target(li_rows(spark, sf), "price")


def li_score(at: dict[str, Column]) -> Column:
    q, d, t = at["q"], at["d"], at["t"]
    return sigmoid(-1.5193 + q * 0.05317 + d * 6.0913 - t * 9.1377 + q * d * 0.41731)


def with_li_score(x: DataFrame) -> DataFrame:
    return x.withColumn("p", rounded(li_score({f: F.col(f) for f in LI_FEATURES}), 9))


def scored_li(spark: SparkSession, sf: str) -> DataFrame:
    return with_li_score(li(spark, sf))


def labelled_li(spark: SparkSession, sf: str) -> DataFrame:
    """scored_li with a label drawn by its score, so that there is something to select and to learn."""
    return with_li_score(li_rows(spark, sf)).withColumn("y", (draw(F.col("id"), 42, "label") < F.col("p") * (1 << 32)).cast("int"))


def oc(spark: SparkSession, sf: str) -> DataFrame:
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    x = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("c_acctbal") / 1000).cast("double").alias("bal"), F.col("c_mktsegment").alias("seg"),
        F.col("o_orderpriority").alias("pri"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price"),
    )
    return with_median_target(x, "price")


def scored_oc(spark: SparkSession, sf: str) -> DataFrame:
    code = F.substring("pri", 1, 1).cast("double")
    z = -0.6 + F.col("bal") * 0.1 + code * 0.2 - F.length("seg") * 0.05 + F.col("bal") * code * 0.01
    return oc(spark, sf).withColumn("p", rounded(sigmoid(z), 9))


def dl(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return d.join(read(spark, sf, "labels"), "doc_id", "left")


LI = """li AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || round(l_extendedprice * 100)::BIGINT AS id, l_quantity AS q, l_discount AS d, l_tax AS t,
  l_returnflag AS rf, l_linestatus AS ls, l_extendedprice AS price,
  (l_extendedprice > (SELECT median(l_extendedprice) FROM lineitem))::INT AS y FROM lineitem)"""


def z_sql(q: str = "q", d: str = "d", t: str = "t") -> str:
    return f"(-1.5193 + {q} * 0.05317 + {d} * 6.0913 - {t} * 9.1377 + {q} * {d} * 0.41731)"


SLI = LI + f", sli AS (SELECT *, round(1 / (1 + exp(-{z_sql()})), 9) AS p FROM li)"
OC = """oc AS (SELECT o_orderkey AS id, floor(c_acctbal / 1000)::DOUBLE AS bal, c_mktsegment AS seg, o_orderpriority AS pri, o_orderstatus AS status,
  year(o_orderdate)::INT AS year, o_totalprice AS price, (o_totalprice > (SELECT median(o_totalprice) FROM orders))::INT AS y
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
SOC = OC + """, soc AS (SELECT *, round(1 / (1 + exp(-(-0.6 + bal * 0.1 + substr(pri, 1, 1)::DOUBLE * 0.2 - length(seg) * 0.05 + bal * substr(pri, 1, 1)::DOUBLE * 0.01))), 9) AS p FROM oc)"""
DL = "dl AS (SELECT doc_id, n_chars, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


def draw_sql(id_: str, seed: int, tag: str) -> str:
    return f"('0x' || substr(md5({id_} || ':{seed}:{tag}'), 1, 8))::BIGINT"


LLI = SLI + f", lli AS (SELECT * EXCLUDE (y), ({draw_sql('id', 42, 'label')} < p * {1 << 32})::INT AS y FROM sli)"


def r6(x: str, places: int = 6) -> str:
    return f"(round({x}, {places}) + 0.0)"
