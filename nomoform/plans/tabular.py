"""Queries of profiling, cleaning, encoding, scaling, splitting and combining."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import clean, combine, encode, profile, split
from .frames import DL, LI, OC, SOC, dl, draw_sql, li, oc, r6, read, scored_oc
from .registry import query

NUM = ["q", "d", "t", "price"]


def tidy(df, **places):
    """Doubles rounded, to six places unless ``places`` says otherwise."""
    kinds = dict(df.dtypes)
    return df.select(*[rounded(F.col(c), places.get(c, 6)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def _union(parts):
    return " UNION ALL ".join(parts)


@query("WITH " + LI + _union(f" SELECT '{c}' AS feature, count({c}) AS non_null, count(*) - count({c}) AS nulls, {r6(f'avg({c})', 7)} AS mean, {r6(f'median({c})')} AS median, {r6(f'stddev_samp({c})')} AS std, {r6(f'quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)')} AS iqr, {r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max, count(DISTINCT {c}) AS levels, count(DISTINCT {c}) < 15 AS is_categorical FROM li" for c in NUM))
def feature_summary(spark, sf):
    return tidy(profile.feature_summary(li(spark, sf), NUM), mean=7)


@query("WITH " + OC + ", u AS (" + _union(f"SELECT '{c}' AS feature, {c} AS level FROM oc" for c in ("seg", "pri", "status")) + f") SELECT feature, level, count(*) AS n, {r6('count(*) / sum(count(*)) OVER (PARTITION BY feature)')} AS share FROM u WHERE level IS NOT NULL GROUP BY feature, level")
def category_frequencies(spark, sf):
    return tidy(profile.category_frequencies(oc(spark, sf), ["seg", "pri", "status"]))


@query("WITH " + LI + f", e AS (SELECT min(price) AS lo, max(price) AS hi FROM li), b AS (SELECT least(floor((price - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM li, e GROUP BY 1) SELECT k::INT AS bin, {r6('lo + k * ((hi - lo) / 20)')} AS \"left\", {r6('lo + (k + 1) * ((hi - lo) / 20)')} AS \"right\", coalesce(n, 0) AS n FROM e, range(20) r(k) LEFT JOIN b ON b.bin = k")
def histogram_numeric(spark, sf):
    return tidy(profile.histogram(li(spark, sf), "price"))


@query("SELECT lang AS level, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def histogram_category(spark, sf):
    return profile.category_frequencies(dl(spark, sf), ["lang"]).select("level", "n")


@query("WITH " + OC + f", n AS (SELECT status AS split, y, count(*) AS n FROM oc GROUP BY ALL) SELECT split, y, n, {r6('n / sum(n) OVER (PARTITION BY split)')} AS share, {r6('min(n) OVER (PARTITION BY split) / sum(n) OVER (PARTITION BY split)')} AS minority_share, {r6('max(n) OVER (PARTITION BY split) / min(n) OVER (PARTITION BY split)')} AS imbalance FROM n")
def class_balance(spark, sf):
    return tidy(profile.class_balance(oc(spark, sf).withColumnRenamed("status", "split"), "split", "y"))


@query("WITH " + OC + ", u AS (" + _union(f"SELECT status AS split, '{c}' AS feature, {c} AS level FROM oc" for c in ("seg", "pri")) + f"), n AS (SELECT split, feature, level, count(*) AS n FROM u GROUP BY ALL), t AS (SELECT split, feature, count(level) AS total FROM u GROUP BY ALL), f AS (SELECT DISTINCT feature, level FROM n WHERE level IS NOT NULL) SELECT split, feature, level, {r6('coalesce(n, 0) / total')} AS share FROM f JOIN t USING (feature) LEFT JOIN n USING (split, feature, level)")
def train_test_compare(spark, sf):
    return tidy(profile.compare_splits(oc(spark, sf).withColumnRenamed("status", "split"), "split", ["seg", "pri"]))


@query("SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS distinct_ids, count(l_orderkey) - count(DISTINCT l_orderkey) AS duplicates, count(*) - count(l_orderkey) AS missing, count(DISTINCT l_orderkey) = count(*) AS is_unique FROM lineitem")
def id_uniqueness(spark, sf):
    return profile.id_uniqueness(read(spark, sf, "lineitem"), "l_orderkey")


@query("WITH " + DL + _union(f" SELECT '{c}' AS feature, bool_and({c} IN (0, 1)) AS is_binary FROM dl" for c in ("quality", "toxic", "n_chars")))
def binary_columns(spark, sf):
    return profile.binary_columns(dl(spark, sf), ["quality", "toxic", "n_chars"])


@query("WITH " + LI + _union(f" SELECT '{c}' AS feature, count(DISTINCT {c}) AS levels, {t} OR (count(DISTINCT {c}) > 2 AND count(DISTINCT {c}) < 10 AND {w}) AS is_categorical, CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary' ELSE 'multi' END AS kind FROM li" for c, t, w in (("q", "FALSE", "bool_and(q = floor(q))"), ("t", "FALSE", "bool_and(t = floor(t))"), ("rf", "TRUE", "TRUE"), ("ls", "TRUE", "TRUE"))))
def categorical_columns(spark, sf):
    return profile.categorical_columns(li(spark, sf), ["q", "t", "rf", "ls"])


@query("WITH " + LI + _union(f" SELECT '{c}' AS feature, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, {a}::DOUBLE AS lo, {b}::DOUBLE AS hi, min({c}) >= {a} AND max({c}) <= {b} AS ok FROM li" for c, a, b in (("q", 1, 50), ("d", 0, 0.05))))
def range_check(spark, sf):
    return profile.range_check(li(spark, sf), {"q": (1, 50), "d": (0, 0.05)})


@query("WITH " + OC + " SELECT count(*) AS n, sum(('0x' || substr(md5(id || '|' || seg || '|' || coalesce(pri, 'null')), 1, 8))::BIGINT)::BIGINT AS checksum FROM oc")
def table_checksum(spark, sf):
    return profile.table_checksum(oc(spark, sf), ["id", "seg", "pri"])


@query("WITH " + DL + " SELECT doc_id, coalesce(quality, 0)::DOUBLE AS quality FROM dl")
def impute_zeros(spark, sf):
    return clean.fit_zeros(["quality"]).transform(dl(spark, sf).withColumn("quality", F.col("quality").cast("double"))).select("doc_id", "quality")


@query("WITH " + DL + ", n AS (SELECT doc_id, CASE WHEN quality IS NOT NULL THEN n_chars END::DOUBLE AS x FROM dl) SELECT doc_id, coalesce(x, (SELECT median(x) FROM n)) AS x FROM n")
def impute_median(spark, sf):
    x = dl(spark, sf).select("doc_id", F.when(F.col("quality").isNotNull(), F.col("n_chars")).cast("double").alias("x"))
    return clean.fit_median(x, ["x"]).transform(x)


@query("WITH " + DL + ", n AS (SELECT doc_id, CASE WHEN quality IS NOT NULL THEN source END AS x FROM dl), m AS (SELECT x FROM n WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 1) SELECT doc_id, coalesce(x, (SELECT x FROM m)) AS x FROM n")
def impute_mode(spark, sf):
    x = dl(spark, sf).select("doc_id", F.when(F.col("quality").isNotNull(), F.col("source")).alias("x"))
    return clean.fit_mode(x, ["x"]).transform(x)


@query("WITH " + DL + f", v AS (SELECT quality, count(*) AS n FROM dl WHERE quality IS NOT NULL GROUP BY 1), r AS (SELECT quality AS v, sum(n) OVER (ORDER BY quality) AS hi, sum(n) OVER (ORDER BY quality) - n AS lo, sum(n) OVER () AS total FROM v), dd AS (SELECT doc_id, quality, {draw_sql('doc_id', 42, 'quality')} AS k FROM dl) SELECT doc_id, coalesce(quality, (SELECT v FROM r WHERE k % total >= lo AND k % total < hi)) AS quality FROM dd")
def impute_random(spark, sf):
    x = dl(spark, sf)
    return clean.impute_random(x, x, "quality", "doc_id").select("doc_id", "quality")


@query("SELECT doc_id, CASE WHEN source NOT IN ('', 'src0') AND lang <> 'de' THEN source END AS source FROM (SELECT doc_id, source, lang FROM documents)")
def empty_tokens(spark, sf):
    x = dl(spark, sf).withColumn("raw", F.when(F.col("lang") == "de", " ").when(F.col("source") == "src0", "N/A").otherwise(F.col("source")))
    return x.select("doc_id", clean.empty_to_null(F.col("raw")).alias("source"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 0 END AS target FROM events")
def target_encode(spark, sf):
    x = read(spark, sf, "events").withColumn("e", F.when(F.col("event_type").isin("view", "click"), F.col("event_type")))
    return clean.binary_target(x, "e").select("event_id", F.col("target").cast("int").alias("target"))


@query("WITH " + OC + " SELECT id, CASE pri WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE (SELECT count(*) FROM (SELECT DISTINCT pri AS p FROM oc) WHERE p < oc.pri AND p NOT IN ('3-MEDIUM', '1-URGENT')) + 2 END::INT AS code FROM oc")
def ordinal_encode(spark, sf):
    x = oc(spark, sf)
    order = encode.with_unlisted(["3-MEDIUM", "1-URGENT"], encode.levels(x, "pri"))
    return x.select("id", encode.ordinal(F.col("pri"), order).alias("code"))


@query("WITH " + OC + " SELECT id, " + ", ".join(f"(seg = '{s}')::INT AS \"seg_{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM oc")
def onehot_encode(spark, sf):
    x = oc(spark, sf).select("id", "seg")
    return encode.one_hot(x, "seg", encode.levels(x, "seg"))


def _reference(order: str) -> str:
    return "WITH " + OC + ", u AS (" + _union(f"SELECT '{c}' AS feature, {c} AS level FROM oc" for c in ("seg", "status")) + f"), n AS (SELECT feature, level, count(*) AS n FROM u GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY {order}) = 1 AS is_reference FROM n) SELECT feature, level, (CASE WHEN is_reference THEN 0 ELSE sum((NOT is_reference)::INT) OVER (PARTITION BY feature ORDER BY level) END)::INT AS code, is_reference FROM m"


@query(_reference("level"))
def reference_level_alphabetical(spark, sf):
    return encode.reference_level(oc(spark, sf), ["seg", "status"])


@query(_reference("n DESC, level"))
def reference_level_most_common(spark, sf):
    return encode.reference_level(oc(spark, sf), ["seg", "status"], "most_common")


SEGS = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_CODE = "CASE seg " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEGS, 1)) + " ELSE 0 END"


@query("WITH " + OC + f" SELECT id, {_CODE}::INT AS code FROM oc")
def collapse_codes(spark, sf):
    x = oc(spark, sf).select("id", "seg")
    dummies = encode.one_hot(x, "seg", list(SEGS))
    return dummies.select("id", encode.collapse([F.col(f"seg_{s}") for s in SEGS]).cast("int").alias("code"))


@query("WITH " + OC + ", c AS (SELECT id, " + _CODE + " AS code FROM oc) SELECT id, " + ", ".join(f"(code = {i})::INT AS \"{s}\"" for i, s in enumerate(SEGS, 1)) + " FROM c")
def expand_codes(spark, sf):
    x = collapse_codes(spark, sf)
    return x.select("id", *[c.alias(n) for n, c in encode.expand(F.col("code"), list(SEGS)).items()])


@query("WITH " + OC + " SELECT id, CASE WHEN seg IN (SELECT DISTINCT seg FROM oc WHERE status = 'F' AND seg < 'F') THEN seg END AS seg FROM oc")
def harmonise_levels(spark, sf):
    x = oc(spark, sf)
    known = x.where("status = 'F' and seg < 'F'").select(F.col("seg").alias("level")).distinct()
    return encode.harmonise(x.select("id", "seg"), "seg", known)


@query("WITH " + OC + " SELECT id, CASE WHEN seg < 'F' THEN 'Segment ' || lower(seg) ELSE seg END AS label FROM oc")
def label_lookup(spark, sf):
    x = oc(spark, sf)
    labels = x.select(F.col("seg").alias("name")).distinct().withColumn("label", F.when(F.col("name") < "F", F.concat(F.lit("Segment "), F.lower("name"))).otherwise("[USER: name]"))
    return encode.label_lookup(x.select("id", "seg"), "seg", labels).select("id", "label")


@query("WITH t AS (" + _reference("level") + ") SELECT feature AS name, 'group' AS notes, 1 AS rank FROM (SELECT DISTINCT feature FROM t) UNION ALL SELECT feature || '_' || level, CASE WHEN is_reference THEN 'reference' ELSE 'member' END, CASE WHEN is_reference THEN 2 ELSE 3 END FROM t UNION ALL SELECT 'bal', 'plain', 0 UNION ALL SELECT 'price', 'plain', 0")
def label_template(spark, sf):
    x = oc(spark, sf)
    plain = spark.createDataFrame([("bal",), ("price",)], "name string")
    return encode.label_template(encode.reference_level(x, ["seg", "status"]), plain)


@query("WITH " + LI + ", s AS (SELECT median(price) AS m, stddev_pop(price) AS s FROM li) SELECT id, " + r6("(price - m) / (s * 2.0)") + " AS price FROM li, s")
def median_std_scale(spark, sf):
    x = li(spark, sf).select("id", "price")
    return tidy(encode.fit_scaler(x, ["price"]).transform(x))


@query("WITH " + LI + " SELECT id, " + r6("price", 4) + " AS price FROM li")
def inverse_scale(spark, sf):
    x = li(spark, sf).select("id", "price")
    s = encode.fit_scaler(x, ["price"])
    return s.inverse(s.transform(x)).select("id", rounded(F.col("price"), 4).alias("price"))


@query("WITH " + OC + " SELECT count_if((seg < 'C')::INT + (status = 'F')::INT > 1.1) AS more_than_one, count_if((seg < 'C')::INT + (status = 'F')::INT = 0) AS all_zero, count(*) AS n FROM oc")
def onehot_violations(spark, sf):
    x = oc(spark, sf).select((F.col("seg") < "C").cast("int").alias("a"), (F.col("status") == "F").cast("int").alias("b"))
    return encode.violations(x, ["a", "b"])


def _split(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return "WITH " + OC + f", r AS (SELECT id, row_number() OVER ({part} ORDER BY {draw_sql('id', 42, 'split')}, id) AS k, count(*) OVER ({part}) AS n FROM oc), h AS (SELECT *, ceil(round((1 - 0.6) * n, 9)) AS held FROM r), g AS (SELECT *, ceil(round(0.2 / (1 - 0.6) * held, 9)) AS tested FROM h) SELECT id, CASE WHEN k <= n - held THEN 'train' WHEN k <= n - held + tested THEN 'test' ELSE 'val' END AS split FROM g"


@query(_split(""))
def split_random(spark, sf):
    return split.split_random(oc(spark, sf), "id").select("id", "split")


@query(_split("y"))
def split_stratified(spark, sf):
    return split.split_random(oc(spark, sf), "id", ["y"]).select("id", "split")


@query("WITH " + OC + ", b AS (SELECT year, sum(count(*)) OVER (ORDER BY year) / sum(count(*)) OVER () AS share FROM oc GROUP BY year), c AS (SELECT (SELECT year FROM b ORDER BY abs(share - 0.6), year LIMIT 1) AS a, (SELECT year FROM b ORDER BY abs(share - 0.8), year LIMIT 1) AS b) SELECT id, CASE WHEN year <= a THEN 'train' WHEN year <= b THEN 'test' ELSE 'val' END AS split FROM oc, c")
def split_temporal(spark, sf):
    return split.split_temporal(oc(spark, sf), "year").select("id", "split")


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'train' WHEN event_type = 'purchase' THEN 'test' ELSE 'val' END AS split FROM events")
def split_predefined(spark, sf):
    names = {"view": "train", "click": "train", "purchase": "test", "signup": "val", "error": "val"}
    return split.split_predefined(read(spark, sf, "events"), F.col("event_type"), names).select("event_id", "split")


@query("WITH s AS (" + _split("") + "), " + OC + " SELECT split, count(*) AS n, min(year) AS first, max(year) AS last FROM s JOIN oc USING (id) GROUP BY split")
def split_ranges(spark, sf):
    return split.ranges(split.split_random(oc(spark, sf), "id"), "year")


@query("WITH " + SOC + " SELECT id, seg, " + r6("p") + " AS p_one, CASE WHEN status = 'F' THEN " + r6("1 - p") + " END AS p_two FROM soc")
def combine_predictions(spark, sf):
    x = scored_oc(spark, sf)
    two = x.where("status = 'F'").withColumn("p", 1 - F.col("p"))
    return tidy(combine.combine_predictions(x.select("id", "seg"), {"one": x, "two": two}, "id"))


@query("WITH " + SOC + " SELECT id, seg, " + r6("p") + " AS pred_blackbox_one, " + r6("p * p") + " AS pred_prn_one, CASE WHEN status = 'F' THEN " + r6("1 - p") + " END AS pred_blackbox_two FROM soc")
def combine_files(spark, sf):
    """Three files: ids in other cases, rows that the first one lacks, and one without the id."""
    x = scored_oc(spark, sf)
    one = x.select("id", "seg", F.col("p").alias("pred_blackbox"), (F.col("p") * F.col("p")).alias("pred_prn"))
    two = x.where("status = 'F'").select(F.col("id").alias("ID"), (1 - F.col("p")).alias("pred_blackbox"), F.lit("x").alias("seg"))
    extra = two.unionByName(x.limit(1).select(F.lit(-1).cast("long").alias("ID"), F.lit(0.5).alias("pred_blackbox"), F.lit("x").alias("seg")))
    return tidy(combine.combine_files({"one": one, "two": extra, "three": x.select("seg", F.col("p").alias("pred_prn"))}, "Id"))


@query("WITH s AS (" + _split("") + ") SELECT split AS datasplit, count(*) AS n, sum(id)::BIGINT AS ids FROM s GROUP BY split")
def concat_splits(spark, sf):
    x = split.split_random(oc(spark, sf), "id")
    parts = {s: x.where(F.col("split") == s).select("id") for s in ("train", "test", "val")}
    return combine.concat_splits(parts).groupBy("datasplit").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("WITH " + OC + " SELECT seg, 'first' AS side FROM (SELECT DISTINCT seg FROM oc WHERE seg < 'G' EXCEPT SELECT DISTINCT seg FROM oc WHERE seg > 'B' ) UNION ALL SELECT seg, 'second' FROM (SELECT DISTINCT seg FROM oc WHERE seg > 'B' EXCEPT SELECT DISTINCT seg FROM oc WHERE seg < 'G')")
def level_difference(spark, sf):
    x = oc(spark, sf)
    return combine.level_difference(x.where("seg < 'G'"), x.where("seg > 'B'"), "seg")
