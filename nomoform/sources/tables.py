"""Reading and writing tables and model artifacts."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import global_rank
from ..functions.scalars import draw


#: Files from this size on do not fit Spark's binary column.
MAX_HASHED = 2_000_000_000


def load_table(spark: SparkSession, path: str, id_: str | None = None, sample: int | None = None, seed: int = 42, form: str = "parquet") -> DataFrame:
    """Parquet, or CSV with a header and # comments; a sample of an exact size by a seeded order of ids, if the table is larger."""
    reader = spark.read.option("header", True).option("comment", "#").option("inferSchema", True)
    df = spark.read.parquet(path) if form == "parquet" else reader.csv(path)
    if sample is None:
        return df
    return global_rank(df, draw(F.col(id_), seed, "sample"), [id_]).where(F.col("rank_") <= sample).drop("rank_", "total_")


def write_splits(df: DataFrame, path: str, stamp: str, form: str = "parquet", header: dict[str, str] | None = None) -> DataFrame:
    """The parts of ``df`` under ``path/stamp=.../split=...``, a header of comments beside them; returns the hashes of the files."""
    target = f"{path}/stamp={stamp}"
    writer = df.write.mode("overwrite").partitionBy("split").format(form)
    (writer.option("header", True) if form == "csv" else writer).save(target)
    if header:
        lines = df.sparkSession.createDataFrame([(f"# {k}: {v}",) for k, v in header.items()], "value string")
        lines.coalesce(1).write.mode("overwrite").text(f"{path}/_header-{stamp}")
    return file_hashes(df.sparkSession, f"{target}/split=*/part-*")


def load_splits(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """The newest group that write_splits left under ``path``, with its column split."""
    reader = spark.read.option("basePath", path)
    df = reader.parquet(path) if form == "parquet" else reader.option("header", True).option("comment", "#").option("inferSchema", True).csv(path)
    newest = df.agg(F.max(F.col("stamp").cast("string"))).first()[0]
    return df.where(F.col("stamp").cast("string") == F.lit(newest)).drop("stamp")


def file_hashes(spark: SparkSession, glob: str) -> DataFrame:
    """path, sha256, size_bytes, computed_at and error of files, in parallel; a file of 2 GB or more has an error instead of a hash."""
    files = spark.read.format("binaryFile").load(glob)
    small = files.where(F.col("length") < MAX_HASHED)
    done = small.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), F.lit(None).cast("string").alias("error"))
    large = files.where(F.col("length") >= MAX_HASHED).select("path", F.lit(None).cast("string").alias("sha256"), F.col("length").alias("size_bytes"), F.lit("too large").alias("error"))
    return done.unionByName(large).withColumn("computed_at", F.current_timestamp())


def save_artifact(df: DataFrame, path: str, manifest: dict[str, str]) -> None:
    """A table and a one-row manifest beside it."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark = df.sparkSession
    spark.createDataFrame([(manifest,)], "manifest map<string,string>").write.mode("overwrite").parquet(f"{path}/manifest")


def load_artifact(spark: SparkSession, path: str, expected: dict[str, str], lenient: tuple[str, ...] = ("n_val",)) -> DataFrame:
    """The table, if its manifest holds what is expected; else an error that names the differences.

    Differences in ``lenient`` keys are warned of only.
    """
    have = spark.read.parquet(f"{path}/manifest").first()[0]
    wrong = {k: (have.get(k), v) for k, v in expected.items() if have.get(k) != v}
    if soft := {k: v for k, v in wrong.items() if k in lenient}:
        warnings.warn(f"stored artifact differs: {soft}", stacklevel=2)
    if hard := {k: v for k, v in wrong.items() if k not in lenient}:
        raise ValueError(f"stored artifact differs: {hard}")
    return spark.read.parquet(f"{path}/data")


def write_metadata(spark: SparkSession, text: str, path: str) -> None:
    """One JSON text as a file of a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0].strip()


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of some paths that exists, on whatever file system it names."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    return None


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """name and label of a label file; newlines may be escaped or inside quotes, and a leading byte order mark is ignored."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    name = "processed_name" if "processed_name" in df.columns else df.columns[0]
    label = "user_label" if "user_label" in df.columns else df.columns[1]
    return df.select(F.col(name).alias("name"), F.col(label).alias("label"))
