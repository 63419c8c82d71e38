"""Helpers shared by the text operators: written tables, bounded broadcasts, array idioms."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace between words, everywhere in this package.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. One of its own is made only on a local master, where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def local_path(spark: SparkSession) -> str | None:
    """The shared folder as a path of the file system, if it is one."""
    folder = shared_dir(spark)
    return folder.removeprefix("file://").removeprefix("file:") if folder.startswith(("/", "file:")) else None


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Lineage ends at a table that outlives any executor, and Parquet keeps only
    the encoded columns, unlike ``checkpoint()``, which writes whole rows.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Catalyst inlines columns into lambdas, where they would be evaluated again
    for every element; a one-element array makes it a lambda variable instead.
    """
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """The words of a text (null: none), as an array of strings."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def small_join(big: DataFrame, small: DataFrame, keys: list[str], max_rows: int = 50_000, salts: int = 32) -> DataFrame:
    """Left join with a table that is broadcast only if it has at most ``max_rows`` rows.

    Beyond that the big side is salted and the small side repeated per salt, so
    that a key with a third of all rows is spread over ``salts`` tasks. Keys
    must not be null on either side.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), keys, "left")
    big = big.withColumn("_salt", (F.rand(7) * salts).cast("int"))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.join(small, [*keys, "_salt"], "left").drop("_salt")


#: Bits of a hash that a bitmap of hashes tells apart: 8 MB in rows of 4 kB, whatever the data.
BITMAP = 1 << 26


def _bit(h: Column) -> Column:
    return F.pmod(h, F.lit(BITMAP))


def hash_bitmap(hashes: DataFrame, h: str = "h") -> DataFrame:
    """A bitmap of the hashes of a table, for :func:`may_hold`; its size does not depend on the table's."""
    bit = _bit(F.col(h))
    return hashes.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))


def may_hold(df: DataFrame, bitmap: DataFrame, h: str = "h") -> DataFrame:
    """The rows of ``df`` whose hash may be in the bitmap: all that are, and a few more, more of them if it is full."""
    bit = _bit(F.col(h))
    at = F.bitmap_bit_position(bit)
    joined = df.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bitmap), "_bucket")
    byte = F.conv(F.hex(F.substr("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0
    return joined.where(set_).drop("_bucket", "_bits")
