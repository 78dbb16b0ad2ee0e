"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Space and the control characters 0x09 to 0x0D, the only white space that the contracts know.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one serves a local session; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sieveline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, or with underscores before it, so that no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Stored, with a number ``name`` for each row, on which all reads agree."""
    return durable(df.withColumn(name, F.monotonically_increasing_id()))


def running_total(rows: DataFrame, by: str, value: str) -> DataFrame:
    """rows (small ones, one for each ``by``) and before, the sum of ``value`` over the rows of lesser ``by``.

    Ranges of ``by`` are summed apart and only the sums of ranges are run through together, so no task holds all rows."""
    dealt = durable(rows.repartitionByRange(by).withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy("range").agg(F.sum(value).alias("whole"))
    starts = sums.select(F.col("range").alias("s_range"), F.coalesce(F.sum("whole").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("inner", inner).join(starts, F.col("range") == F.col("s_range")).withColumn("before", F.col("start") + F.col("inner")).drop("range", "s_range", "start", "inner")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unit_hash(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the key and the salt only (52 bits of MD5)."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
