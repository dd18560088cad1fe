"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine, where the session names no folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/vecloom"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, else the checkpoint folder that is set; on one machine a folder of our own if there is neither."""
    context = spark.sparkContext
    named, given = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if named is None and given.isDefined():
        return given.get()
    if named is None and context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    if given.isEmpty():
        context.setCheckpointDir(named or LOCAL_CHECKPOINTS)
    return named or LOCAL_CHECKPOINTS


def written(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: cuts the lineage, survives lost executors.

    The table goes when the application ends; until then any result may read it again.
    """
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def mark_of(text: Column) -> Column:
    """64 bits of a text (null: empty), which tell apart rows that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def of_rows(rows: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with what was found for them, both by doc_id (null equals null) and mark."""
    other = found.withColumnsRenamed({"doc_id": "of_id", "mark": "of_mark"})
    both = rows.join(other, (F.col("mark") == F.col("of_mark")) & F.col("doc_id").eqNullSafe(F.col("of_id")), how)
    return both.drop("of_id", "of_mark")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
