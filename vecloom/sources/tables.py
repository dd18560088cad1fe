"""Readers and writers for matrices and sparse triplets in any format that Spark reads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.vector import doubles


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", **options) -> None:
    df.write.format(kind).mode(mode).options(**options).save(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_from_columns(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """row_id, features: a matrix from a table of numeric columns."""
    return df.select(F.col(id_col).cast("long").alias("row_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))


def rows_from_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """row_id, features: a matrix from a column of arrays."""
    return df.select(F.col(id_col).cast("long").alias("row_id"), doubles(F.col(vector_col)).alias("features"))


#: Rows that travel from the driver at once, and rows of a piece of them.
CHUNK_ROWS = 1_000_000
PIECE_ROWS = 20_000


def fetched(df: DataFrame) -> Iterator[list[np.ndarray]]:
    """The numeric columns of df on the driver, in its order: one partition at a time as packed bytes, not as rows."""

    def pack(batches):
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=names)

    names, kinds = df.columns, [{"bigint": np.int64, "int": np.int32, "double": np.float64}[k] for _, k in df.dtypes]
    for row in df.mapInArrow(pack, ", ".join(f"{c} binary" for c in names)).toLocalIterator():
        yield [np.frombuffer(x, k) for x, k in zip(row, kinds)]


def sent(spark: SparkSession, chunks: Iterator[pa.Table]) -> DataFrame:
    """A table of the driver's chunks of numeric columns, which travel as packed bytes; if there is more than one, each goes to the shared folder before the next is made."""
    chunks = iter(chunks)
    first, second = next(chunks), next(chunks, None)
    if second is None:
        return _unpacked(spark, first)
    path = f"{_shared(spark)}/sent-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    for chunk in chain((first, second), chunks):
        frame = _unpacked(spark, chunk)
        frame.write.mode("append").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _unpacked(spark: SparkSession, chunk: pa.Table) -> DataFrame:
    names, kinds = chunk.column_names, [t.to_pandas_dtype() for t in chunk.schema.types]
    cut = range(0, chunk.num_rows, PIECE_ROWS)
    pieces = pa.table({c: pa.array([chunk[c].slice(a, PIECE_ROWS).to_numpy().tobytes() for a in cut], pa.binary()) for c in names})

    def unpack(batches):
        for batch in batches:
            for piece in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, k)) for x, k in zip(piece, kinds)], names=names)

    told = {np.int64: "long", np.float64: "double"}
    return spark.createDataFrame(pieces).mapInArrow(unpack, ", ".join(f"{c} {told[k]}" for c, k in zip(names, kinds)))


def _shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; on one machine one of our own if none is named."""
    context = spark.sparkContext
    named, given = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if named is None and given.isDefined():
        return given.get()
    if named is None and context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    return named or "/tmp/checkpoints/vecloom"
