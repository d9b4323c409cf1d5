"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Word separators of every operator here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fleetwatch-llm-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """As one side of a join: both sides are shuffled and sorted.

    Spark sizes a table by its compressed files and takes no account of rows an
    explode has made, so it would broadcast tables that grow with the documents.
    """
    return df.hint("merge")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, so that long texts don't add up in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def words_of(text: Column) -> Column:
    """Words of a whole text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), "")


def row_of(df: DataFrame) -> Column:
    """The whole row as one struct: its names can't clash with working columns."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def unrow(df: DataFrame, like: DataFrame, row: str = "row", **replaced: Column) -> DataFrame:
    """The columns of a packed row again, some of them replaced."""
    return df.select(*(replaced[c].alias(c) if c in replaced else F.col(row).getField(c).alias(c) for c in like.columns))
