"""Sources and sinks: CSV or Parquet in, CSV or Parquet out."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from aislefix.functions.ids import with_prefix
from aislefix.sources import schemas


_made: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where a session on one machine keeps stage tables if it names no folder; None: such a session must name one.
local_folder: str | None = None


@dataclass(frozen=True)
class Tables:
    """The inputs of the method. ``visits`` carry a unique ``row_id`` (see ``encode.numbered``).

    Visits and query rows are numbered apart, and each side has its own prior.
    """

    shops: DataFrame
    visits: DataFrame
    query_rows: DataFrame
    prior_train: DataFrame
    prior_answer: DataFrame


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """A file with exactly these columns; a cell that does not parse, or another header, fails the job."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    return reader.format(fmt).load(path)


def read_shops(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.SHOPS, fmt)


def read_visits(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.VISITS, fmt)


def read_query_rows(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.QUERY_ROWS, fmt)


def read_prior(spark: SparkSession, path: str, fmt: str = "csv", labelled: bool = True) -> DataFrame:
    return read_table(spark, path, schemas.PRIOR_TRAIN if labelled else schemas.PRIOR_ANSWER, fmt)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_answer(answer: DataFrame, path: str) -> None:
    """``row_id,shop_id`` as text, one line per query row; without an answer the shop is empty."""
    write_table(answer.select(answer.row_id.cast("string").alias("row_id"), "shop_id"), path, "csv")


def with_shop_id(df: DataFrame) -> DataFrame:
    """Replace the numeric ``shop_no`` by the textual ``shop_id``."""
    return df.withColumn("shop_no", with_prefix("s", "shop_no")).withColumnRenamed("shop_no", "shop_id")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stage table or model, in the place the session names in ``spark.checkpoint.dir``.

    Every executor must reach that place, so a cluster's session must name it;
    ``local_folder`` serves a session on one machine only.
    ``remove_run_folders`` takes away what a session made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        base = local_folder
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove_run_folders(spark: SparkSession) -> int:
    """Delete the folders handed out by ``shared_folder`` so far; frames that read them are then unusable."""
    removed = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        removed += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return removed


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed inside leaves no shuffle files: they would stay on disk until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and read it back, so that later passes neither recompute nor depend on its lineage.

    With ``partition_by`` later filters on those columns prune files; rows are
    rebalanced first, so that a folder gets few files and a large one several tasks.
    """
    path = shared_folder(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        if partition_by:
            df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(path)
        else:
            write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
