"""Session and storage helpers that the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset (tests, a single
    machine) a folder under the local temporary directory is set for the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        context.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), f"skein-{os.getuid()}"))
    return context._jsc.sc().getCheckpointDir().get()


#: Rows of a few small columns that one file of a materialized table holds, about.
FILE_ROWS = 2_000_000


def materialize(df: DataFrame, label: str = "table", rows: int | None = None, compact: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage, keeps columnar pruning and statistics, and survives the loss of
    executors. The files of a session lie under one folder named by its application id;
    ``release`` removes them.

    A table of small rows need not have a file per task: ``compact`` deals it to one file per
    core, and ``rows``, a known bound of its size, to one file per ``FILE_ROWS`` of them where
    that is far fewer than the tasks.
    """
    spark = df.sparkSession
    if rows is not None and (files := -(-max(rows, 1) // FILE_ROWS)) <= shuffle_partitions(spark) // 4:
        df = df.repartition(files)
    elif compact:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def rows_with(docs: DataFrame, keys: list[Column], found: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, whose keys equal a row of ``found``; null equals null.

    Keys are hashed within each part of a shuffle, so whole rows are dealt but not sorted.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias(f"own{i}") for i, k in enumerate(keys)])
    there = found.select(*[F.col(c).alias(f"its{i}") for i, c in enumerate(found.columns)]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"own{i}").eqNullSafe(F.col(f"its{i}")) for i in range(len(keys))])
    return own.join(there.hint("shuffle_hash"), same, "left_semi").select("row.*")


def drop_materialized(df: DataFrame) -> None:
    """Remove the files of one materialized table that no later plan reads."""
    path = getattr(df, "_skein_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Remove every table this application materialized."""
    _delete(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
