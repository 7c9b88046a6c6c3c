"""Parquet tables of a data folder, and the session settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``; a lazy scan, so filters and columns are pushed to parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle whose number the engine fixes itself; follows the cluster's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where that is unset, and only on a single machine (tests), one of our
    own: a cluster without it is refused, as no folder of one machine could be read by the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.sparkContext.getCheckpointDir()
        if folder is None:
            folder = "file://" + os.path.join(tempfile.gettempdir(), "spindrift-checkpoints")
            spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows as a parquet table of the checkpoint folder, which cuts the lineage as a checkpoint does and lets readers take
    only the columns they need. Runs a job; Hadoop removes the table when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4()}.parquet"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def latest_documents(index: DataFrame) -> DataFrame:
    """One row per page of ``documents_idx``: the values of its latest ``fetched_at``.

    Ties on ``fetched_at`` are broken by url and token_count, so the result does not depend on row order; a null
    ``fetched_at`` is the oldest. Rows without ``doc_id`` are dropped. Extra columns are ignored.
    """
    order = F.struct(F.coalesce(F.col("fetched_at").cast("double"), F.lit(-1e18)).alias("at"), F.col("url"), F.col("token_count"), F.col("html_lang"))
    row = F.max(order).alias("row")
    return (
        index.filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(row)
        .select("doc_id", F.col("row.url").alias("url"), F.col("row.token_count").alias("token_count"), F.col("row.html_lang").alias("html_lang"))
    )
