"""Reading the training-data tables, and writing intermediate ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from climo.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir`` (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared folder of ``spark.checkpoint.dir`` and read again.

    Cuts the lineage as ``checkpoint()`` does and survives lost executors.  Iterative plans need the table
    form: a checkpoint keeps the size estimate of its plan, and products of estimates grow without end.  The
    folders (``climo-llm/<uuid>``) stay until the shared folder is cleared.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/climo-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
