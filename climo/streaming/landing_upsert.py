"""Continuous landing-file ingest: Structured Streaming + ``foreachBatch`` upsert.

The reference refreshes its raw table by pulling a service payload and
merging it into the stored table (S2 + S10).  As a stream, each micro-batch
of landing files is coerced exactly like ``read_json_landing``, reduced to the
latest file's row per key, and merged with ``upsert_coalesce`` into a new
version of the table.  A version is the folder ``<table_dir>/v=<n>``, never the
one being read; one small row in ``<table_dir>/_commits`` (version, source,
epoch) commits it.  The next version follows the newest committed one, whatever
stream wrote it, so a stream with a new checkpoint folder goes on from the
stored table.  A batch that a stream repeats after a failure is found in the commits and
not merged twice; a version folder without a commit is written over.
"""

from __future__ import annotations

import os
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climo.functions import derive as dv
from climo.sources.ingest import DAILY_SUMMARY_RENAME, latest_per_key, upsert_coalesce

VERSION_COL = "v"
COMMITS_DIR = "_commits"
COMMIT_SCHEMA = "v long, source string, epoch long"
LOADED_COL = "_loaded"


def commits(spark: SparkSession, table_dir: str) -> DataFrame:
    """The committed versions: one row each (v, source, epoch); empty when there is no table yet.

    Only a missing path counts as no table; any other read error is raised."""
    path = os.path.join(table_dir, COMMITS_DIR)
    try:
        return spark.read.schema(COMMIT_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT_SCHEMA)


def latest_version(spark: SparkSession, table_dir: str) -> int | None:
    """The newest committed version."""
    return commits(spark, table_dir).agg(F.max(VERSION_COL)).first()[0]


def read_current(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """The newest committed version of the table; None when there is none."""
    v = latest_version(spark, table_dir)
    return None if v is None else spark.read.parquet(os.path.join(table_dir, f"{VERSION_COL}={v}"))


def merge_batch(batch: DataFrame, table_dir: str, source: str, epoch: int, keys: Sequence[str]) -> int | None:
    """Merge one batch into the table and commit it; returns the new version, None if it is committed already.

    Rows of one key are reduced to that of the newest landing file (``LOADED_COL``)."""
    spark = batch.sparkSession
    done = commits(spark, table_dir)
    if done.where((F.col("source") == source) & (F.col("epoch") == epoch)).limit(1).count():
        return None
    version = (done.agg(F.max(VERSION_COL)).first()[0] or 0) + 1
    current = read_current(spark, table_dir)
    loaded = LOADED_COL if LOADED_COL in batch.columns else None
    single = latest_per_key(batch, keys, loaded)
    merged = single if current is None else upsert_coalesce(current, single, keys)
    merged.write.mode("overwrite").parquet(os.path.join(table_dir, f"{VERSION_COL}={version}"))
    commit = spark.range(1).select(F.lit(version).cast("long").alias(VERSION_COL), F.lit(source).alias("source"),
                                   F.lit(epoch).cast("long").alias("epoch"))
    commit.coalesce(1).write.mode("append").parquet(os.path.join(table_dir, COMMITS_DIR))
    return version


def coerce_landing(df: DataFrame, rename: dict | None = DAILY_SUMMARY_RENAME,
                   numeric_cols: Sequence[str] | None = None) -> DataFrame:
    """The ``read_json_landing`` coercion as a DataFrame → DataFrame step
    (works on streaming and batch frames alike)."""
    if rename:
        df = df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})
    if "date" in df.columns:
        df = df.withColumn("date", F.to_date(F.substring(F.col("date").cast("string"), 1, 10)))
    numeric = list(numeric_cols) if numeric_cols is not None else [
        c for c in df.columns if c not in ("date", "station", "location")]
    return df.withColumns({c: dv.to_numeric(F.col(c)) for c in numeric if c in df.columns})


def start_landing_upsert(spark: SparkSession, landing_dir: str, schema: T.StructType, table_dir: str,
                         checkpoint_dir: str, keys: Sequence[str] = ("station", "date"),
                         rename: dict | None = DAILY_SUMMARY_RENAME, available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``.

    ``checkpoint_dir`` holds the stream's progress: a lasting folder that the
    driver and executors share, the same one at every start.
    """
    landed = (spark.readStream.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(landing_dir)
              .select("*", F.col("_metadata.file_modification_time").alias(LOADED_COL)))
    columns = [rename.get(c, c) if rename else c for c in schema.fieldNames()]
    stream = coerce_landing(landed, rename, [c for c in columns if c not in ("date", "station", "location")])

    def merge(batch: DataFrame, epoch_id: int) -> None:
        if not batch.isEmpty():
            merge_batch(batch, table_dir, checkpoint_dir, epoch_id, keys)

    w = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
