"""Landing scans with a quarantine, partition-wise upserts and globally sorted results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climo.session import stored
from climo.sources import ingest

CORRUPT = "_corrupt_record"


@dataclass
class Landed:
    """What a landing scan gave: clean rows, and the records that didn't parse with the file that each came from."""
    rows: DataFrame
    rejected: DataFrame


def read_landing(spark: SparkSession, path, schema: T.StructType, fmt: str = "csv", rename: dict | None = None,
                 date_format: str = "yyyy-MM-dd", **options) -> Landed:
    """CSV (with a header) or JSON files under an explicit schema; one path, a list or a glob.

    A record that doesn't fit the schema goes to ``rejected`` whole (``record``), with ``source_file`` and whatever fields
    could be read; no value of it reaches ``rows``.  Empty files give no rows.  NaN becomes NULL.
    """
    if fmt == "csv":
        options = {"header": True, "dateFormat": date_format, **options}
    read = spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
    read = read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options)
    raw = read.format(fmt).load(path).withColumn("source_file", F.col("_metadata.file_path"))
    names = [f.name for f in schema.fields]
    # Every field is parsed whatever a query reads later (the condition always holds): a record is broken or not as a whole.
    raw = raw.where(F.xxhash64(*names) >= F.lit(-(2 ** 63)))
    rows = raw.where(F.col(CORRUPT).isNull()).select(*names)
    rejected = raw.where(F.col(CORRUPT).isNotNull()).select("source_file", F.col(CORRUPT).alias("record"), *names)
    if rename:
        rows = rows.withColumnsRenamed({k: v for k, v in rename.items() if k in names})
    return Landed(ingest.nan_to_null_all(rows), rejected)


def quarantined(landed: Landed, path: str) -> DataFrame:
    """Append the rejected records to the quarantine table at ``path``; the whole table.  A file landed again adds its records again."""
    landed.rejected.write.mode("append").parquet(path)
    return landed.rejected.sparkSession.read.schema(landed.rejected.schema).parquet(path)


def merge_partitions(batch: DataFrame, path: str, parts: dict[str, Column], keys: Sequence[str] = ("station", "date"),
                     order_by: str | None = None) -> list[tuple]:
    """Upsert ``batch`` into the table at ``path``, reading and rewriting only the partitions that the batch holds.

    ``parts`` names the partition columns and derives them from key columns (year and month of the date, say), so a row
    never changes its partition.  The batch is written once below the checkpoint folder; its partitions (one row each,
    as many as the batch spans) prune the scan of the table; the merged rows are staged and then replace exactly these
    partitions (dynamic overwrite, committed at the end of the job).  A batch merged again changes nothing, so a failed job is
    simply run again.  Returns the partitions.  An empty batch touches none.
    """
    spark = batch.sparkSession
    staged = stored(batch)
    touched = [tuple(r) for r in staged.select(*[c.alias(n) for n, c in parts.items()]).distinct().collect()]
    if not touched:
        return []
    table = spark.read.parquet(path)
    label = F.concat_ws("/", *[F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in parts])
    wanted = ["/".join("-" if v is None else str(v) for v in t) for t in touched]
    existing = table.where(label.isin(wanted)).drop(*parts)
    merged = stored(ingest.upsert_coalesce(existing, staged, keys, order_by).withColumns(parts))
    (merged.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path))
    return sorted(touched)


def write_sorted(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """O1: write ``df`` in the global order of ``order``: ranges of keys in the order of the files, sorted inside each."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def sorted_rows(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """A table of ``write_sorted`` with each row's place (from 1), from the order of the files and of the rows in them."""
    rows = spark.read.parquet(path)
    names = rows.columns
    rows = rows.select(*names, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # One row per file: the only window over all of them.
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(files, "_file").select(*names, (F.col("_before") + F.col("_row") + 1).alias(position))


def order_violations(spark: SparkSession, path: str, order: Sequence[str]) -> int:
    """Places where a row of a table of ``write_sorted`` precedes a smaller one, inside files and across their bounds."""
    rows = spark.read.parquet(path)
    key = F.struct(*order)
    rows = rows.select(key.alias("k"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    inside = rows.withColumn("p", F.lag("k").over(Window.partitionBy("_file").orderBy("_row"))).where("p > k").count()
    ends = rows.groupBy("_file").agg(F.min_by("k", "_row").alias("first"), F.max_by("k", "_row").alias("last"))
    across = ends.withColumn("p", F.lag("last").over(Window.orderBy("_file"))).where("p > first").count()
    return inside + across
