"""Running totals (W7-W9) and to-date summaries.

Cumulative windows are partitioned by (station, calendar, metric, year[,
month]); each group holds at most 366 rows, so no task ever sorts more than
one station-year of one metric.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str],
                value_col: str, out_col: str, fill_null: float | None = 0.0) -> DataFrame:
    """Cumulative sum in ``order_cols`` order within each partition (NULL → fill first)."""
    v = F.coalesce(F.col(value_col), F.lit(fill_null)) if fill_null is not None else F.col(value_col)
    w = (Window.partitionBy(*partition_cols).orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out_col, F.sum(v).over(w))


def month_to_date(long_df: DataFrame, keys: Sequence[str] = ("station",),
                  out_col: str = "month_to_date_precip") -> DataFrame:
    """Month-to-date running total per (station, metric, year, month)."""
    return running_sum(long_df, [*keys, "metric_name", "year_for_dash", "month"], ["date"],
                       "metric_value", out_col)


def year_to_date(long_df: DataFrame, keys: Sequence[str] = ("station",),
                 out_col: str = "year_to_date_precip") -> DataFrame:
    """Year-to-date running total per (station, calendar, metric, year)."""
    return running_sum(long_df, [*keys, "year_type", "metric_name", "year_for_dash"],
                       ["day_of_year_dash", "date"], "metric_value", out_col)


def season_to_date(df: DataFrame, value_col: str = "snow", keys: Sequence[str] = ("station",),
                   season_col: str = "snow_season", order_col: str = "date",
                   out_col: str = "snow_to_date") -> DataFrame:
    """Season-to-date running total (e.g. snow since Aug 1)."""
    return running_sum(df, [*keys, season_col], [order_col], value_col, out_col)


def to_date_median(df: DataFrame, value_col: str, by: Sequence[str],
                   out_col: str = "median_to_date") -> DataFrame:
    """Median of a running total across seasons at each season day."""
    return df.groupBy(*by).agg(F.median(value_col).alias(out_col))
