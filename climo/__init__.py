"""climo — climatological time-series operators on Spark DataFrames.

Every operator is ``DataFrame -> DataFrame`` (or ``Column -> Column``) and
takes the entity key columns (``keys``, default ``["station"]``) so work is
partitioned by station and scales with stations x years.
"""

__version__ = "0.1.0"
