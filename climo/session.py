"""Spark session helpers.

The library never builds its own session inside an operator; callers pass a
``SparkSession``.  ``get_spark`` is a convenience for tests, benches and
scripts.  On a cluster the session (and ``spark.checkpoint.dir``) come from
the cluster configuration; we only fill in a local checkpoint folder when the
setting is absent (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE converts a sort-merge join to a broadcast join only when the
    # materialised side is below this size: the runtime size check behind
    # every non-hinted broadcast in the library.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # Array and percentile buffers stay in a hash table for so many groups of a task
    # before Spark sorts the rows instead (the groups here hold one row per year).
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "climo",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the cluster (a shared file system path); a
    session on a cluster without it is refused, since executors can't read
    the driver's own folders.  Only for a ``local`` master (tests, laptops) is
    a folder made under the system temp folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the context
        sc = None
    if not path and sc is not None:
        path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="climo-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # noqa: BLE001 - a session that refuses the setting keeps its own
            pass
    if sc is not None:
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike a local checkpoint) because the data
    is written to the folder named by ``spark.checkpoint.dir``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A small table written as Parquet below the shared checkpoint folder and read again.

    Unlike a checkpoint it has a known size, so the planner broadcasts it only when its file is below the threshold.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/climo-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_PACKAGE_ZIP: str | None = None
_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``climo`` importable in the Python workers (once per application).

    Functions that run Python on executors (``applyInPandas``,
    ``mapInPandas``, pandas UDFs) are pickled by reference to their module,
    so the workers must be able to import the package.  It is zipped once per
    driver process and shipped with ``addPyFile`` (``addArtifacts`` on Spark
    Connect), the same mechanism as ``--py-files``.
    """
    global _PACKAGE_ZIP
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect
        sc, app = None, id(spark)
    if app in _SHIPPED:
        return
    if _PACKAGE_ZIP is None:
        import shutil
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        out = tempfile.mkdtemp(prefix="climo-pyfiles-")
        _PACKAGE_ZIP = shutil.make_archive(os.path.join(out, "climo"), "zip",
                                           root_dir=os.path.dirname(pkg_dir), base_dir="climo")
    if sc is not None:
        sc.addPyFile(_PACKAGE_ZIP)
    else:
        spark.addArtifacts(_PACKAGE_ZIP, pyfile=True)
    _SHIPPED.add(app)
