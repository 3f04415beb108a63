"""Session helpers: one place for the settings the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job here assumes. AQE re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quarry") -> SparkSession:
    """Return a session with the engine's defaults (local mode for tests/bench)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session, None for a remote (Connect) one."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no context
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` wins; a private scratch folder
    is only created when a ``local`` session has none (tests); a cluster session
    without one is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if sc is None:
        return configured or _local_folder(spark.conf.get("spark.master", ""))
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    local = _local_folder(sc.master)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def _local_folder(master: str) -> str:
    """A scratch folder on this machine, which only a ``local`` master shares
    with its tasks; any other master must name a shared folder."""
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="quarry-ckpt-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (for tables a job
    writes and reads back)."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-tables/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` as a Parquet table into the shared
    checkpoint folder and reading it back (survives executor loss, unlike a
    local checkpoint). Parquet keeps column pruning and filter pushdown for
    the readers of the table."""
    import uuid
    base = ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/quarry-tables/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in Python workers (``mapInArrow`` and data
    source code): zip the package once per application and ship it with the
    session (``addPyFile``; ``addArtifacts`` on a remote session)."""
    import shutil
    sc = _context(spark)
    key = sc.applicationId if sc is not None else f"remote-{id(spark)}"
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="quarry-pkg-")
    archive = shutil.make_archive(os.path.join(out, "quarry"), "zip", os.path.dirname(pkg_dir), "quarry")
    if sc is not None:
        sc.addPyFile(archive)
    else:
        spark.addArtifacts(archive, pyfile=True)
    _SHIPPED.add(key)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Recursive delete through the Hadoop file system of the path's scheme
    (works for local, HDFS and object-store folders alike). Returns False
    where the session offers no file system handle (remote sessions)."""
    sc = _context(spark)
    if sc is None:
        return False
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True))


def drop_lineage_tables(spark: SparkSession) -> None:
    """Remove the tables ``cut_lineage`` wrote for this application. Call it
    when no DataFrame built from them is needed any more."""
    delete_path(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-tables")
