"""Session helpers: a tuned local session for tests/bench and the checkpoint folder."""
from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "surveykit") -> SparkSession:
    """Build (or reuse) a session with AQE, skew-join handling and Arrow on, UI off.

    Started by spark-submit, the launcher's master, memory and partition count stand;
    only a plain Python process gets local defaults for them.
    """
    builder = SparkSession.builder.appName(app_name).config(map={
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true"})
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or os.environ.get("SURVEYKIT_MASTER") or (None if submitted else f"local[{cpus}]")
    parts = shuffle_partitions or os.environ.get("SURVEYKIT_SHUFFLE_PARTITIONS") or (None if submitted else cpus)
    memory = os.environ.get("SURVEYKIT_DRIVER_MEMORY") or (None if submitted else "8g")
    if master:
        builder = builder.master(master)
    for name, value in (("spark.sql.shuffle.partitions", parts), ("spark.driver.memory", memory)):
        if value:
            builder = builder.config(name, str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local") or spark.conf.get("spark.checkpoint.dir", None):
        ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; we only create a scratch folder when the
    setting is unset and the master is ``local`` (tests and the bench): on a cluster a
    machine-local folder could not be read back, so an unset folder is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="surveykit-ckpt-", dir="/tmp")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # core conf may be read-only at runtime; the context call below is what counts
            pass
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables.

    The folder is removed when the application ends.
    """
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: every later branch
    of a plan sees the same rows, computed once."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for Python functions in tasks."""
    sc = spark.sparkContext
    if not getattr(sc, "_surveykit_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="surveykit-code-"), "surveykit_code")
        sc.addPyFile(shutil.make_archive(base, "zip", root_dir=root, base_dir="surveykit"))
        sc._surveykit_shipped = True
