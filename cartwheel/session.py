"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# SQL defaults, set only where the submitter (``--conf``, ``spark-defaults``) has not set them.
_SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# For a local master named by the caller, which starts its own JVM: that JVM does all the work.
_LOCAL_DEFAULTS = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "cartwheel", extra: dict | None = None) -> SparkSession:
    """The running session or a new one; what was submitted wins over the defaults, arguments win over both."""
    builder = SparkSession.builder.appName(app_name)
    asked = dict(extra or {})
    if shuffle_partitions:
        asked["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    submitted = os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    if master:
        builder = builder.master(master)
        if master.startswith("local") and "PYSPARK_GATEWAY_PORT" not in os.environ:
            asked = {k: v for k, v in _LOCAL_DEFAULTS.items() if k not in submitted and not (k == "spark.driver.memory" and "--driver-memory" in submitted)} | asked
    for k, v in asked.items():
        builder = builder.config(k, v)
    fresh = SparkSession.getActiveSession() is None
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for k, v in _SQL_DEFAULTS.items():
        if fresh and k not in asked and not given.contains(k):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting must point at shared storage and is respected as is.
    Only when it is unset *and* the master is local (tests, laptops) do we create a
    private scratch folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="cartwheel-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    try:
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:  # core confs may be read-only at runtime; the context setting suffices
        pass
    sc.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written when called as Parquet (which is compressed, unlike a checkpoint) into a new shared folder."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # the shuffle files behind it go when the driver's JVM finds them unreachable, which on an idle driver takes long
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)
