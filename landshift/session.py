"""Session settings and stage tables.

Long jobs cut their lineage by writing a stage table to the shared folder named by
``spark.checkpoint.dir``. A stage survives the loss of any executor, and its file
size gives the planner an exact figure for choosing between a broadcast and a
shuffled join, so no join in this package carries a broadcast hint.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


PACKAGE_PARENT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(cores: str = "*", app: str = "landshift") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "10g")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.sql.adaptive.enabled", "true")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the jobs rely on; safe to call on a shared session."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    # Workers that start in another folder import the package from where the driver has it.
    environment = spark.sparkContext.environment
    if PACKAGE_PARENT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [PACKAGE_PARENT, environment.get("PYTHONPATH")]))
    return spark


_local_roots: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """Shared folder for stage tables, read from the session."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        return f"{configured.rstrip('/')}/{sc.applicationId}"
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_roots[sc.applicationId]


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a stage table and return a scan of it."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
