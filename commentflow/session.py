"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The default type of stored times has no statistics, so bounds could not skip row groups.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # Splits a hot join key (one thread or source with a third of all rows).
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "commentflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; executor sizes stay with the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in _RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def stage_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Without the setting a folder under the warehouse. On a cluster that must not be
    a folder of the driver's own disk, which executors do not see.
    """
    shared = spark.conf.get(CHECKPOINT_DIR, None)
    if shared:
        return shared.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("/", "file:")):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"


def release(spark: SparkSession) -> None:
    """Delete what this application has staged; call it when no result needs it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
        f"{stage_root(spark)}/commentflow/{spark.sparkContext.applicationId}"
    )
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{stage_root(spark)}/commentflow/{app}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, reader: SparkSession | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This fixes values that a recomputation could change (partition numbers)
    and cuts the lineage in a way that survives lost executors. ``reader`` is the
    session that reads it, if not that of ``df``.
    """
    spark = reader or df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
