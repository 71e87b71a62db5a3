"""Session construction and cluster-safe lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # shuffle partitions are sized by AQE to ~128 MB each (set
    # spark.sql.shuffle.partitions high on a cluster and let AQE coalesce)
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # delete checkpoint files of DataFrames that are no longer referenced, so
    # the shared checkpoint folder does not grow without bound
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    # what a long session keeps on the driver about finished queries
    "spark.sql.ui.retainedExecutions": "20",
    "spark.sql.maxPlanStringLength": "200000",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "swellcast", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    The session time zone is pinned to UTC: all grid arithmetic is done on
    TIMESTAMP_NTZ, and the few zoned conversions must not depend on the host.
    """
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
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when none is configured *and* Spark runs in local mode (tests, the
    bench) is a scratch folder created; on a cluster a missing setting is an
    error, because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="swellcast-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a local one).

    Used where one derived table (the hourly grid, a filled grid) feeds
    several branches of a plan: it is computed once, written to shared
    storage, and later stages read it back - so the plan stays small, the
    upstream shuffles run once, and a lost executor costs a re-read rather
    than a recompute of the whole lineage. The hash partitioning of the
    written data is kept, so joins on the series key do not re-shuffle it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


materialize = cut_lineage


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: an intermediate table that several jobs read is computed once, prunes
    columns when it is re-read and survives lost executors. The folder is
    removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/saved-{uuid.uuid4().hex[:12]}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
