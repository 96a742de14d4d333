"""Session helpers.

The library never creates a session behind the caller's back: every operator
takes DataFrames.  ``local_session`` is for tests, the bench and the entry
point only.  ``shared_dir`` resolves the folder used for checkpoints and
materialised intermediates from the session's ``spark.checkpoint.dir``; on a
cluster it raises where that setting is absent.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Checkpoint folder of a local[...] session that names none (tests, bench).
LOCAL_DIR = "/tmp/checkpoints"

# Scale-oriented defaults.  AQE re-plans joins from runtime sizes (broadcast
# promotion, partition coalescing, skew splitting), which is what the skewed
# name/URI keys of registry data need.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "false",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "regmesh") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    try:                                   # not available on Spark Connect
        return spark.sparkContext
    except Exception:                      # pragma: no cover
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    Read from the session (``spark.checkpoint.dir``, a cluster-wide setting
    that cannot be changed at run time) or from the context's checkpoint
    folder, and returned as given, scheme included.  On a cluster one of the
    two must be set: executors do not see each other's disks, so a local
    folder in its place would lose rows, and this raises.  A ``local[...]``
    session, whose driver and executors are one process, gets ``LOCAL_DIR``.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not current and sc is not None:
        current = sc.getCheckpointDir()
    if not current:
        if sc is None or not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = LOCAL_DIR
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Parquet files about as large as their rows are in memory.
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}


def written(df: DataFrame, name: str, plain: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back (cuts its lineage).

    ``plain``: for the side of a join that may be large.  Joins are planned by the bytes of a
    side's files; sorted or repeated strings take a small part there of what they take in the
    driver, which would broadcast millions of rows.  Plain files state the size of the rows."""
    path = shared_dir(df.sparkSession, name)
    (df.write.options(**PLAIN) if plain else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cluster_conf(input_bytes: int, total_cores: int,
                 partition_bytes: int = 256 << 20, shuffle_ratio: float = 0.25) -> dict[str, str]:
    """Settings for a cluster run, sized from the input volume.

    * scan splits of ``partition_bytes`` (Parquet row groups permitting);
    * an initial shuffle partition count sized to the expected shuffle volume
      (``shuffle_ratio`` of the input: the reports shuffle narrow projections
      after map-side combine), never below 2x the cores; AQE then coalesces
      small partitions and splits skewed ones;
    * dimension broadcasts up to 64 MB by estimated/measured size, otherwise
      a shuffle join;
    * shuffle output kept when executors go away (external shuffle service,
      decommissioning with block migration), so a lost executor costs task
      retries, not stage recomputation.
    """
    shuffle_parts = int(max(2 * total_cores, input_bytes * shuffle_ratio // partition_bytes))
    conf = {k: v for k, v in SCALE_CONF.items() if not k.startswith("spark.ui")}
    conf.update({
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle_parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.shuffle.service.enabled": "true",
        "spark.decommission.enabled": "true",
        "spark.storage.decommission.enabled": "true",
        "spark.storage.decommission.shuffleBlocks.enabled": "true",
    })
    return conf
