"""Session construction and the runtime settings every operator relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings the operators assume. They are session-scoped and safe
# to set on a session somebody else built (the driver hands us one).
RUNTIME_CONF = {
    # Event time is always UTC; bucket boundaries must not move with the host.
    "spark.sql.session.timeZone": "UTC",
    # OTLP resource attributes override same-named record attributes.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # So does a later entry of a nested key-value list.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Retention and bucket recompute rewrite only the touched dt= partitions.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply RUNTIME_CONF to an existing session (idempotent)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_session(
    app: str = "vigil",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or fetch) a session with the defaults the library expects.

    ``master`` defaults to the cluster's own setting; tests pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    return configure(spark)


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 << 20, max_partitions: int = 500_000) -> dict:
    """Shuffle / scan sizing for an input of ``input_bytes`` (pass to ``get_session(extra=...)``).

    Scan splits and the initial shuffle width aim at ~256 MB per task so a task's
    sort/aggregation buffers fit executor memory without heavy spilling; AQE then
    coalesces small post-shuffle partitions to the advisory size and splits skewed
    ones. At 100 TB this gives ~410 k initial shuffle partitions of 256 MB; the cap
    only guards against a mistaken size.
    """
    partitions = max(8, min(max_partitions, -(-input_bytes // target_partition_bytes)))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes * 2),
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared lineage-cutting folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must point at shared storage and is only read.
    When it is unset (local tests) a scratch folder is created and registered.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster job needs a shared folder for it"
        )
    path = tempfile.mkdtemp(prefix="vigil-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def stream_checkpoint(spark: SparkSession, name: str, checkpoint: str | None) -> str:
    """Where a stream keeps its progress: the given path, else ``<spark.checkpoint.dir>/<name>``.

    Never a scratch folder: a stream that restarts with an empty checkpoint reads its
    source from the start again.
    """
    if checkpoint:
        return checkpoint
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("give the stream a checkpoint path, or set spark.checkpoint.dir")
    return f"{configured.rstrip('/')}/{name}"
