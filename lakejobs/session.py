"""Session construction and the shared working folder.

The library never invents a machine-local scratch folder on a cluster: all
intermediate tables, streaming checkpoints and reliable RDD checkpoints live
under the folder the cluster names in ``spark.checkpoint.dir``. Where that
setting is absent, a local master (tests, local runs) gets a folder of its
own, and any other master is an error. Working folders of an application are
removed when it ends.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_REGISTERED: set[str] = set()

# Settings every job relies on. Kept in one place so the test session, the
# bench and a cluster submit agree.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Settings for a large cluster (about 100 TB, ~1000 executors), added to
# BASE_CONF at submit time. Shuffles start wide and AQE coalesces them to
# ~256 MB; skewed partitions are split; scans read 256 MB splits; automatic
# broadcast stays at 64 MB of estimated size; streaming state lives in RocksDB.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "lakejobs", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, submit with the same ``BASE_CONF``
    and a ``spark.checkpoint.dir`` on shared storage instead."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    # folders are listed by a task each otherwise, thousands of them on a few cores
    conf["spark.sql.sources.parallelPartitionDiscovery.parallelism"] = "64"
    conf.setdefault("spark.driver.memory", os.environ.get("LAKEJOBS_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_root(spark)
    return spark


def pin_conf(spark: SparkSession) -> None:
    """Pin the runtime settings results depend on (zone, overwrite mode)."""
    for k in ("spark.sql.session.timeZone", "spark.sql.sources.partitionOverwriteMode",
              "spark.sql.mapKeyDedupPolicy"):
        spark.conf.set(k, BASE_CONF[k])


def shared_root(spark: SparkSession) -> str:
    """The shared working folder: ``spark.checkpoint.dir`` when the cluster
    sets it, otherwise, with a local master only, a folder we create and
    register."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="lakejobs-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared root for one run of one job. It
    lies in the application's own folder, which is removed when the
    application ends: results that must outlive it belong elsewhere."""
    own = f"{shared_root(spark)}/lakejobs/{spark.sparkContext.applicationId}"
    if own not in _REGISTERED:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _REGISTERED.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"
