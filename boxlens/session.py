"""Session helpers: the configuration the reports are written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # remove reliable-checkpoint files once nothing references them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "boxlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
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
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared, fault-tolerant folder and is used
    as is. Only a local-mode session (tests) without the setting gets a private
    folder; any other master without it is an error, because a machine-local
    folder would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or S3)")
        path = tempfile.mkdtemp(prefix="boxlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for written intermediate tables, under the checkpoint dir."""
    return os.path.join(ensure_checkpoint_dir(spark), "boxlens", name)


def freeze(df):
    """Materialise ``df`` with a reliable checkpoint in ``spark.checkpoint.dir``.

    Used where a small intermediate (one row per customer) feeds two
    branches of a plan whose inputs are large: Spark would otherwise scan and
    aggregate those inputs once per branch whenever the branches' plans differ
    after optimisation. The checkpoint cuts the lineage, so a lost executor
    re-reads the files instead of recomputing the inputs. Runs a job.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
