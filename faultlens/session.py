"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Limits per key up to this are applied in map tasks, before a shuffle.
GROUP_LIMIT = 10_000


def build_session(app: str = "faultlens", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session with adaptive execution on.

    Shuffle parallelism is left to the cluster's own settings; AQE coalesces small
    partitions and splits skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.optimizer.windowGroupLimitThreshold", str(GROUP_LIMIT))
        .config("spark.sql.session.timeZone", "UTC")
        # Building wide column expressions is much slower with call-site capture.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Executors read what others wrote there, so the setting is required on a cluster.
    A session whose driver runs all tasks (master ``local[...]``) may do without; there
    Spark's own local folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.local.dir", "/tmp").split(",")[0] + "/faultlens"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
