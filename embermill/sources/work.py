"""Where work tables go: a folder that the driver and every executor can read."""

from __future__ import annotations

import tempfile
import threading

from pyspark.sql import SparkSession

_LOCK = threading.Lock()
_OWN = "spark.embermill.work.dir"


def work_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where all of Spark is on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    with _LOCK:
        own = spark.conf.get(_OWN, None)
        if not own:
            own = "file://" + tempfile.mkdtemp(prefix="embermill-")
            spark.conf.set(_OWN, own)
    return own
