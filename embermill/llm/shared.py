"""Session helpers shared by the training-data operators.

Work tables go to the folder that the session names in ``spark.checkpoint.dir``:
it is the only place that the driver and every executor can both read, so a
table written there cuts lineage and survives the loss of an executor.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from embermill.sources.work import work_dir

_LOCK = threading.Lock()


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/embermill/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back with the same schema."""
    return written_at(df, tag)[0]


def written_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a work table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settle(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer held."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they start."""
    sc = spark.sparkContext
    with _LOCK:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        if os.path.isdir(root) and not getattr(sc, "_embermill_shipped", False):
            into = os.path.join(tempfile.mkdtemp(prefix="embermill-zip-"), "embermill_workers.zip")
            with zipfile.ZipFile(into, "w") as z:
                for folder, _, names in os.walk(root):
                    for name in names:
                        if name.endswith(".py"):
                            full = os.path.join(folder, name)
                            z.write(full, os.path.relpath(full, os.path.dirname(root)))
            sc.addPyFile(into)
        sc._embermill_shipped = True
    # Whole texts make large rows: smaller Arrow batches bound what a worker holds.
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > 4000:
        spark.conf.set(key, "4000")


def bound_batches(spark: SparkSession, most: int) -> None:
    """Arrow batches of ``most`` bytes at most: however long its texts, a batch is held by the JVM and by its worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))
    if not 0 < now <= most:
        spark.conf.set(key, str(most))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def executors_parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
