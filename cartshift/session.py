"""Session settings the jobs rely on."""

from __future__ import annotations

import atexit
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only, so they can be applied to a session someone else made.
# Per-key facts are always aggregated first (map side), so the only skew left is
# in the join that puts them back on the rows; AQE cuts such a partition by map
# output, which also splits exact copies of one row.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_SETTINGS`; sizes (partitions, memory) stay the caller's."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    On a cluster a missing setting is an error. Only for a local master one in the warehouse stands in; it
    is removed at the end.
    """
    setting = "spark.checkpoint.dir"
    context = spark.sparkContext
    folder = context.getConf().get(setting)
    if folder is None and not context.master.startswith("local"):
        raise RuntimeError(f"set {setting} to a shared folder")
    folder = folder or spark.conf.get(setting, None)
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints-{uuid.uuid4().hex}"
        spark.conf.set(setting, folder)
        atexit.register(shutil.rmtree, urlparse(folder).path, ignore_errors=True)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    As compressed Parquet: Spark's own checkpoint keeps rows as they lie in memory, many times as large.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = shared_folder(spark)
        context.setCheckpointDir(folder)
    path = f"{context.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
