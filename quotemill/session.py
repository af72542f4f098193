"""Session settings the package relies on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Joins are never forced: Spark broadcasts a side when its measured size is under
# autoBroadcastJoinThreshold, otherwise it shuffles and AQE splits hot keys.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(master: str | None = None, app: str = "quotemill",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings above. A cluster's own master and sizes stay in charge."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(ENGINE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in {**conf, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``; it goes when the session's JVM ends.

    Only a session of one machine (``local[..]``) may go without that setting and then uses a temporary
    folder; on a cluster executors and driver see different disks, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = f"{base.rstrip('/')}/{purpose}-{os.urandom(6).hex()}"
    elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        path = tempfile.mkdtemp(prefix=f"quotemill-{purpose}-")
    else:
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more before the session ends."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, purpose: str, files: int | None = None) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends there, lost executors lose nothing.

    ``files`` bounds the number of files, for tables whose size is known to be small.
    """
    path = f"{shared_dir(df.sparkSession, purpose)}/rows"
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
