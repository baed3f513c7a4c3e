"""Tables that outlive a plan: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import noticeloom

#: Executors get the library's functions with each task, whether or not they can import it.
cloudpickle.register_pickle_by_value(noticeloom)


def shared_folder(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``; on a local master without one, in a folder of its own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        where = sc.getCheckpointDir()
    return f"{where}/noticeloom-{sc.applicationId}/{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``df`` and reads it back: what feeds several jobs is worked out once, and a lost executor costs nothing.

    Without ``path`` it goes to the shared folder and is deleted when the application ends."""
    spark = df.sparkSession
    kept, path = path, path or shared_folder(spark)
    df.write.mode("overwrite").parquet(path)
    if not kept:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, over all cores: a small table may come in fewer partitions than there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, of which a row is much work, in some parts for each core: neither a file's size nor a shuffle's says how many."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
