"""Shared pieces of the corpus operators: table access, staging, grouped streams, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import noticeloom

#: Executors get the library's functions with each task, whether or not they can import it.
cloudpickle.register_pickle_by_value(noticeloom)


#: Rows in a batch that goes to Python: texts are long, and a task holds two or three batches of them.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ``BATCH_ROWS``, so that batches of long texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only (the folder may be on any store)."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. One of our own only on a local master."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith(("local[", "local")) or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        where = sc.getCheckpointDir()
    return where


def _in_store(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Cuts lineage with files that survive the loss of any executor; used wherever a result feeds several jobs. The files
    go when the application ends, or before with ``discard``."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/noticeloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, store = _in_store(spark, path)
    store.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``staged`` wrote for ``frames``, which nothing reads any more."""
    for df in frames:
        at, store = _in_store(df.sparkSession, df.staged_at)
        store.delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear_staged(spark: SparkSession) -> None:
    """Deletes what ``staged`` has written for this application; call it once its results are stored elsewhere."""
    at, store = _in_store(spark, f"{shared_dir(spark)}/noticeloom-{spark.sparkContext.applicationId}")
    store.delete(at, True)


def keyed_runs(batches: Iterator, n_keys: int) -> Iterator[tuple[tuple, dict]]:
    """Runs of equal leading columns in a stream of Arrow batches sorted by them: (key, columns as lists).

    Holds one run at a time; the caller's plan bounds the length of a run."""
    key, held = None, None
    for batch in batches:
        names, cols = batch.schema.names, [c.to_pylist() for c in batch.columns]
        n, i = batch.num_rows, 0
        while i < n:
            k = tuple(c[i] for c in cols[:n_keys])
            j = i + 1
            while j < n and all(c[j] == v for c, v in zip(cols[:n_keys], k, strict=True)):
                j += 1
            if held is not None and k == key:
                for name, c in zip(names, cols, strict=True):
                    held[name].extend(c[i:j])
            else:
                if held is not None:
                    yield key, held
                key, held = k, {name: c[i:j] for name, c in zip(names, cols, strict=True)}
            i = j
    if held is not None:
        yield key, held


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: (id, component), component = the smallest id reachable.

    Alternating large-star and small-star rounds. A hot node is a hot join key, which adaptive skew joins split;
    minima are pre-aggregated before the shuffle. Each round is staged, so a lost executor costs one round."""
    a, b = F.col("a"), F.col("b")
    now = staged(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, now = now, staged(small.where("u != v").distinct())
        discard(last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


class UnionFind:
    """Over 0..n-1, for one bounded block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
