"""The incremental feed: arriving listing rows update the notices, and only new matches are emitted.

A listing is what one source shows at one time. Its rows carry its id and how many notices it has, and may arrive over
several batches in any order; only a listing that is complete is compared with what is known, so a source whose listing
is cut short closes nothing, whatever other sources do.

``listing_rows`` is the stateful part of the stream: per source, listing and bucket of notices it passes on rows that
were not there before, and gives up a listing to which nothing was added for a while. ``run_batch`` then works out what a
batch changes, writes that down, and applies it: the tables are ``Buckets``, of which only those with a changed key are
written. A batch that runs again finds its changes written down and applies them again, which changes nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from noticeloom.operators import tables
from noticeloom.sources.buckets import Buckets
from noticeloom.sources.staging import stage

NOTICES = "project_no string, source string, title string, status string, attachment_names array<string>, first_seen string"
SENT = "sub_key string, project_no string"
LISTING = "project_no string, source string, title string, attachment_names array<string>, listing string, listing_rows int"
NAMES = [c.split()[0] for c in LISTING.split(", ")]


class Tables:
    """``notices``; ``sent`` pairs, with the batch in which their notice closed; the last batch that each subscriber got
    something from; the rows of listings that ``wait`` to be complete. ``emitted`` has a folder per batch."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder
        self.notices = Buckets(spark, f"{folder}/notices", NOTICES, n=buckets)
        self.sent = Buckets(spark, f"{folder}/sent", f"{SENT}, closed_in long", n=buckets)
        self.last = Buckets(spark, f"{folder}/last", "sub_key string, batch long", "sub_key", n=buckets)
        self.waiting = Buckets(spark, f"{folder}/waiting", LISTING, "source", n=buckets)

    def start(self, notices: DataFrame, sent: DataFrame) -> None:
        self.notices.create(notices)
        self.sent.create(sent.select("sub_key", "project_no", F.lit(None).cast("long").alias("closed_in")))
        self.last.create()
        self.waiting.create()

    def emitted(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/emitted/v{batch_id}")

    def _at(self, batch_id: int, name: str) -> str:
        return f"{self.folder}/changes/v{batch_id}/{name}"

    def written(self, batch_id: int) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(batch_id, "done/_SUCCESS"))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def complete_listings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of listing rows the rows of each source's latest complete listing, and those that still wait for others.

    A row without a project_no only says how many there are (none, say). Of rows that repeat a project_no the first by
    source, title and attachments counts."""
    sizes = rows.groupBy("source", "listing").agg(F.countDistinct("project_no").alias("n"), F.max("listing_rows").alias("of"))
    latest = sizes.where("n >= of").groupBy("source").agg(F.max("listing").alias("latest"))
    x = rows.join(latest, "source", "left")
    now = x.where("listing = latest AND project_no IS NOT NULL").withColumn("__at", F.struct("source", "title", "attachment_names"))
    return tables.first_seen_dedupe(now, "project_no", "__at").drop("__at", "latest"), x.where("latest IS NULL OR listing > latest").drop("latest")


def changes(store: Tables, batch: DataFrame, batch_id: int, matcher, now: str) -> None:
    """Writes down what a batch changes: notices, sent pairs, waiting rows, and what is emitted."""
    expired = batch.where("expired").select("source", "listing").distinct() if "expired" in batch.columns else None
    arrived = batch.where("NOT expired") if expired is not None else batch
    sources = batch.select("source").distinct()
    rows = stage(store.waiting.holding(sources).unionByName(arrived.select(*NAMES)))
    listing, waiting = complete_listings(rows)
    listing = stage(listing)
    waits = waiting.select("source", "listing").distinct()
    done = stage(rows.select("source", "listing").distinct().join(waits, ["source", "listing"], "left_anti").select("source").distinct())
    if expired is not None:
        waiting = waiting.join(expired, ["source", "listing"], "left_anti")
    stage(waiting.select(*NAMES), store._at(batch_id, "waiting"))
    stage(sources, store._at(batch_id, "sources"))
    # only the sources that showed a whole listing are read, and notices that such a listing has from elsewhere
    known = store.notices.read().join(done, "source", "left_semi").unionByName(store.notices.holding(listing).join(done, "source", "left_anti"), allowMissingColumns=True)
    known = stage(known.select(*store.notices.columns))
    diff = tables.snapshot_diff(known, listing, done)
    x = known.join(listing.select("project_no", *(F.col(c).alias(f"new_{c}") for c in ("source", "title", "attachment_names"))), "project_no", "full_outer").join(diff.select("project_no", "action"), "project_no", "left")
    retitled = F.col("new_title").isNotNull() & ~F.col("new_title").eqNullSafe(F.col("title"))
    x = x.where(F.col("action").isin("close", "analyze", "reopen") | retitled)
    status = F.when(F.col("action") == "close", "접수마감").when(F.col("action").isin("analyze", "reopen"), "접수중").otherwise(F.col("status"))
    changed = x.select(
        "project_no", *(F.coalesce(f"new_{c}", c).alias(c) for c in ("source", "title")), status.alias("status"),
        F.coalesce("new_attachment_names", "attachment_names").alias("attachment_names"), F.coalesce("first_seen", F.lit(now)).alias("first_seen"),
    )
    changed = stage(changed, store._at(batch_id, "notices"))
    open_ = tables.filter_status(changed, "접수중")
    # what was sent of a notice that has closed since is forgotten when its subscriber gets something again
    before = store.sent.holding(changed)
    before = before.join(store.last.holding(before), "sub_key", "left").where("closed_in IS NULL OR batch IS NULL OR batch < closed_in").drop("batch")
    before = stage(before)
    new = stage(tables.new_items(matcher(open_), before.select("sub_key", "project_no")), f"{store.folder}/emitted/v{batch_id}")
    here = open_.select("project_no", F.lit(True).alias("here"))
    held = before.join(here, "project_no", "left").select("sub_key", "project_no", F.when(F.col("here"), F.lit(None)).otherwise(F.coalesce("closed_in", F.lit(batch_id))).cast("long").alias("closed_in"))
    pairs = new.select("sub_key", "project_no", F.lit(None).cast("long").alias("closed_in")).distinct()
    stage(held.unionByName(pairs), store._at(batch_id, "sent"))
    stage(new.select("sub_key", F.lit(batch_id).cast("long").alias("batch")).distinct(), store._at(batch_id, "last"))
    stage(sources.limit(0), store._at(batch_id, "done"))


def run_batch(store: Tables, batch: DataFrame, batch_id: int, matcher, now: str) -> dict[str, list[int]]:
    """One batch of listing rows (``LISTING``, and ``expired`` if some give up): of complete listings first rows per id,
    upsert, close what a source no longer lists, match what changed, emit and remember what has not been sent; other rows
    wait. Gives the buckets written of each table.

    ``matcher(notices) -> (sub_key, project_no, ...)`` looks at each notice for itself."""
    if not store.written(batch_id):
        batch = stage(batch)  # a stateful batch is worked out once
        if batch.isEmpty():
            return {}
        changes(store, batch, batch_id, matcher, now)
    made = {name: store.spark.read.parquet(store._at(batch_id, name)) for name in ("notices", "sent", "last", "waiting", "sources")}
    return {
        "notices": store.notices.replace(made["notices"], made["notices"]), "sent": store.sent.replace(made["notices"], made["sent"]),
        "last": store.last.replace(made["last"], made["last"]), "waiting": store.waiting.replace(made["sources"], made["waiting"]),
    }


def listing_rows(stream: DataFrame, patience: str = "6 hours", buckets: int = 64) -> DataFrame:
    """Rows of a streaming listing (``LISTING`` and ``expired``) that did not arrive before, each once; when nothing is
    added to a listing for ``patience``, one row per bucket says that it has expired. Under the trigger ``availableNow``
    set spark.sql.streaming.noDataMicroBatches.enabled to false, else the timers keep the run alive; listings then expire
    with the next data."""
    millis = int(pd.Timedelta(patience).total_seconds() * 1000)

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({**{c: [None] for c in NAMES}, "source": [key[0]], "listing": [key[1]], "expired": [True]})
            return
        seen = set(state.get[0]) if state.exists else set()
        for pdf in rows:
            fresh = pdf[~pdf["digest"].isin(seen)].drop_duplicates("digest")
            seen.update(fresh["digest"].tolist())
            yield fresh[NAMES].assign(expired=False)
        state.update((sorted(seen),))
        state.setTimeoutDuration(millis)

    keyed = stream.select(*NAMES, F.xxhash64(*(c for c in NAMES if c not in ("source", "listing"))).alias("digest"), F.pmod(F.xxhash64("project_no"), F.lit(buckets)).alias("bucket"))
    return keyed.groupBy("source", "listing", "bucket").applyInPandasWithState(step, f"{LISTING}, expired boolean", "seen array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_incremental(stream: DataFrame, store: Tables, matcher, now: str, checkpoint: str, patience: str = "6 hours") -> DataStreamWriter:
    """A writer that runs ``run_batch`` on each micro-batch of a streaming listing."""
    return listing_rows(stream, patience).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, i: run_batch(store, batch, i, matcher, now) and None)
