"""The feed: stateful listing rows, changes by bucket, replay."""

import pathlib
import time

import pytest
from pyspark.sql import functions as F

from noticeloom.sources.buckets import Buckets
from noticeloom.streaming import feed


def _matcher(n):
    return n.select(F.lit("k").alias("sub_key"), "project_no")


def _start(spark, folder, buckets=4):
    t = feed.Tables(spark, str(folder), buckets)
    t.start(spark.createDataFrame([], feed.NOTICES), spark.createDataFrame([], feed.SENT))
    return t


def _emitted(t, i):
    return sorted(r.project_no for r in t.emitted(i).collect())


def _times(folder):
    return {str(p): p.stat().st_mtime_ns for p in pathlib.Path(folder).rglob("*.parquet")}


def test_feed_replay(spark, tmp_path):
    t = _start(spark, tmp_path)
    first = spark.createDataFrame([("1", "s", "t", ["a"], "l1", 2), ("2", "s", "t", [], "l1", 2)], feed.LISTING)
    second = spark.createDataFrame([("2", "s", "t", [], "l2", 2), ("3", "s", "t", [], "l2", 2), (None, "z", None, None, "l1", 0)], feed.LISTING)
    feed.run_batch(t, first, 0, _matcher, "d0")
    feed.run_batch(t, second, 1, _matcher, "d1")
    assert _emitted(t, 0) == ["1", "2"] and _emitted(t, 1) == ["3"]
    feed.run_batch(t, second, 1, _matcher, "d1")
    assert _emitted(t, 1) == ["3"]
    state = {r.project_no: (r.status, r.first_seen) for r in t.notices.read().collect()}
    assert state == {"1": ("접수마감", "d0"), "2": ("접수중", "d0"), "3": ("접수중", "d1")}


def test_a_notice_that_opens_again(spark, tmp_path):
    """What was sent is forgotten once its notice has closed and its subscriber got something since."""
    t = _start(spark, tmp_path)
    show = lambda i, *ids: feed.run_batch(t, spark.createDataFrame([(p, "s", "t", [], f"l{i}", len(ids)) for p in ids], feed.LISTING), i, _matcher, f"d{i}")
    show(0, "1", "2")
    show(1, "2")  # 1 closes, nothing is delivered
    show(2, "1", "2")
    assert _emitted(t, 2) == []
    show(3, "2", "3")  # 1 closes, 3 is delivered
    show(4, "1", "2", "3")
    assert _emitted(t, 3) == ["3"] and _emitted(t, 4) == ["1"]


def test_only_changed_buckets_are_written(spark, tmp_path):
    t = _start(spark, tmp_path, 16)
    rows = [(f"{i}", "s", "t", [], "l1", 300) for i in range(300)]
    feed.run_batch(t, spark.createDataFrame(rows, feed.LISTING), 0, _matcher, "d0")
    before = {name: _times(f"{tmp_path}/{name}") for name in ("notices", "sent", "last", "waiting")}
    rows = [(p, s, "new title" if p == "7" else n, a, "l2", 299) for p, s, n, a, *_ in rows if p != "9"]
    wrote = feed.run_batch(t, spark.createDataFrame(rows, feed.LISTING), 1, _matcher, "d1")
    assert 1 <= len(wrote["notices"]) <= 2
    for name in ("notices", "sent"):
        after = _times(f"{tmp_path}/{name}")
        kept = {p for p, at in before[name].items() if after.get(p) == at}
        assert {int(p.split("bucket=")[1].split("/")[0]) for p in before[name].keys() - kept} == set(wrote["notices"])
    assert {r.project_no: (r.title, r.status) for r in t.notices.read().where("project_no IN ('7', '8', '9')").collect()} == {"7": ("new title", "접수중"), "8": ("t", "접수중"), "9": ("t", "접수마감")}


FILES = [
    [("1", "a", "t", [], "l1", 3), ("2", "a", "t", [], "l1", 3)], [("3", "a", "t", [], "l1", 3), ("9", "b", "t", [], "l1", 1), ("2", "a", "t", [], "l1", 3)],
    [("1", "a", "t", [], "l2", 2)], [("4", "a", "t", [], "l2", 2), ("7", "b", "t", [], "l2", 5)],
]


def _feed(spark, t, tmp_path, patience="6 hours"):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema(feed.LISTING).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    feed.run_incremental(stream, t, _matcher, "d", f"{tmp_path}/check", patience).trigger(availableNow=True).start().awaitTermination()


def test_feed_of_a_stream_split_over_batches(spark, tmp_path):
    """Files arrive one a batch: listings that are split close nothing before they are whole, rows that repeat do
    nothing, and each notice is emitted once."""
    t = _start(spark, f"{tmp_path}/tables", 2)
    for i, rows in enumerate(FILES):
        spark.createDataFrame(rows, feed.LISTING).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        if i % 2:  # two files a run, one a batch
            _feed(spark, t, tmp_path)
    batches = sorted(int(p.name[1:]) for p in pathlib.Path(f"{tmp_path}/tables/emitted").iterdir() if p.name.startswith("v"))
    emitted = [e for i in batches if (e := _emitted(t, i))]
    assert emitted == [["1", "2", "3", "9"], ["4"]]
    state = {r.project_no: r.status[2:] for r in t.notices.read().collect()}
    assert state == {"1": "중", "2": "마감", "3": "마감", "4": "중", "9": "중"}
    assert [r.project_no for r in t.waiting.read().collect()] == ["7"]


def test_listings_that_never_complete_expire(spark, tmp_path):
    t = _start(spark, f"{tmp_path}/tables", 2)
    for i, rows in enumerate(([("7", "b", "t", [], "l2", 5)], [("1", "c", "t", [], "l1", 1)])):
        spark.createDataFrame(rows, feed.LISTING).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        _feed(spark, t, tmp_path, "1 second")
        assert i or [r.project_no for r in t.waiting.read().collect()] == ["7"]
        time.sleep(1.5)
    spark.createDataFrame([("2", "c", "t", [], "l2", 9)], feed.LISTING).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    _feed(spark, t, tmp_path, "1 second")
    assert [r.project_no for r in t.waiting.read().collect()] == ["2"]


@pytest.mark.parametrize("n", [1, 16])
def test_buckets(spark, tmp_path, n):
    b = Buckets(spark, f"{tmp_path}/t", "project_no string, value int, first_seen string, last_seen string", n=n)
    b.create(spark.createDataFrame([(str(i), i, "d0", "d0") for i in range(20)] + [(None, 1, None, None)], b.schema))
    assert b.read().count() == 20
    b.upsert(spark.createDataFrame([("3", 33), ("x", 1)], "project_no string, value int"), "d1")
    got = {r.project_no: (r.value, r.first_seen, r.last_seen) for r in b.read().collect()}
    assert got == {**{str(i): (i, "d0", "d0") for i in range(20)}, "3": (33, "d0", "d1"), "x": (1, "d1", "d1")}
    keys = spark.createDataFrame([(str(i),) for i in range(20)], "project_no string")
    b.replace(keys, spark.createDataFrame([("5", 7, "d", "d"), ("5", 8, "d", "d"), ("other", 1, "d", "d")], b.schema))
    assert sorted((r.project_no, r.value) for r in b.read().collect()) == [("5", 7), ("5", 8), ("x", 1)]
    assert b.replace(keys.limit(0), keys.limit(0)) == []
