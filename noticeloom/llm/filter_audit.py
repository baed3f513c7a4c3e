"""Audit of how filters interact, over a sparse document-term matrix.

Words are encoded by one dictionary of the whole corpus and documents become rows of CSR shards (``shards``). A row's
sum is the document's number of words, its nonzero entries are its distinct words: they decide filters A and B. The
flags of the texts themselves (C, D) and their digests ride along in the shards; E and the labels are joined on. What is
left of a document is a part, a mask of failed filters and two marks, which are counted before they are shuffled: at
most 32 rows a part, from which all 120 orders follow.

Texts are told apart by a 128-bit digest, the smallest id of each text that occurs twice is worked out by a
pre-aggregated count, and joined back by broadcast if those are few (``BROADCAST``, counted first), else by a shuffle
whose hot texts an adaptive join splits.

Defined results: null text, lang: empty. Documents without an id are no duplicates, make none, and have no labels. Of
several labels of an id the largest counts. Rows that repeat an id are documents of their own, and equal texts of
one id are not each other's duplicates. An empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import read_table, staged
from noticeloom.llm.shards import count_shards, csr_shards, dictionary_ids, unsqueezed

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
MARKS = b"#$%&*|"
#: Texts that occur more than once, up to which they are broadcast.
BROADCAST = 500_000


def text_flags(texts: pa.Array) -> list[pa.Array]:
    """[mask of C and D, digest] of each text."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    is_mark = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(MARKS, np.uint8))
    masks, digests = np.empty(len(texts), np.int32), []
    for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        b = raw[x:y]
        points = np.count_nonzero((b & 0xC0) != 0x80)
        capitals = np.count_nonzero((b - np.uint8(65)) < 26)
        masks[i] = 4 * (100 * capitals > MOST_CAPITALS * points) + 8 * bool(is_mark[b].any())
        digests.append(hashlib.blake2b(b, digest_size=16).digest())
    return [pa.array(masks), pa.array(digests, pa.binary())]


def matrix_rows(csr: DataFrame) -> DataFrame:
    """(doc_id, lang, mask of A to D, digest) of each document, from the rows of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                starts, counts = unsqueezed(b["starts"][i].as_py(), "<i8"), unsqueezed(b["counts"][i].as_py(), "<i4")
                sums = np.append(0, np.cumsum(counts, dtype=np.int64))
                words, distinct = np.diff(sums[starts]), np.diff(starts)
                mask = (words < LEAST_WORDS) + 2 * (100 * distinct < LEAST_DISTINCT * words) + b["mask"][i].values.to_numpy()
                yield pa.RecordBatch.from_arrays([b["doc_id"][i].values, b["lang"][i].values, pa.array(mask, pa.int32()), b["digest"][i].values], ["doc_id", "lang", "mask", "digest"])

    kind = csr.schema["doc_id"].dataType.elementType.simpleString()
    return csr.select("starts", "counts", "doc_id", "lang", "mask", "digest").mapInArrow(run, f"doc_id {kind}, lang string, mask int, digest binary")


def with_duplicates(rows: DataFrame) -> DataFrame:
    """``rows`` with E in the mask: the same text stands under a smaller id."""
    firsts = staged(rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"))
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST else firsts
    return rows.join(firsts, "digest", "left").withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).drop("digest", "first")


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask of failed filters."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    one = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return rows.join(marks, "doc_id", "left").groupBy(F.col("lang").alias("part"), "mask").agg(F.count("*").alias("n"), one("good").alias("good"), one("toxic").alias("toxic"))


def all_steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before, bit of the step's filter) of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, j in enumerate(order, 1):
            out.append(("".join(FILTERS[i] for i in order), step, before, 1 << j))
            before |= 1 << j
    return out


def interactions(counted: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from at most 32 counts a part: each meets the 600 steps."""
    steps = F.split(F.lit(";".join(",".join(map(str, s)) for s in all_steps())), ";")
    x = counted.select("part", "mask", "n", "good", "toxic", F.explode(steps).alias("s")).withColumn("s", F.split("s", ","))
    x = x.select("part", "mask", "n", "good", "toxic", F.col("s")[0].alias("filter_order"), *(F.col("s")[i].cast("int").alias(c) for i, c in ((1, "step"), (2, "before"), (3, "bit"))))
    fails, seen = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    of = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    x = x.groupBy("part", "filter_order", "step", "bit").agg(
        of("n", seen & ~fails).alias("kept"), of("n", seen & fails).alias("removed"), of("n", ~seen & fails).alias("redundant"),
        of("n", F.col("mask") == F.col("bit")).alias("unique_fails"), of("good", seen & fails).alias("good_lost"), of("toxic", seen & fails).alias("toxic_lost"),
    )
    return x.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of documents
    (doc_id, text, lang) and labels (doc_id, quality, toxic)."""
    docs = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"))
    shards = count_shards(docs, carried=("doc_id", "lang"), measured=(("mask", "int"), ("digest", "binary")), measure=text_flags)
    rows = staged(matrix_rows(csr_shards(shards, dictionary_ids(shards))))
    return interactions(mask_counts(with_duplicates(rows), labels))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters in all orders over all documents, by language."""
    return audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents
), w AS (
  SELECT doc_id, text, part, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), f AS (
  SELECT doc_id, text, part,
    CAST(len(words) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS m FROM w
), g AS (
  SELECT doc_id, part, m + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS m FROM f
), l AS (
  SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, m, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS t
  FROM g LEFT JOIN l USING (doc_id) GROUP BY part, m
), x AS (SELECT unnest([0, 1, 2, 3, 4]) AS i), o AS (
  SELECT row_number() OVER () AS o, [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT o, p, array_to_string(list_transform(p, lambda i: substr('ABCDE', i + 1, 1)), '') AS filter_order, step, 1 << p[step] AS bit,
    CAST(list_sum(list_transform(p[1:step - 1], lambda i: 1 << i)) AS INT) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN m & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN m & coalesce(before, 0) = 0 AND m & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & coalesce(before, 0) > 0 AND m & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & coalesce(before, 0) = 0 AND m & bit > 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN m & coalesce(before, 0) = 0 AND m & bit > 0 THEN t ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
