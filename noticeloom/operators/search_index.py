"""A BM25 index of chunks over character bigrams, in segments with bounds, kept up to date without cutting texts again.

A segment is a run of up to ``SEGMENT`` chunks of one input partition. It has one block per gram: the gram's postings
there, and its impacts, the (tf, length) pairs that no other pair of the block beats, so the largest contribution of the
block follows for any idf and any average length. Blocks are cut inside the task that reads the chunks; the index of a
corpus is one pass without a shuffle, and one count per gram.

A search adds the largest contributions up to a bound per question and segment, scores the ``FIRST`` segments of the
highest bounds, and then only those whose bound reaches the k-th best score found: what is left out cannot enter, ties
included. A segment is scored in one task, for all questions that opened it, as a product of small matrices; what leaves
the task is the ``k`` best of each. Question grams and chosen segments are stored before they are joined, so Spark knows
their size and broadcasts them only below its threshold; postings never are, and of segments that no question opened
nothing is shuffled.

An index is a folder of generations. ``update_index`` writes a generation of the chunks of changed notices, marks their
old chunks deleted and corrects the statistics by what came and went; ``compact_index`` drops deleted postings from the
segments that hold some. Each version reads as a whole, and older ones stay readable."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.functions import text as tx
from noticeloom.sources.staging import shared_folder, spread, stage

SEGMENT, FIRST = 128, 3
#: Characters in a segment, about.
SEGMENT_CHARS = 1 << 21
PART = "segment long, gram string, postings array<struct<at:int,tf:int,len:int>>, impacts array<struct<tf:int,len:int>>, members array<struct<at:int,project_no:string,seq:long,len:int>>"
_ALONE = 0x1FFFFF  # stands after a word of one character


@dataclass
class Index:
    """``folder``: generations ``g<n>`` of segments and, by version, ``terms``, ``deleted`` chunks if there are any, and a
    row that names the generations and the totals."""

    spark: SparkSession
    folder: str
    version: int = 0

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self.version}/{name}")

    @cached_property
    def parts(self) -> DataFrame:
        return self.spark.read.schema(PART).parquet(*self.manifest.paths)

    @cached_property
    def manifest(self):
        """(n, tokens, paths, deleted)."""
        return self._read("manifest").first()

    @property
    def blocks(self) -> DataFrame:
        """(segment, gram, postings, impacts)."""
        return self.parts.where("gram IS NOT NULL").select("segment", "gram", "postings", "impacts")

    @property
    def members(self) -> DataFrame:
        """(segment, at, project_no, seq, len) of the chunks that are not deleted."""
        all_ = self.parts.where("gram IS NULL").select("segment", F.explode("members").alias("m")).select("segment", "m.*")
        return all_.join(self.deleted, ["segment", "at"], "left_anti") if self.manifest.deleted else all_

    @property
    def deleted(self) -> DataFrame:
        """(segment, at)."""
        return self._read("deleted") if self.manifest.deleted else self.spark.createDataFrame([], "segment long, at int")

    @property
    def terms(self) -> DataFrame:
        """(gram, df)."""
        return self._read("terms")

    @cached_property
    def totals(self) -> tuple[int, int]:
        """(chunks, grams in them)."""
        return self.manifest.n, self.manifest.tokens

    @property
    def average(self) -> float:
        n, tokens = self.totals
        return tokens / n if n else 1.0

    @property
    def idf(self) -> DataFrame:
        """(gram, df, idf)."""
        n = self.totals[0]
        return self.terms.select("gram", "df", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _blocks(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grams, first posting of each, chunk of each posting, its count, grams in each chunk) of texts in which only
    words and spaces are left."""
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), "<u4").astype(np.int64)
    ends = codes == 10
    chunk = np.cumsum(ends) - ends
    word = ~ends & (codes != 32)
    after = np.append(word[1:], False)
    pair = np.flatnonzero(word & after)
    alone = np.flatnonzero(word & ~after & ~np.append(False, word[:-1]))
    at = np.concatenate([pair, alone])
    gram = codes[at] << 21 | np.concatenate([codes[pair + 1], np.full(len(alone), _ALONE)])
    lengths = np.bincount(chunk[at], minlength=len(texts))
    grams, gram = np.unique(gram, return_inverse=True)
    key = gram * len(texts) + chunk[at]
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    tf, key = np.diff(np.append(first, len(key))), key[first]
    names = [chr(g >> 21) + ("" if g & _ALONE == _ALONE else chr(g & _ALONE)) for g in grams.tolist()]
    return names, np.searchsorted(key, np.arange(len(names) + 1) * len(texts)), key % max(len(texts), 1), tf, lengths


def _unbeaten(gram: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Postings that no posting of their gram beats: none has more occurrences in as short a chunk."""
    order = np.lexsort((length, -tf, gram))
    falling = length[order] - gram[order] * (int(length.max(initial=0)) + 1)  # a later gram is below all of an earlier one
    least = np.minimum.accumulate(falling)
    return order[np.append(True, falling[1:] < least[:-1])[: len(order)]]


def _lists(offsets: np.ndarray, **columns: np.ndarray) -> pa.ListArray:
    values = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def cut_segments(chunks: DataFrame, generation: int = 0, size: int = SEGMENT) -> DataFrame:
    """Segments (``PART``) of chunks (project_no, seq, heading, text): a row per segment and gram, and one without a gram
    that lists the segment's chunks. Heading and text are indexed together."""
    words = F.regexp_replace(F.lower(F.concat(tx.text(F.col("heading")), F.lit(" "), tx.text(F.col("text")))), r"[^\p{L}\p{N}_]+", " ")
    rows = chunks.select(words.alias("words"), "project_no", F.col("seq").cast("long").alias("seq"))
    kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([(c, pa.int32()) for c in ("at", "tf", "len")])), pa.list_(pa.struct([("tf", pa.int32()), ("len", pa.int32())])), pa.list_(pa.struct([("at", pa.int32()), ("project_no", pa.string()), ("seq", pa.int64()), ("len", pa.int32())]))]
    names = ["segment", "gram", "postings", "impacts", "members"]

    def rows_of(segment: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        texts, numbers, seqs = zip(*held, strict=True)
        grams, starts, chunk, tf, lengths = _blocks(texts)
        members = [{"at": i, "project_no": p, "seq": s, "len": n} for i, (p, s, n) in enumerate(zip(numbers, seqs, lengths.tolist(), strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((segment, None, None, None, members), kinds, strict=True)], names)
        if grams:
            length, of = lengths[chunk], np.repeat(np.arange(len(grams)), np.diff(starts))
            best = _unbeaten(of, tf, length)
            impacts = _lists(np.append(0, np.cumsum(np.bincount(of[best], minlength=len(grams)))), tf=tf[best], len=length[best])
            postings = _lists(starts, at=chunk, tf=tf, len=length)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), segment)), pa.array(grams, pa.string()), postings, impacts, pa.nulls(len(grams), kinds[4])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        segment = generation << 48 | (context.partitionId() if context else 0) << 24
        held, chars = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                chars += len(row[0])
                if len(held) >= size or chars >= SEGMENT_CHARS:
                    yield from rows_of(segment, held)
                    held, chars, segment = [], 0, segment + 1
        if held:
            yield from rows_of(segment, held)

    return rows.mapInArrow(run, PART)


def _version(index: Index, version: int, paths: list[str], deleted: DataFrame | None, terms: DataFrame, totals: DataFrame) -> Index:
    new = Index(index.spark, index.folder, version)
    if deleted is not None:
        stage(deleted, f"{index.folder}/v{version}/deleted")
    stage(terms, f"{index.folder}/v{version}/terms")
    named = totals.select("n", "tokens", F.array(*map(F.lit, paths)).alias("paths"), F.lit(deleted is not None).alias("deleted"))
    stage(named, f"{index.folder}/v{version}/manifest")
    return new


def build_index(chunks: DataFrame, folder: str | None = None, size: int = SEGMENT) -> Index:
    """The index of chunks (project_no, seq, heading, text), written in ``folder``; without one, in the shared folder
    for as long as the application runs."""
    spark = chunks.sparkSession
    index = Index(spark, folder or shared_folder(spark))
    path = f"{index.folder}/g0"
    parts = stage(cut_segments(spread(chunks), 0, size), path)
    terms = parts.where("gram IS NOT NULL").groupBy("gram").agg(F.sum(F.size("postings")).alias("df"))
    totals = parts.where("gram IS NULL").select(F.explode("members").alias("m")).agg(F.count("*").alias("n"), F.coalesce(F.sum("m.len"), F.lit(0)).alias("tokens"))
    return _version(index, 0, [path], None, terms, totals)


def update_index(index: Index, changed: DataFrame, chunks: DataFrame, size: int = SEGMENT) -> Index:
    """The next version: all chunks of the ``changed`` notices (project_no) go and ``chunks`` come instead.

    Only ``chunks`` are cut, and only blocks of segments with a chunk that goes are read."""
    spark, version = index.spark, index.version + 1
    path = f"{index.folder}/g{version}"
    came = stage(cut_segments(chunks, version, size), path)
    gone = stage(index.members.join(changed.select("project_no").distinct(), "project_no", "left_semi"))
    touched = gone.select("segment").distinct()
    lost = index.blocks.join(touched, "segment", "left_semi").select("segment", "gram", F.explode("postings.at").alias("at")).join(gone.select("segment", "at"), ["segment", "at"], "left_semi")
    change = came.where("gram IS NOT NULL").select("gram", F.size("postings").cast("long").alias("d")).unionAll(lost.select("gram", F.lit(-1).cast("long").alias("d")))
    terms = index.terms.select("gram", F.col("df").alias("d")).unionAll(change).groupBy("gram").agg(F.sum("d").alias("df")).where("df > 0")
    new = came.where("gram IS NULL").select(F.explode("members").alias("m")).select(F.lit(1).alias("n"), F.col("m.len").alias("len"))
    n, tokens = index.totals
    totals = new.unionAll(gone.select(F.lit(-1).alias("n"), (-F.col("len")).alias("len"))).agg((F.coalesce(F.sum("n"), F.lit(0)) + n).alias("n"), (F.coalesce(F.sum("len"), F.lit(0)) + tokens).alias("tokens"))
    return _version(index, version, [*index.manifest.paths, path], index.deleted.unionAll(gone.select("segment", "at")), terms, totals)


def compact_index(index: Index) -> Index:
    """The next version without deleted chunks: segments that hold some lose their postings, the others are copied."""
    spark, version = index.spark, index.version + 1
    path = f"{index.folder}/g{version}"
    dead = index.deleted.groupBy("segment").agg(F.collect_set("at").alias("dead"))  # as many as a segment has chunks, at most
    x = index.parts.join(dead, "segment", "left")
    alive = lambda c: F.when(F.col("dead").isNull(), F.col(c)).otherwise(F.filter(c, lambda e: ~F.array_contains("dead", e["at"])))
    x = x.select("segment", "gram", alive("postings").alias("postings"), "impacts", alive("members").alias("members"))
    stage(x.where("gram IS NULL AND size(members) > 0 OR size(postings) > 0"), path)
    totals = spark.createDataFrame([index.totals], "n long, tokens long")
    return _version(index, version, [path], None, index.terms, totals)


def query_grams(queries: DataFrame) -> DataFrame:
    """(query_id, project_no, gram): the distinct grams of questions."""
    return queries.select("query_id", "project_no", F.explode(F.array_distinct(tx.bigrams(F.col("question")))).alias("gram"))


def saturation(tf, length, average: float):
    """What a posting gives for an idf of 1: columns and arrays alike."""
    return tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))


def score_segment(segment: pa.Table, asked: pa.Table, k: int, average: float, at_once: int = 256) -> pa.Table:
    """(query_id, project_no, seq, score) from a segment's rows and (query_id, only, gram, idf): chunks times grams, and
    grams times questions, as matrices of what the two have in common."""
    names = ["query_id", "project_no", "seq", "score"]
    lead = segment.filter(pc.is_null(segment["gram"]))
    members, dead = lead["members"].combine_chunks().flatten(), lead["dead"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    blocks = segment.filter(pc.is_valid(segment["gram"])).combine_chunks()
    place = pc.index_in(asked["gram"].combine_chunks(), value_set=blocks["gram"].combine_chunks())
    known = pc.is_valid(place).to_numpy(zero_copy_only=False)
    out = pa.table([pa.array([], asked.schema.field("query_id").type), pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
    if not known.any() or not len(members):
        return out
    used, column = np.unique(place.to_numpy(zero_copy_only=False)[known].astype(np.int64), return_inverse=True)
    lists = blocks["postings"].combine_chunks().take(pa.array(used))
    postings, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
    at, tf, length = (postings.field(c).to_numpy().astype(np.float64 if c != "at" else np.int64) for c in ("at", "tf", "len"))
    order = pc.sort_indices(pa.table([members.field("project_no"), members.field("seq")], names=["p", "s"]), sort_keys=[("p", "ascending"), ("s", "ascending")]).to_numpy()
    row = np.full(int(max(at.max(), pc.max(members.field("at")).as_py())) + 1, -1)
    row[members.field("at").to_numpy()[order]] = np.arange(len(order))
    row[dead.astype(np.int64)] = -1
    gives = np.zeros((len(order), len(used)))
    there = row[at] >= 0
    gives[row[at][there], np.repeat(np.arange(len(used)), n)[there]] = saturation(tf, length, average)[there]
    project, seq = members.field("project_no").take(pa.array(order)), members.field("seq").take(pa.array(order))
    queries = asked["query_id"].combine_chunks().dictionary_encode()
    query, idf = queries.indices.to_numpy()[known], asked["idf"].to_numpy()[known]
    only = [None] * len(queries.dictionary)
    for q, o in zip(queries.indices.to_pylist(), asked["only"].to_pylist(), strict=True):
        only[q] = o
    held = []
    for first in range(0, len(only), at_once):
        these = (query >= first) & (query < first + at_once)
        wanted = np.zeros((len(used), min(at_once, len(only) - first)))
        wanted[column[these], query[these] - first] = idf[these]
        scores = gives @ wanted
        for j, o in enumerate(only[first : first + at_once]):
            if o is not None:
                scores[~pc.equal(project, o).to_numpy(zero_copy_only=False), j] = 0
        least = np.partition(scores, -k, axis=0)[-k] if len(order) > k else np.zeros(scores.shape[1])
        x, q = np.nonzero((scores > 0) & (scores >= least - 1e-6))
        held.append(pa.table([queries.dictionary.take(pa.array(q + first)), project.take(pa.array(x)), seq.take(pa.array(x)), pa.array(scores[x, q])], names=names))
    return pa.concat_tables([out, *held])


@dataclass
class Hunt:
    """One search under way: question grams with their idf, a bound per question and segment, and what it opens."""

    index: Index
    grams: DataFrame
    bounds: DataFrame
    k: int

    def scores(self, opened: DataFrame) -> DataFrame:
        """(query_id, project_no, seq, score) of the opened (query_id, segment): of each the ``k`` best chunks, and what
        rounding may put level with them."""
        index, k, average = self.index, self.k, self.index.average
        dead = index.deleted.groupBy("segment").agg(F.collect_set("at").alias("dead"))  # as many as a segment has chunks, at most
        parts = index.parts.drop("impacts").join(opened.select("segment").distinct(), "segment", "left_semi").join(dead, "segment", "left")
        parts = parts.withColumn("dead", F.when(F.col("gram").isNull(), F.col("dead")))
        asked = opened.join(self.grams, "query_id").select("segment", "query_id", "only", "gram", "idf")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return score_segment(left, right, k, average)

        kind = self.grams.schema["query_id"].dataType.simpleString()
        found = parts.groupBy("segment").cogroup(asked.groupBy("segment")).applyInArrow(run, f"query_id {kind}, project_no string, seq long, score double")
        return found.withColumn("score", F.round("score", 6)).where("score > 0")

    def best(self, scored: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "project_no", "seq")
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k)

    def run(self, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
        """(the best chunks, the opened (query_id, segment))."""
        w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment")
        ranked = stage(self.bounds.withColumn("at", F.row_number().over(w)))
        begun = ranked.where(F.col("at") <= first)
        found = stage(self.best(self.scores(begun)))
        least = found.where(F.col("rank") == self.k).select("query_id", F.col("score").alias("least"))
        # a score is rounded, a bound is not
        rest = stage(ranked.where(F.col("at") > first).join(least, "query_id", "left").where("least IS NULL OR bound + 1e-6 >= least").select("query_id", "segment"))
        every = self.best(found.drop("rank").unionByName(self.scores(rest)))
        return every, begun.select("query_id", "segment").unionByName(rest)


def hunt(index: Index, queries: DataFrame, k: int = 6) -> Hunt:
    """Bounds for queries (query_id, question, project_no)."""
    grams = query_grams(queries).select("query_id", F.col("project_no").alias("only"), "gram").join(index.idf.select("gram", "idf"), "gram")
    this = Hunt(index, stage(grams), None, k)
    some = this.grams.where("only IS NOT NULL").select("only").distinct()
    most = F.array_max(F.transform("impacts", lambda i: saturation(i["tf"], i["len"], index.average)))
    x = index.blocks.select("segment", "gram", most.alias("most")).join(this.grams, "gram")
    bounds = x.groupBy("query_id", "only", "segment").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
    this.bounds = bounds.where("only IS NULL").select("query_id", "segment", "bound")
    if not some.isEmpty():  # a question about one notice looks at that notice's segments only
        holders = index.members.select("segment", F.col("project_no").alias("only")).join(some, "only", "left_semi").distinct()
        own = bounds.where("only IS NOT NULL").join(stage(holders), ["segment", "only"], "left_semi")
        this.bounds = this.bounds.unionByName(own.select("query_id", "segment", "bound"))
    return this


def search(index: Index, queries: DataFrame, k: int = 6) -> DataFrame:
    """(query_id, project_no, seq, score, rank) for queries (query_id, question, project_no); a query with a
    project_no looks at that notice only, with the statistics of all. Ties go by chunk order."""
    return hunt(index, queries, k).run()[0]
