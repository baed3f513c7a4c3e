"""Audit of how the sources of a language diverge, by chunk factorization.

Whitespace chunks are counted per document, in shards of one input partition (``shards``); a document lies in one shard,
so the shard adds its counts up by language, chunk and source before anything moves, and keeps with them the numbers of
up to ``least`` documents that hold the chunk. One row per shard, language and chunk is dealt by chunk: no chunk is hot,
and each distinct chunk of the corpus is taken apart into its terms once, which join its added-up counts. These are
dealt by language and term. The union of up to ``least`` document numbers of each chunk says exactly whether so many
documents hold the term; terms in fewer go.

Comparing sources needs all of a term's counts together. The kept terms of a language are dealt into blocks by hash, so
many that a block's matrix (sources x terms) stays within ``CELLS``; a block adds up what each pair of sources differs by
over its terms, and keeps the ``TOP`` terms of each source. What goes on is one number per block and pair, and ``TOP``
terms per block and source. All arithmetic is in integers; where 64 bits might not hold a product or a sum, in unbounded
ones. On the way sources are 64-bit hashes, after a check that no two of the table's share one.

Defined results: null text, lang and source are empty; rows that repeat an id are documents of their own; a group
without terms has counts of 0; a language without kept terms has pairs of value 0; a language with one source has no
pairs; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import read_table, release, staged
from noticeloom.llm.shards import count_matrix, runs_of_texts, split_words

LEAST_DOCUMENTS, TOP, SCALE = 3, 200, 1_000_000_000
#: Text of a shard.
SHARD_BYTES = 32 << 20
#: A block's matrix has about so many cells, and so many terms at most.
CELLS, TERMS = 1 << 20, 4096
#: Languages up to which their sizes are broadcast.
BROADCAST = 100_000
#: What is not part of a term, as ASCII ranges.
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def chunk_terms(chunks: pa.Array) -> pa.Array:
    """The terms of each chunk, joined by spaces."""
    return pc.ascii_trim(pc.replace_substring_regex(pc.ascii_lower(chunks), _BETWEEN, " "), " ")


def _run_starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(x, prepend=-1))


def _ragged(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (n[0] of them), starts[1], ..."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Tally:
    """Rows of counts by source and of document numbers; ``m`` sources and ``d`` documents a row."""

    def __init__(self, m, sources, counts, d, docs):
        self.m, self.sources, self.counts, self.d, self.docs = m, sources, counts, d, docs

    def packed(self) -> pa.Array:
        """Each row as 64-bit integers: how many sources, the sources, their counts, the documents."""
        n = 1 + 2 * self.m + self.d
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int64)
        out[at] = self.m
        out[_ragged(at + 1, self.m)] = self.sources
        out[_ragged(at + 1 + self.m, self.m)] = self.counts
        out[_ragged(at + 1 + 2 * self.m, self.d)] = self.docs
        edges = 8 * np.append(at, len(out))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(out)]).cast(pa.binary())

    @staticmethod
    def unpacked(rows: pa.Array) -> Tally:
        rows = rows.cast(pa.large_binary())
        edges = np.frombuffer(rows.buffers()[1], "<i8")[rows.offset : rows.offset + len(rows) + 1] // 8
        raw = np.frombuffer(rows.buffers()[2] or b"", np.int64)
        at = edges[:-1]
        m = raw[at]
        d = np.diff(edges) - 1 - 2 * m
        return Tally(m, raw[_ragged(at + 1, m)], raw[_ragged(at + 1 + m, m)], d, raw[_ragged(at + 1 + 2 * m, d)])

    def repeated(self, times: np.ndarray) -> Tally:
        """Each row as often as ``times`` says."""
        row = np.repeat(np.arange(len(times)), times)
        s, d = _ragged((np.cumsum(self.m) - self.m)[row], self.m[row]), _ragged((np.cumsum(self.d) - self.d)[row], self.d[row])
        return Tally(self.m[row], self.sources[s], self.counts[s], self.d[row], self.docs[d])

    def merged(self, run: np.ndarray, least: int) -> Tally:
        """Rows of equal ``run`` (0, 0, 1, ...) as one: counts added up, the first ``least`` distinct documents."""
        n = int(run[-1]) + 1 if len(run) else 0
        of, docs_of = np.repeat(run, self.m), np.repeat(run, self.d)
        order = np.lexsort((self.sources, of))
        of, sources, counts = of[order], self.sources[order], self.counts[order]
        first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (sources[1:] != sources[:-1]))) if len(of) else np.empty(0, int)
        counts = np.add.reduceat(counts, first) if len(first) else counts
        m = np.bincount(of[first], minlength=n)
        order = np.lexsort((self.docs, docs_of))
        docs_of, docs = docs_of[order], self.docs[order]
        keep = np.append(True, (docs_of[1:] != docs_of[:-1]) | (docs[1:] != docs[:-1]))[: len(docs)]
        docs_of, docs = docs_of[keep], docs[keep]
        d = np.bincount(docs_of, minlength=n)
        keep = np.arange(len(docs)) - np.repeat(np.cumsum(d) - d, d) < least
        return Tally(m, sources[first], counts, np.minimum(d, least), docs[keep])


def shard_tally(texts: pa.Array, lang: pa.Array, source: np.ndarray, number: int, least: int) -> tuple[pa.Array, pa.Array, Tally]:
    """(chunks, languages, their tally) of a shard whose documents have the numbers from ``number``."""
    words, at, sizes = split_words(texts)
    starts, columns, counts = count_matrix(at, sizes, len(words))
    del at
    n_docs = len(starts) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(starts))
    langs = lang.dictionary_encode()
    sources, source_of = np.unique(source, return_inverse=True)
    row = columns * len(langs.dictionary) + langs.indices.to_numpy()[doc]
    held = row * n_docs + doc
    held.sort()
    of = held // max(n_docs, 1)
    first = _run_starts(of)
    d = np.diff(np.append(first, len(of)))
    keep = np.arange(len(of)) - np.repeat(first, d) < least
    docs, keys = number + held[keep] % max(n_docs, 1), of[first]
    seen = np.repeat(row * max(len(sources), 1) + source_of[doc], counts)
    seen.sort()
    first = _run_starts(seen)
    n, seen = np.diff(np.append(first, len(seen))), seen[first]
    m = np.diff(np.append(_run_starts(seen // max(len(sources), 1)), len(seen)))
    width = max(len(langs.dictionary), 1)
    return words.take(pa.array(keys // width)), langs.dictionary.take(pa.array(keys % width)), Tally(m, sources[seen % max(len(sources), 1)], n, np.minimum(d, least), docs)


def merged_runs(batches: Iterator[pa.RecordBatch], least: int, at_once: int = 50_000) -> Iterator[tuple[list[pa.Array], Tally]]:
    """Rows (two keys, packed tally) in order of their keys, those of equal keys merged: some thousands at a time."""

    def take(held: list[pa.RecordBatch], last: bool) -> tuple[tuple[list[pa.Array], Tally] | None, list[pa.RecordBatch]]:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = table.columns[:2]
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            new[1:] |= pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False)
        tally = Tally.unpacked(table.column(2)).merged(np.cumsum(new) - 1, least)
        keys = [k.filter(pa.array(new)) for k in keys]
        if last:
            return (keys, tally), []
        # the last run may go on
        n, x, y = len(tally.m) - 1, int(tally.m[-1]), int(tally.d[-1])
        rest = Tally(tally.m[n:], tally.sources[len(tally.sources) - x :], tally.counts[len(tally.counts) - x :], tally.d[n:], tally.docs[len(tally.docs) - y :])
        rest = pa.RecordBatch.from_arrays([*(k.slice(n) for k in keys), rest.packed()], table.schema.names)
        done = Tally(tally.m[:n], tally.sources[: len(tally.sources) - x], tally.counts[: len(tally.counts) - x], tally.d[:n], tally.docs[: len(tally.docs) - y])
        return ([k.slice(0, n) for k in keys], done) if n else None, [rest]

    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= at_once:
            found, held = take(held, False)
            rows = 1
            if found:
                yield found
    if held:
        yield take(held, True)[0]


def term_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS, shard_bytes: int = SHARD_BYTES, seed: int = 0) -> DataFrame:
    """Staged (lang, term, counts: [(source's hash with ``seed``, n)]) of the terms in at least ``least`` documents of
    their language."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 36
        for b in runs_of_texts(batches, shard_bytes):
            chunks, lang, tally = shard_tally(b.column(0), b.column(1), b.column(2).to_numpy(), number, least)
            number += b.num_rows
            step = 1 << 16
            packed = tally.packed()
            for i in range(0, len(chunks), step):
                yield pa.RecordBatch.from_arrays([x.slice(i, step) for x in (chunks, lang, packed)], ["chunk", "lang", "tally"])

    def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunks, lang), tally in merged_runs(batches, least):
            new = np.append(True, pc.not_equal(chunks.slice(1), chunks.slice(0, len(chunks) - 1)).to_numpy(zero_copy_only=False))
            terms = pc.split_pattern(chunk_terms(chunks.filter(pa.array(new))), " ").take(pa.array(np.cumsum(new) - 1))
            flat, n = terms.flatten(), np.diff(terms.offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # a chunk without terms
            if keep.any():
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(row[keep])), flat.filter(pa.array(keep)), tally.repeated(np.bincount(row[keep], minlength=len(n))).packed()], ["lang", "term", "tally"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, term), tally in merged_runs(batches, least):
            counts = pa.StructArray.from_arrays([pa.array(tally.sources), pa.array(tally.counts)], ["source", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tally.m)).astype(np.int32)), counts)
            enough = pa.array(tally.d >= least)
            yield pa.RecordBatch.from_arrays([lang.filter(enough), term.filter(enough), lists.filter(enough)], ["lang", "term", "counts"])

    rows = docs.select(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")), _hashed(seed)).mapInArrow(counted, "chunk string, lang string, tally binary")
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "lang").mapInArrow(taken_apart, "lang string, term string, tally binary")
    rows = rows.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(kept, "lang string, term string, counts array<struct<source:bigint,n:bigint>>")
    found = staged(rows)
    release(docs.sparkSession)
    return found


def _hashed(seed: int) -> Column:
    return F.xxhash64(F.coalesce("source", F.lit("")), F.lit(seed)).alias("hash")


def seed_of(groups: DataFrame) -> int:
    """The first seed under which the sources of ``groups`` have different hashes: as good as always 0."""
    sources, seed = groups.select("source").distinct(), 0
    while sources.groupBy(_hashed(seed)).count().where("count > 1").limit(1).count():
        seed += 1
    return seed


def block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of equal (lang, block), which lead the columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in b.columns[:2]]
        cuts = [0, *(np.flatnonzero(new[0] | new[1]) + 1).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            part = b.slice(x, y - x)
            if held and any(held[-1].column(i)[-1].as_py() != part.column(i)[0].as_py() for i in (0, 1)):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def shares(counts: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exactly."""
    if counts.size and int(counts.max()) + 1 > (2**63 - 1) // SCALE:
        return 1 + (SCALE * (counts.astype(object) + 1) // total).astype(np.int64)
    return 1 + SCALE * (counts + 1) // total


def exact_sums(f: np.ndarray) -> list[int]:
    """Sums of rows of non-negative 64-bit integers."""
    if f.size and int(f.max()) * f.shape[1] >= 2**63:
        return [sum(row) for row in f.tolist()]
    return f.sum(axis=1).tolist()


def block_values(block: pa.Table) -> tuple[list, list, list, list]:
    """(sources, parts, items, values) of a block: its rows without a term say a source's name and sum and the terms of
    the language, the others are terms in order."""
    groups = block.filter(pc.is_null(block["term"]))
    rows = block.slice(groups.num_rows)
    listed = groups["counts"].combine_chunks().flatten()
    sources, sums, width = listed.field("source"), listed.field("n").to_numpy(), groups["v"][0].as_py()
    lists = rows["counts"].combine_chunks()
    entries = lists.flatten()
    counts = np.zeros((len(sources), rows.num_rows), np.int64)
    counts[pc.index_in(entries.field("source"), value_set=sources).to_numpy(), np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))] = entries.field("n").to_numpy()
    of, part, item, value = [], [], [], []
    name = groups["name"].to_pylist()
    p = shares(counts, (sums + width)[:, None]) if rows.num_rows else counts
    q = shares(counts.sum(axis=0), int(sums.sum()) + width) if rows.num_rows else counts.sum(axis=0)
    terms = rows["term"].combine_chunks()
    for i, s in enumerate(name):
        d = p[i] - p
        added = exact_sums(d * d // p) if rows.num_rows else [0] * len(name)
        others = [j for j in range(len(name)) if j != i]
        more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
        d = p[i][more] - q[more]
        f = d * d // q[more]
        top = np.argsort(-f, kind="stable")[:TOP]
        of += [s] * (len(others) + len(top))
        part += ["pair"] * len(others) + ["term"] * len(top)
        item += [name[j] for j in others] + terms.take(pa.array(more[top])).to_pylist()
        value += [added[j] for j in others] + f[top].tolist()
    return of, part, item, value


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source)."""
    groups = staged(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct())
    seed = seed_of(groups)
    kept = term_counts(docs, least, shard_bytes, seed)
    sums = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("hash")).agg(F.sum("c.n").alias("n"))
    groups = staged(groups.withColumn("hash", _hashed(seed)).join(sums, ["lang", "hash"], "left").select("lang", "source", "hash", F.coalesce("n", F.lit(0)).alias("n")))
    fit = F.greatest(F.lit(16), F.least(F.lit(TERMS), F.floor(F.lit(CELLS) / F.col("s"))))
    langs = groups.groupBy("lang").agg(F.count("*").alias("s")).join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    langs = langs.select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) / fit)).cast("int").alias("blocks"))
    langs = staged(langs)
    langs = F.broadcast(langs) if langs.count() <= BROADCAST else langs
    terms = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "term", "counts", "v", F.lit(None).cast("string").alias("name"))
    each = groups.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), F.array(F.struct(F.col("hash").alias("source"), "n")).alias("counts"), "v", F.col("source").alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in block_runs(batches):
            of, part, item, value = block_values(block)
            lang = pa.array([block["lang"][0].as_py()] * len(of), pa.string())
            yield pa.RecordBatch.from_arrays([lang, pa.array(of, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array([Decimal(v) for v in value], pa.decimal128(38, 0))], ["lang", "source", "part", "item", "value"])

    dealt = terms.unionByName(each).repartition("lang", "block").sortWithinPartitions("lang", "block", F.asc_nulls_first("term"))
    found = staged(dealt.mapInArrow(run, "lang string, source string, part string, item string, value decimal(38,0)"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").cast("long").alias("value"))
    terms = found.where("part = 'term'").withColumn("value", F.col("value").cast("long"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(w)).unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source of each language diverges from the others and from its language, over all documents."""
    return divergence(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), o AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL
), k AS (
  SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // CAST(sum(n) OVER (PARTITION BY lang, source) + v AS HUGEINT) AS p
  FROM x JOIN v USING (lang)
), l AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // CAST(sum(n) OVER (PARTITION BY lang) + v AS HUGEINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM x GROUP BY lang, term) JOIN v USING (lang)
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((a.p - b.p) * (a.p - b.p)) // b.p), 0) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), z AS (
  SELECT * FROM f
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, ((p.p - l.q) * (p.p - l.q)) // l.q FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.n > 0 AND p.p > l.q
), r AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM z
)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""
