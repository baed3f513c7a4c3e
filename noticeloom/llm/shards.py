"""Corpora as sparse document-term matrices, in shards.

A shard is a run of documents of one input partition, cut at ``SHARD_BYTES`` of text. Its words are the maximal runs
between ASCII white space; it holds its distinct words once, and its matrix as CSR arrays (row starts, local columns,
counts). What has to meet globally is one row per shard and distinct word, never one per occurrence, so the most
frequent word of the corpus is one row per shard: no key is hot. ``by_word`` deals those rows by word, shows each
distinct word to a function once, and ``with_words`` brings its answers back to the shards.

A task holds one shard at a time, a shard its documents' words; a document longer than a shard is a shard of its own.
Shards are staged in the shared folder: what reads them later survives the loss of any executor, and their numbers stay
what they were."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from noticeloom.llm.common import staged

SHARD_BYTES = 16 << 20
#: Bytes of text that are split at once: the words of a whole shard as an array take several times its size.
SPLIT_BYTES = 1 << 20


def squeezed(x: np.ndarray) -> bytes:
    """An integer array as compressed bytes with its length in front."""
    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(b: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b"", kind)


def split_words(texts: pa.Array, step: int = SPLIT_BYTES) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, word of each occurrence, words of each text). Texts are split about ``step`` bytes at once, so
    that only the distinct words and the codes of all of them are held together."""
    coded, sizes = [], []
    for i, j in _stretches_of(texts, step):
        parts = pc.ascii_split_whitespace(texts.slice(i, j - i))
        edges = parts.offsets.to_numpy()
        sizes.append(np.diff(edges))
        coded.append(parts.flatten().dictionary_encode())
        del parts
    if not coded:
        coded, sizes = [pa.array([], texts.type).dictionary_encode()], [np.zeros(0, np.int32)]
    whole = pa.chunked_array(coded).unify_dictionaries()
    del coded
    words, at = whole.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in whole.chunks])
    sizes = np.concatenate(sizes)
    edges = np.append(0, np.cumsum(sizes))
    empty = pc.index(words, "").as_py()  # before leading and after trailing white space
    if empty >= 0:
        none = at == empty
        edges = edges - np.append(0, np.cumsum(none))[edges]
        at = at[~none]
        at -= at > empty
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return words, at, np.diff(edges)


def _stretches_of(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text is one of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def count_matrix(at: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR (row starts, columns, counts) of occurrences listed row by row."""
    key = np.repeat(np.arange(len(sizes), dtype=np.int64) * max(width, 1), sizes)
    key += at
    key.sort()
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    first = np.flatnonzero(new)
    del new
    counts = np.diff(np.append(first, len(key)))
    key = key[first]
    starts = np.searchsorted(key, np.arange(len(sizes) + 1, dtype=np.int64) * max(width, 1))
    return starts, key % max(width, 1), counts


def runs_of_texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of their first column, a text; a longer text makes a batch of its own."""
    held, size = [], 0
    for b in batches:
        lengths = pc.binary_length(b.column(0)).to_numpy(zero_copy_only=False)
        at = 0
        while at < b.num_rows:
            n = int(np.searchsorted(np.cumsum(lengths[at:]), max(most - size, 1), side="right"))
            n = max(n, 0 if held else 1)
            if n:
                held.append(b.slice(at, n))
                size += int(lengths[at : at + n].sum())
                at += n
            if at < b.num_rows or size >= most:
                whole, held, size = pa.Table.from_batches(held).combine_chunks().to_batches()[0], [], 0
                yield whole
                del whole
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def count_shards(docs: DataFrame, text_col: str = "text", carried: tuple[str, ...] = (), shard_bytes: int = SHARD_BYTES, measured: tuple[tuple[str, str], ...] = (), measure: Callable[[pa.Array], list] | None = None) -> DataFrame:
    """Staged shards: (shard, words, starts, columns, counts, and of each carried column the documents' values as an
    array). A null text is empty. ``measure`` gives the ``measured`` (name, type) columns of the texts of a shard."""
    fields = [(c, docs.schema[c].dataType.simpleString()) for c in carried] + list(measured)
    source = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"), *carried)
    schema = ", ".join(["shard long", "words array<string>", "starts binary", "columns binary", "counts binary", *(f"`{c}` array<{t}>" for c, t in fields)])
    names = ["shard", "words", "starts", "columns", "counts", *(c for c, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = (context.partitionId() if context else 0) << 32
        for b in runs_of_texts(batches, shard_bytes):
            words, at, sizes = split_words(b.column(0))
            starts, columns, counts = count_matrix(at, sizes, len(words))
            del at
            extra = [*b.columns[1:], *(measure(b.column(0)) if measure else ())]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words, *extra)]
            blobs = [pa.array([squeezed(x)], pa.binary()) for x in (starts.astype(np.int64), columns.astype(np.int32), counts.astype(np.int32))]
            del b, extra, starts, columns, counts, words
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), lists[0], *blobs, *lists[1:]], names)
            shard += 1
            del lists, blobs
            pa.default_memory_pool().release_unused()

    return staged(source.mapInArrow(run, schema))


def by_word(shards: DataFrame, answer: Callable[[pa.Array, int], pa.Array], kind: str) -> DataFrame:
    """(shard, local, answer): what ``answer(distinct words, how many came before in this task)`` says of each word of
    each shard. Each distinct word of the corpus is shown once, in a task that streams over its words in order."""
    kind_arrow = to_arrow_type(_parsed(shards, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        seen, last, said = (context.partitionId() if context else 0) << 36, None, None
        for b in batches:
            if not b.num_rows:
                continue
            words = b.column(0)
            new = np.empty(b.num_rows, bool)
            new[0] = last is None or words[0].as_py() != last
            new[1:] = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
            fresh = answer(words.filter(pa.array(new)), seen)
            seen += len(fresh)
            at = np.cumsum(new) - 1
            if not new[0]:  # the word of the batch before goes on
                fresh, at = pa.concat_arrays([said, fresh]), at + 1
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), fresh.take(pa.array(at)).cast(kind_arrow)], ["shard", "local", "answer"])
            last, said = words[-1].as_py(), fresh.slice(len(fresh) - 1)

    pairs = shards.select("shard", F.posexplode("words").alias("local", "word")).select("word", "shard", "local")
    return pairs.repartition("word").sortWithinPartitions("word").mapInArrow(run, f"shard long, local int, answer {kind}")


def _parsed(df: DataFrame, kind: str):
    return df.sparkSession.createDataFrame([], f"x {kind}").schema[0].dataType


def with_words(shards: DataFrame, answers: DataFrame, make: Callable[[dict, pa.Array], Iterator[pa.Table] | pa.Table], schema: str) -> DataFrame:
    """``make(shard's columns, answers by local column)`` of each shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.empty(right.num_rows, np.int64)
        order[right["local"].to_numpy()] = np.arange(right.num_rows)
        return make({c: left[c][0] for c in left.column_names}, right["answer"].combine_chunks().take(pa.array(order)))

    return shards.drop("words").groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, schema)


def dictionary_ids(shards: DataFrame) -> DataFrame:
    """(shard, local, answer): a number for each distinct word of the corpus."""
    return by_word(shards, lambda words, seen: pa.array(np.arange(seen, seen + len(words)), pa.int64()), "bigint")


def csr_shards(shards: DataFrame, ids: DataFrame) -> DataFrame:
    """Shards whose columns are global: (shard, starts, columns (64-bit ids), counts, and what they carry)."""
    carried = [f for f in shards.schema.fields if f.name not in ("shard", "words", "starts", "columns", "counts")]
    schema = ", ".join(["shard long", "starts binary", "columns binary", "counts binary", *(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)])

    def make(shard: dict, of: pa.Array) -> pa.Table:
        columns = of.to_numpy(zero_copy_only=False)[unsqueezed(shard["columns"].as_py(), "<i4")]
        values = [shard["shard"].as_py(), shard["starts"].as_py(), squeezed(columns.astype(np.int64)), shard["counts"].as_py()]
        cols = [pa.array([v]) for v in values] + [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v.values) for v in (shard[f.name] for f in carried)]
        return pa.table(cols, names=["shard", "starts", "columns", "counts", *(f.name for f in carried)])

    return with_words(shards, ids, make, schema)


def dictionary(shards: DataFrame, ids: DataFrame) -> DataFrame:
    """(word, id) of all distinct words."""
    words = shards.select("shard", F.posexplode("words").alias("local", "word"))
    return words.join(ids, ["shard", "local"]).groupBy("word").agg(F.min("answer").alias("id"))
