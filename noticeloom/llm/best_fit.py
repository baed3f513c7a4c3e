"""Best-fit packing by exact complements.

Whole documents go into as few sequences as possible; only documents longer than a sequence are cut. What matters for
that is how many pieces of each length there are: at most ``CAPACITY`` counts whatever the size of the corpus. The plan
is made from these counts. The longest length left opens a sequence; its gap is looked up among single lengths, sums of
two and sums of three lengths that are still available, and a combination that fills the gap exactly is consumed. If
none does, the longest length that fits goes in and the new gap is looked up. A filling is repeated as often as the
counts allow, so a plan is a bounded list of (lengths, how often), not of sequences.

Documents are tokenised once; pieces are staged in the shared folder with their task and their number among the task's
pieces of equal length. A piece's number among all pieces of its length (counts of tasks summed up) says in which
filling of the plan it stands, hence its sequence and its offset: no piece is shuffled, a hot source or length changes
nothing, and a task that runs again gives the same rows.

Defined results: a null text is empty and has the end token only; repeated rows and null ids are documents of their
own; an empty table gives no rows; other columns are ignored. Sequence ids run from 0 without gaps."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm import packing
from noticeloom.llm.common import read_table, staged
from noticeloom.llm.shards import runs_of_texts, split_words

CAPACITY, END = 4096, 1
#: Rows of (task, length) counts that are broadcast at most; beyond that pieces are joined with them by a shuffle.
BROADCAST = 500_000
#: Text that a task encodes at a time, and words whose ids it remembers.
_RUN_BYTES, _KNOWN = 8 << 20, 500_000


class Complements:
    """Available pieces by length, with the sums of one, two and three of them that exist."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.size = len(counts)  # lengths 0 .. capacity
        self.lengths = np.flatnonzero(self.left)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.left[x] -= times
        if any(self.left[x] <= 0 for x in lengths):
            self.lengths = np.flatnonzero(self.left > 0)

    def single(self, gap: int) -> tuple[int, ...]:
        return (gap,) if self.left[gap] > 0 else ()

    def pair(self, gap: int, spare: np.ndarray | None = None) -> tuple[int, ...]:
        """Two lengths of sum ``gap``, the longest first; of equal ones there must be two."""
        left = self.left if spare is None else spare
        a = self.lengths[np.searchsorted(self.lengths, (gap + 1) // 2) : np.searchsorted(self.lengths, gap)]
        b = gap - a
        found = np.flatnonzero((left[a] > 0) & (left[b] > (a == b)))
        return (int(a[found[-1]]), int(b[found[-1]])) if len(found) else ()

    def triple(self, gap: int) -> tuple[int, ...]:
        """Three lengths of sum ``gap``, the longest first."""
        for a in self.lengths[np.searchsorted(self.lengths, (gap + 2) // 3) : np.searchsorted(self.lengths, gap)][::-1].tolist():
            self.left[a] -= 1
            rest = self.pair(gap - a) if gap - a <= 2 * a else ()
            self.left[a] += 1
            if rest and rest[0] <= a:
                return (a, *rest)
        return ()

    def best(self, gap: int) -> tuple[int, ...]:
        at = int(np.searchsorted(self.lengths, gap, side="right"))
        return (int(self.lengths[at - 1]),) if at else ()


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how often)] for ``counts[length]`` pieces of each length up to ``capacity``."""
    stock, out = Complements(counts), []
    while len(stock.lengths):
        first = int(stock.lengths[-1])
        filling, gap = (first,), capacity - first
        stock.take(filling, 1)
        while gap:
            more = stock.single(gap) or stock.pair(gap) or stock.triple(gap) or stock.best(gap)
            if not more:
                break
            stock.take(more, 1)
            filling += more
            gap -= sum(more)
        needed = {x: filling.count(x) for x in filling}
        again = min(int(stock.left[x]) // n for x, n in needed.items())
        if again:
            for x, n in needed.items():
                stock.left[x] -= again * n
            stock.lengths = np.flatnonzero(stock.left > 0)
        out.append((filling, 1 + again))
    return out


def places(fillings: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: (first numbers, sequences of these, offsets there) of the stretches of pieces of that length."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for filling, times in fillings:
        offset = 0
        for x in filling:
            at = used.get(x, 0)
            rows.setdefault(x, []).append((at, sequence, offset))
            used[x] = at + times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in rows.items()}


def encoded(encoder: packing.WordEncoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, ids of each text): each distinct word of the texts is looked up once."""
    words, at, sizes = split_words(texts)
    listed = words.to_pylist()
    if len(encoder.known) > _KNOWN:  # the first words met are the frequent ones
        encoder.known = dict(islice(encoder.known.items(), _KNOWN // 2))
    if new := list(filterfalse(encoder.known.__contains__, listed)):
        encoder._learn(new)
    ids = [encoder.known[w] for w in listed]
    lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat, firsts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lengths) - lengths
    n = lengths[at]
    ends = np.cumsum(n)
    out = flat[np.repeat(firsts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    edges = np.append(0, ends)[np.append(0, np.cumsum(sizes))]
    return out, np.diff(edges)


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Staged (doc_id, piece, start, length, ids, task, nth): the nth piece of its length in its task, from 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = packing._encoder(tokenizer)
        context = TaskContext.get()
        task, met = context.partitionId() if context else 0, np.zeros(capacity + 1, np.int64)
        for b in runs_of_texts(batches, _RUN_BYTES):
            flat, sizes = encoded(encoder, b.column(0))
            ends = np.cumsum(sizes + 1)
            ids = np.empty(int(ends[-1]), "<u4")
            ids[ends - 1] = end
            inside = np.ones(len(ids), bool)
            inside[ends - 1] = False
            ids[inside] = flat
            whole = sizes + 1
            pieces = -(-whole // capacity)
            doc = np.repeat(np.arange(len(whole)), pieces)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * capacity
            length = np.minimum(whole[doc] - start, capacity)
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            first = np.flatnonzero(np.diff(sorted_, prepend=-1))
            run_of = np.repeat(first, np.diff(np.append(first, len(sorted_))))
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(sorted_)) - run_of + met[sorted_]
            met += np.bincount(length, minlength=capacity + 1)
            edges = np.append(np.cumsum(length) - length, len(ids)).astype(np.int64) * 4
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(edges), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(1).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), blob, pa.array(np.full(len(doc), task), pa.int32()), pa.array(nth)],
                ["doc_id", "piece", "start", "length", "ids", "task", "nth"],
            )

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"))
    return staged(rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary, task int, nth long"))


def pack_best_fit(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset)."""
    pieces = token_pieces(docs, tokenizer, id_col, text_col, capacity, end)
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = staged(pieces.groupBy("length", "task").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():  # a row per length: at most ``capacity``
        counts[length] = n
    where = places(plan(counts, capacity), capacity)
    before = by_task.select("length", "task", "before")
    before = F.broadcast(before) if before.count() <= BROADCAST else before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, n = b["length"].to_numpy(), b["n"].to_numpy()
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(n) else []:
                firsts, sequences, offsets = where[int(length[rows[0]])]
                at = np.searchsorted(firsts, n[rows], side="right") - 1
                sequence[rows] = sequences[at] + n[rows] - firsts[at]
                offset[rows] = offsets[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    x = pieces.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids", (F.col("before") + F.col("nth")).alias("n"))
    return x.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids binary, sequence_id long, offset long")


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with a checksum of their ids."""
    found = pack_best_fit(read_table(spark, sf_dir, "documents"), packing.default_tokenizer())
    return found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
