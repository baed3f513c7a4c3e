"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each task streams over its documents, tokenises them, cuts documents of more than ``MAX_PIECE`` tokens into near-equal
pieces, and closes a batch whenever it holds the tokens of ``WINDOWS`` windows. Within a batch, differencing starts with
one partial partition per piece and always merges the two with the largest imbalance, the fullest windows of one with
the emptiest of the other, until one near-equal partition is left. Whenever a window exceeds its capacity, the window
count rises by one and the batch is partitioned anew. What room the windows then have is filled, by cutting, from the
emptiest of them, whose rest goes on to the next batch; so windows are full. Of what remains at a task's end, as many
windows as it fills are packed likewise and the rest, less than one window, goes into sequences whose lengths are powers
of two, which need no padding.

No shuffle: a document never leaves its task, and a task holds one batch (``WINDOWS`` windows of ids), so a hot source
or a very long document changes nothing. Sequence ids are the partition's number and a counter, so a task that runs
again on another executor gives the same rows.
Defined results: a null text is empty and has the end token only; repeated rows and null ids are documents of their
own; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import heapq
import os
import re
import sys
import types
from collections.abc import Iterator
from itertools import chain, filterfalse, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import read_table

CAPACITY, WINDOWS, MAX_PIECE, END = 4096, 128, 1024, 2
_CACHED_WORDS, _CACHED_PARTS = 250_000, 400_000


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Items by window: Karmarkar-Karp differencing of ``sizes`` into ``k`` windows.

    A partial partition is its filled windows, fullest first."""
    heap = [(-s, i, np.array([s], np.int64), [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    for n in range(len(sizes), 2 * len(sizes) - 1):
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        width = min(k, len(a) + len(b))
        sums, items = np.zeros(width, np.int64), in_a + [[]] * (width - len(a))
        sums[: len(a)] = a
        sums[width - len(b) :] += b[::-1]
        for j, x in enumerate(reversed(in_b), width - len(b)):
            items[j] = items[j] + x if items[j] else x
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int((sums[-1] if width == k else 0) - sums[0]), n, sums, [items[j] for j in order.tolist()]))
    return heap[0][3] if heap else []


def pack(sizes: list[int], k: int, capacity: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """((item, start, length) by window, those left over). The window count is ``k`` or, until no window is over
    capacity, more; the emptiest window then fills the room of the others, and what it has left is left over."""
    if not sizes:
        return [], []
    k = max(k, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            break
        k += 1
    windows = sorted(([(i, 0, sizes[i]) for i in w] for w in found), key=lambda w: -sum(n for *_, n in w))
    room = [capacity - sum(n for *_, n in w) for w in windows]
    at = 0
    while at < len(windows) - 1:
        if not room[at]:
            at += 1
            continue
        i, start, n = windows[-1].pop()
        x = min(room[at], n)
        windows[at].append((i, start, x))
        room[at] -= x
        if n > x:
            windows[-1].append((i, start + x, n - x))
        elif not windows[-1]:
            windows.pop()
    return (windows, []) if sum(n for *_, n in windows[-1]) == capacity else (windows[:-1], windows[-1])


class WordEncoder:
    """Little-endian 32-bit ids of texts, by a tokenizer that never joins what white space separates.

    Words are encoded once and remembered, up to a bound; ids of a text are those of its words, in order. New words are
    encoded as one text with a mark between each two, which costs far less than a call for each."""

    MARK = "\x01"
    #: Letters with ASCII marks around them, which the tokenizer takes apart; an apostrophe may begin a piece of its own.
    PARTS = re.compile(r"([!-&(-/:-@\[-`{-~]*)([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.parts = Tokenizer.from_file(path), {"": b""}, {"": b""}
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, words: list[str]) -> None:
        """A word of letters and marks around them is its parts. Letters are one piece and end at the first id that ends
        a piece; other words get marks between them."""
        known, parts = self.known, self.parts
        if len(parts) > _CACHED_PARTS:
            self.parts = parts = dict(islice(parts.items(), _CACHED_PARTS // 2))
        plain = list(filter(parts.__contains__, words))  # most words that were forgotten are one part
        known.update(zip(plain, map(parts.__getitem__, plain), strict=True))
        words = list(filterfalse(parts.__contains__, words))
        whole = [w for w in words if w.isalpha() and w.isascii()]
        lower = [w.lower() for w in whole]
        words = [w for w in words if not (w.isalpha() and w.isascii())]
        made, rest = [], []
        for w, m in zip(words, map(self.PARTS.fullmatch, words), strict=True):
            if m and "<|" not in w:
                before, core, after = m.groups()
                if core.isascii():
                    made.append((w, before, core.lower(), after))
                    continue
                if core.isalpha() and core.lower().isalpha():
                    made.append((w, before, core, after))
                    continue
            rest.append(w)
        new = {core for _, _, core, _ in made if core not in parts}.union(filterfalse(parts.__contains__, lower))
        self._split(list(new), " ", lambda ids: np.flatnonzero(self.ends[ids]), 0, parts)
        for w in new.union(x for _, before, _, after in made for x in (before, after)).difference(parts):
            parts[w] = self._one(w)
        known.update(zip(whole, map(parts.__getitem__, lower), strict=True))
        known.update((w, parts[before] + parts[core] + parts[after]) for w, before, core, after in made)
        others = [w for w in rest if self.MARK not in w] if len(self.mark) == 1 else []
        self._split(others, f" {self.MARK} ", lambda ids: np.append(np.flatnonzero(ids == self.mark[0]), len(ids)), 1, known)
        for w in rest:
            if w not in known:
                known[w] = self._one(w)

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _split(self, words: list[str], between: str, edges, skipped: int, known: dict[str, bytes]) -> None:
        for i in range(0, len(words), 4000):
            part = words[i : i + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, "<u4")
            last = edges(ids)
            if len(last) == len(part):  # else each word is encoded by itself
                ends = (4 * (last + 1 - skipped)).tolist()
                starts, raw = [0, *(x + 4 * skipped for x in ends[:-1])], ids.tobytes()
                known.update(zip(part, (raw[x:y] for x, y in zip(starts, ends, strict=True)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > _CACHED_WORDS:  # the first words met are the frequent ones
            self.known = dict(islice(self.known.items(), _CACHED_WORDS // 3))
        if new := set(filterfalse(self.known.__contains__, chain.from_iterable(split))):
            self._learn(list(new))
        of = self.known.__getitem__
        return [b"".join(map(of, ws)) for ws in split]


def _encoder(path: str) -> WordEncoder:
    """The Python worker's own encoder: tasks that run in it one after the other share what it remembers."""
    kept = sys.modules.setdefault("_noticeloom_encoders", types.ModuleType("_noticeloom_encoders")).__dict__
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def _portions(texts: list, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


PIECE = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, windows: int = WINDOWS, max_piece: int = MAX_PIECE, end: int = END) -> DataFrame:
    """One row per piece: the document's id, the piece's start, length and ids (little-endian unsigned 32-bit), the
    document's tokens, and the piece's sequence and offset there."""
    id_kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = _encoder(tokenizer), np.array([end], "<u4").tobytes()
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        goal = capacity * windows
        held: list[list] = []  # id, start, length, ids, document's tokens
        total = 0

        def rows(by_sequence: list[list[list]]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            for pieces in by_sequence:
                offset = 0
                for key, start, n, ids, size in pieces:
                    out.append((key, start, n, ids, size, sequence, offset))
                    offset += n
                sequence += 1
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, t) for c, (_, t) in zip(cols[1:], PIECE, strict=True))], ["doc_id", *(n for n, _ in PIECE)])

        def cut(piece: list, n: int) -> tuple[list, list]:
            key, start, size, ids, whole = piece
            return [key, start, n, ids[: 4 * n], whole], [key, start + n, size - n, ids[4 * n :], whole]

        def split_at(n: int) -> list[list]:
            """Takes pieces of ``n`` tokens in all from the held ones."""
            nonlocal held, total
            took, got = [], 0
            at = 0
            while got < n:
                piece = held[at]
                if got + piece[2] > n:
                    first, held[at] = cut(piece, n - got)
                    took.append(first)
                    break
                took.append(piece)
                got += piece[2]
                at += 1
            held = held[at:]
            total -= n
            return took

        def packed(pieces: list[list], k: int) -> pa.RecordBatch:
            nonlocal held, total
            part = lambda i, at, n: [pieces[i][0], pieces[i][1] + at, n, pieces[i][3][4 * at : 4 * (at + n)], pieces[i][4]]
            found, left = pack([p[2] for p in pieces], k, capacity)
            held = [part(*x) for x in left] + held
            total += sum(n for *_, n in left)
            return rows([[part(*x) for x in w] for w in found])

        for b in batches:
            id_type, keys, texts = b[0].type, b[0].to_pylist(), b[1].to_pylist()
            for i, j in _portions(texts):
                for key, ids in zip(keys[i:j], encoder.encode([t or "" for t in texts[i:j]]), strict=True):
                    ids += tail
                    size = len(ids) // 4
                    n = -(-size // max_piece)
                    edges = [size * x // n for x in range(n + 1)]
                    held += [[key, s, e - s, ids[4 * s : 4 * e], size] for s, e in zip(edges, edges[1:], strict=False)]
                    total += size
                    while total >= goal:
                        yield packed(split_at(goal), windows)
        if k := total // capacity:
            yield packed(split_at(k * capacity), k)
        if total:
            powers, rest = [], total
            while rest:
                powers.append(min(1 << (rest.bit_length() - 1), capacity))
                rest -= powers[-1]
            yield rows([split_at(n) for n in powers])

    schema = f"doc_id {id_kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with a checksum of their ids."""
    return piece_digests(pack_documents(read_table(spark, sf_dir, "documents"), default_tokenizer()))
