"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Each task holds one block of vectors, quantised to integers, as posting lists: a list per dimension, of the rows in the
order of their component. Twice the score of a vector x for a query q is |x|^2 + |q|^2 less the sum of (x_d - q_d)^2, so
the impact of a posting is how far its component is from the query's, and it can only lower what is still possible. A
query takes segments of one quantised impact after the other over all dimensions, the largest first: a stretch from each
end of a list. What is left is an upper bound for every vector, read or not, all in exact integers. The vectors that
stand best are scored now and then, which raises the k-th best score known. A query stops only on proof: when the vectors
whose bound reaches that score cost no more to score exactly than the next segments to read. When all segments are
processed the bounds are the scores.

The query set and the vectors meet in blocks: vectors are dealt to as many groups as their number asks for. A query
first asks its own group; the k-th best score found there is its floor in all others, where a block whose components
cannot add up to it is left at once and members below it drop out at the first proof. Per group and query k rows leave;
ranks are taken among those.
Defined results: vectors that are null, or hold a null or non-finite component, take no part; rows without an id
neither; a missing dimension counts as 0; repeated rows are candidates of their own, except those with the query's
own id; query rows that share an id ask one by one, and the k best of all their answers are the list of that id; fewer
candidates than k give fewer rows; ties go to the smaller id; a vector of length 2^25 or more after scaling stands beside
the index and is scored with unbounded integers, as everything is for a query of that length; a score beyond 64 bits is given as the nearest that fits, but ranked by what it is; an
empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import read_table, staged

K, SCALE, EVERY = 5, 256, 50
#: Vectors a block, queries that go together, levels of impact, vectors scored early after each step, postings at a time.
BLOCK, QUERIES, LEVELS, PROBE, BUFFER = 8192, 64, 32, 32, 1 << 14
#: A step takes levels until it has read this part of the postings.
STEPS = 16
#: Squared length from which a vector stands beside the index: below it all sums are exact in double precision.
WIDE, LONG = 2.0**50, 1 << 63


def _integers(x: np.ndarray) -> np.ndarray:
    """Doubles that are whole numbers, as unbounded integers."""
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def _sortable(s: int) -> bytes:
    """Bytes in the order of the integers beyond 64 bits of one sign."""
    n = (abs(s).bit_length() + 7) // 8
    raw = n.to_bytes(4, "big") + abs(s).to_bytes(n, "big")
    return raw if s > 0 else bytes(255 - c for c in raw)


class ImpactIndex:
    """Posting lists of one block of integer vectors (whole numbers as doubles); ``read`` counts the components read."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        with np.errstate(over="ignore"):
            squares = (x * x).sum(1)
        wide = squares >= WIDE
        self.wide_ids, self.wide = ids[wide], _integers(x[wide])
        self.ids, self.x, self.squares = ids[~wide], np.ascontiguousarray(x[~wide]), squares[~wide]
        rows = np.argsort(self.x, axis=0, kind="stable")
        #: By dimension: components as they grow, and the rows that hold them.
        self.values = np.ascontiguousarray(np.take_along_axis(self.x, rows, 0).T.astype(np.int32))
        self.rows = np.ascontiguousarray(rows.T.astype(np.uint16 if len(self.ids) <= 1 << 16 else np.uint32))
        self.largest = np.abs(self.x).max(0, initial=0)
        self.read, self._off, self._row = 0, np.empty(BUFFER, np.int32), np.empty(BUFFER, self.rows.dtype)

    def top(self, q: np.ndarray, own: list[int], k: int, floor: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each row of ``q`` the (id, score) of the k best but its own, maybe without those below its floor."""
        with np.errstate(over="ignore"):
            fits = (q * q).sum(1) < WIDE
        found = []
        for i, o in enumerate(own):
            if not fits[i]:
                best = self._every(self.ids, _integers(self.x), q[i], o)
            else:
                best = self._search(q[i], o, k, floor[i]) if len(self.ids) else []
            if len(self.wide_ids):
                best = best + self._every(self.wide_ids, self.wide, q[i], o)
            found.append(sorted(best, key=lambda f: (-f[1], f[0]))[:k])
        return found

    @staticmethod
    def _every(ids: np.ndarray, x: np.ndarray, q: np.ndarray, own: int) -> list[tuple[int, int]]:
        return [(i, s) for i, s in zip(ids.tolist(), x @ _integers(q) if len(ids) else [], strict=True) if i != own]

    def _segments(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By level of impact, the largest first: where the unread part of each list begins and ends after it."""
        n = self.values.shape[1]
        widest = np.maximum(np.abs(self.values[:, 0] - q), np.abs(self.values[:, -1] - q)).max(initial=0)
        cuts = np.ceil(widest * np.arange(LEVELS - 1, -1, -1) / LEVELS)
        low, high = (q[:, None] - cuts).astype(np.int32), (q[:, None] + cuts).astype(np.int32)
        below = [v.searchsorted(c, "left") for v, c in zip(self.values, low, strict=True)]
        above = [v.searchsorted(c, "right") for v, c in zip(self.values, high, strict=True)]
        return np.vstack([np.zeros(len(q), np.int64), np.array(below).T]), np.vstack([np.full(len(q), n), np.array(above).T])

    def _lower(self, upper: np.ndarray, q: list[float], level: list[list[int]]) -> None:
        """Take what the postings of a level say off the bounds, a buffer of them at a time."""
        at, off, row = 0, self._off, self._row
        for values, rows, c, *ends in zip(self.values, self.rows, q, *level, strict=True):
            for a, b in ((ends[0], ends[1]), (ends[2], ends[3])):
                while a < b:
                    take = b - a if b - a < BUFFER - at else BUFFER - at
                    np.subtract(values[a : a + take], c, off[at : at + take])
                    row[at : at + take] = rows[a : a + take]
                    a, at = a + take, at + take
                    if at == BUFFER:
                        at = self._flush(upper, at)
        self._flush(upper, at)

    def _flush(self, upper: np.ndarray, at: int) -> int:
        off = self._off[:at].astype(float)
        off *= off
        upper -= np.bincount(self._row[:at], off, len(upper))
        self.read += at
        return 0

    def _search(self, q: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        if not len(q):
            return [(i, 0) for i in self.ids.tolist() if i != own]
        if np.abs(q) @ self.largest < floor:
            return []
        n, wide = self.x.shape
        upper = self.squares + q @ q  # twice what each vector's score may still be
        upper[slice(*np.searchsorted(self.ids, [own, own + 1]))] = -np.inf
        start, end = self._segments(q)
        size = np.concatenate([[0], (start + n - end).sum(1)[1:]])  # postings read after each level
        whole, done, parts = q.astype(np.int32).tolist(), 0, n * wide // STEPS
        while done < LEVELS:
            level = min(LEVELS, max(done + 1, int(np.searchsorted(size, size[done] + parts))))
            if np.count_nonzero((upper >= 2 * floor) & (upper > -np.inf)) * wide <= size[level] - size[done]:
                break
            self._lower(upper, whole, [start[done].tolist(), start[level].tolist(), end[level].tolist(), end[done].tolist()])
            done = level
            best = np.argpartition(upper, n - PROBE)[n - PROBE :] if n > PROBE else np.arange(n)
            score = self._scores(best[upper[best] > -np.inf], q)
            if len(score) >= k:
                floor = max(floor, np.partition(score, len(score) - k)[len(score) - k])
        rows = np.flatnonzero((upper >= 2 * floor) & (upper > -np.inf))
        score = self._scores(rows, q)
        if len(score) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[keep], score[keep]
        return list(zip(self.ids[rows].tolist(), score.astype(np.int64).tolist(), strict=True))

    def _scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.read += len(rows) * len(q)
        return self.x[rows] @ q


def quantised(rows: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): floor(scale * component) of the vectors that take part, as doubles (which are whole beyond 2^53)."""
    x = F.transform(F.col(vector_col), lambda c: F.col("k") * c.cast("double"))
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("x", lambda c: F.when(F.abs(c) < float(1 << 53), F.floor(c).cast("double")).otherwise(c))
    df = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias(vector_col), F.lit(float(scale)).alias("k"))
    return df.select("id", x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & good).select("id", whole.alias("x"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` (id, x) against ``vectors`` (id, x)."""
    vectors = staged(vectors)
    groups = max(1, -(-vectors.count() // block))
    own = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    put = vectors.select(own.alias("group"), F.lit(False).alias("query"), "id", "x", F.lit(None).cast("double").alias("floor"))

    def matrix(rows: list[list[float]], wide: int) -> np.ndarray:
        out = np.zeros((len(rows), wide))
        for i, r in enumerate(rows):
            out[i, : len(r)] = r[:wide]
        return out

    def answers(index: ImpactIndex, asked: list[tuple]) -> pa.RecordBatch:
        found = index.top(matrix([x for _, x, _ in asked], index.x.shape[1]), [i for i, *_ in asked], k, np.array([-np.inf if f is None else f for *_, f in asked]))
        out = [(i, v, s) for (i, *_), best in zip(asked, found, strict=True) for v, s in best]
        keys, ids, scores = zip(*out, strict=True) if out else ((), (), ())
        held = [max(-LONG, min(LONG - 1, s)) for s in scores]
        value = [float(s) if abs(s) < 1 << 1023 else float("inf") * (1 if s > 0 else -1) for s in scores]
        beyond = [None if s == h else _sortable(s) for s, h in zip(scores, held, strict=True)]
        cols = zip((keys, ids, held, value, beyond), (*[pa.int64()] * 3, pa.float64(), pa.binary()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["query_id", "vec_id", "score", "value", "beyond"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, index, ids, xs, asked = None, None, [], [], []
        for b in batches:
            for g, query, key, x, floor in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != group:
                    if asked:
                        yield answers(index, asked)
                    group, index, ids, xs, asked = g, None, [], [], []
                if not query:
                    ids.append(key)
                    xs.append(x)
                    continue
                if index is None and ids:
                    index, xs = ImpactIndex(np.array(ids, np.int64), matrix(xs, max(map(len, xs)))), []
                if index is not None:
                    asked.append((key, x, floor))
                    if len(asked) == QUERIES:
                        yield answers(index, asked)
                        asked = []
        if asked:
            yield answers(index, asked)

    def met(ask: DataFrame) -> DataFrame:
        rows = put.unionByName(ask.select("group", F.lit(True).alias("query"), "id", "x", "floor"))
        return rows.repartition("group").sortWithinPartitions("group", "query", "id").mapInArrow(run, "query_id long, vec_id long, score long, value double, beyond binary")

    best = met(queries.select(own.alias("group"), "id", "x", F.lit(None).cast("double").alias("floor")))
    if groups > 1:
        best = staged(best)
        floors = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("value") - F.abs(F.min("value")) * 2.0**-50).alias("floor"))
        asks = queries.join(floors, F.col("id") == F.col("query_id"), "left")
        others = F.filter(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g != F.col("own"))
        best = best.unionByName(met(asks.withColumn("own", own).select(F.explode(others).alias("group"), "id", "x", "floor")))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for each whose id is divisible by 50."""
    x = quantised(read_table(spark, sf_dir, "embeddings"))
    return top_k(x, x.where(F.col("id") % EVERY == 0))


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
