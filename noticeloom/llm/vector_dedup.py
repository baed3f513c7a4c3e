"""Embedding near-duplicates by product quantisation.

Vectors are scaled to length 1. Coarse centroids and, for each of ``SUBSPACES`` subspaces, the codes of the residuals
are fitted on a bounded sample (the ``SAMPLE`` vectors with the smallest hash of their id); every vector is indexed.
Equal vectors of a label are one entry with a multiplicity. A vector lives in the inverted list of its nearest
centroid, and probes every other list that can hold a partner: one nearer to that list's centroid than to its own is
at least (d2^2 - d1^2) / (2 |c1 - c2|) away, so lists beyond the linking distance are left out and no others. In a
list, asymmetric distances come from one table per query and subspace; an entry stays if that distance, less the
entry's own quantisation error, is within the linking distance. Both bounds are exact, so no link is lost by them,
and what stays is decided by the cosine in double precision.

Work is dealt by (label, list, chunk): lists are cut into chunks of ``CHUNK`` entries and a query visits each chunk
of a list that it probes, so no label, list or group of near copies lands in one task whole. Links are counted where
they are found; a block emits counts and a forest of its links, not its pairs.
Defined results: vectors that are null, zero, or hold a null or non-finite component, and those without a label, link
with nothing and are components of their own; rows with a null id too, with a null component and kept false; repeated
rows are vectors of their own that link with each other, under one id, and so are rows of one id with other vectors;
vectors of different lengths do not link; an
empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import UnionFind, components, keyed_runs, read_table, staged

THRESHOLD = 0.93
SAMPLE, SUBSPACES, CODES, CHUNK = 20_000, 8, 64, 1024
#: The index looks at cosines down to this much below the threshold, for what rounding may hide.
SLACK = 1e-6


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * x @ c.T, 1)


def kmeans(x: np.ndarray, k: int, seed: int, steps: int = 8) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(steps):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class Quantiser:
    """Coarse centroids and residual codes for unit vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 11):
        self.coarse = kmeans(sample, lists, seed)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(rest[:, p], CODES, seed + 1 + i) for i, p in enumerate(self.parts)]

    def home(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.coarse)

    def probes(self, x: np.ndarray, home: np.ndarray, reach: float) -> np.ndarray:
        """Which lists after its own may hold a vector within ``reach`` of each row (the later list's entries are
        found from the earlier list's)."""
        d2 = np.maximum(0, (x * x).sum(1)[:, None] + (self.coarse**2).sum(1) - 2 * x @ self.coarse.T)
        own = d2[np.arange(len(x)), home][:, None]
        mine, size = self.coarse[home], (self.coarse**2).sum(1)
        gaps = np.sqrt(np.maximum(0, size[home][:, None] + size - 2 * mine @ self.coarse.T))
        bound = (d2 - own) / np.maximum(2 * gaps, 1e-12)
        return (bound <= reach + 1e-9) & (np.arange(len(self.coarse))[None, :] > home[:, None])

    def encode(self, x: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes, quantisation error) of entries of one list."""
        rest = x - self.coarse[home]
        codes = np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], 1)
        back = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return codes, np.sqrt(((rest - back) ** 2).sum(1))

    def distances(self, q: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances: queries by rows, entries by columns, summed from one table per subspace."""
        rest = q - self.coarse[home]
        out = np.zeros((len(q), len(codes)))
        for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            r = rest[:, p]
            table = (r * r).sum(1)[:, None] + (b * b).sum(1) - 2 * r @ b.T
            out += table[:, codes[:, i]]
        return np.sqrt(np.maximum(0, out))


def unit_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, d, s, key) per row: of the vectors that may link the length, the components scaled by a power of two
    (in single precision if they are exact there) and the direction, as bytes; null for the others."""
    kind = rows.schema[label_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, s, keys = [], [], []
            for key, label, v in zip(b[0].to_pylist(), b[1].to_pylist(), b[2].to_pylist(), strict=True):
                x = np.array(v, float) if key is not None and label is not None and v is not None and None not in v else np.zeros(0)
                top = float(np.abs(x).max(initial=0))
                if not 0 < top < np.inf or not np.isfinite(x).all():
                    d.append(None), s.append(None), keys.append(None)
                    continue
                x = np.ldexp(x, 1 - np.frexp(top)[1])  # so that squares neither vanish nor overflow
                d.append(len(x))
                keys.append((x / np.sqrt((x * x).sum()) + 0.0).tobytes())
                s.append((single if (single := x.astype(np.float32)).astype(float).tobytes() == x.tobytes() else x).tobytes())
            yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(d, pa.int32()), pa.array(s, pa.binary()), pa.array(keys, pa.binary())], ["id", "label", "d", "s", "key"])

    df = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x"))
    return df.mapInArrow(run, f"id long, label {kind}, d int, s binary, key binary")


def _matrix(rows: list[bytes], d: int) -> np.ndarray:
    size = sum(map(len, rows))
    if size in (4 * d * len(rows), 8 * d * len(rows)) and len({len(r) for r in rows}) == 1:
        return np.frombuffer(b"".join(rows), np.float32 if size == 4 * d * len(rows) else float).reshape(len(rows), d).astype(float)
    return np.array([np.frombuffer(r, np.float32 if len(r) == 4 * d else float) for r in rows], float).reshape(len(rows), d)


def near_links(entries: DataFrame, model: Quantiser, d: int, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, n_a): entry a linked with so many vectors in a block; (a, b) rows with n_a 0 form a forest of the links.

    ``entries``: (rep, label, n, s) with n the multiplicity, all of length ``d``."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * (threshold - SLACK))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = _matrix(b["s"].to_pylist(), d)
            u = s / np.sqrt((s * s).sum(1))[:, None]
            home = model.home(u)
            more, lists = np.nonzero(model.probes(u, home, reach))
            probes = np.split(lists.astype(np.int32), np.cumsum(np.bincount(more, minlength=len(u)))[:-1])
            yield pa.RecordBatch.from_arrays([b["rep"], b["label"], b["n"], pa.array(home, pa.int32()), pa.array(probes, pa.list_(pa.int32())), b["s"]], ["rep", "label", "n", "home", "probes", "v"])

    kind = entries.schema["label"].dataType.simpleString()
    placed = staged(entries.select("rep", "label", "n", "s").mapInArrow(place, f"rep long, label {kind}, n long, home int, probes array<int>, v binary"))
    chunks = placed.groupBy("label", "home").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).select("label", F.col("home").alias("list"), "chunks")
    chunk = F.pmod(F.xxhash64("rep"), F.col("chunks"))
    data = placed.withColumn("list", F.col("home")).join(chunks, ["label", "list"]).select("label", "list", chunk.alias("chunk"), F.lit(0).alias("query"), "rep", "n", "v")
    # its own list: the later chunks, and its own chunk; another list: every chunk
    asks = placed.withColumn("list", F.explode(F.concat(F.array("home"), "probes"))).join(chunks, ["label", "list"])
    to = F.explode(F.sequence(F.when(F.col("list") == F.col("home"), chunk + 1).otherwise(F.lit(0)).cast("long"), F.col("chunks").cast("long"))).alias("chunk")
    asks = asks.select("label", "list", to, F.col("chunks").alias("c"), F.lit(1).alias("query"), "rep", "n", "v").where("chunk < c").drop("c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, home, _), c in keyed_runs(batches, 3):
            n_data = c["query"].count(0)
            reps, n = c["rep"], np.array(c["n"])
            s = _matrix(c["v"], d)
            norm = np.sqrt((s * s).sum(1))
            u = s / norm[:, None]
            codes, error = model.encode(u[:n_data], home)
            total, forest, edges = np.zeros(len(reps), np.int64), UnionFind(len(reps)), []

            def link(rows: np.ndarray, first: bool) -> None:
                near = model.distances(u[rows], home, codes) - error <= reach + 1e-9
                i, j = np.nonzero(near)
                i = rows[i]
                if first:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    return
                cosine = np.einsum("ij,ij->i", s[i], s[j]) / (norm[i] * norm[j])
                i, j = i[cosine >= threshold], j[cosine >= threshold]
                np.add.at(total, i, n[j])
                np.add.at(total, j, n[i])
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if forest.join(x, y):
                        edges.append((reps[x], reps[y], 0))

            for at in range(0, len(reps), 256):
                rows = np.arange(at, min(at + 256, len(reps)))
                for part, first in ((rows[rows < n_data], True), (rows[rows >= n_data], False)):
                    if len(part) and n_data:
                        link(part, first)
            out = edges + [(reps[i], reps[i], int(total[i])) for i in np.flatnonzero(total).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b", "n_a"])

    keys = ["label", "list", "chunk"]
    work = data.unionByName(asks).repartition(*keys).sortWithinPartitions(*keys, "query", "rep")
    return work.select(*keys, "query", "rep", "n", "v").mapInArrow(run, "a long, b long, n_a long")


def vector_components(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    units = staged(unit_vectors(rows, id_col, vector_col, label_col))
    classes = staged(units.where("key IS NOT NULL").groupBy("label", "key").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first("d").alias("d"), F.first("s").alias("s")).withColumn("rep", F.monotonically_increasing_id()))
    found = None
    # a model for each vector length; there is one in any sane table
    for d, n in sorted((r["d"], r["n"]) for r in classes.groupBy("d").agg(F.count("*").alias("n")).collect()):
        part = classes.where(F.col("d") == d)
        sample = np.array([np.frombuffer(r[0]) for r in part.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("key").collect()])
        lists = int(min(max(4, SAMPLE // 16), max(4, 2 ** round(np.log2(n) / 2 - 4))))
        links = near_links(part.select("rep", "label", "n", "s"), Quantiser(sample, lists), d, threshold)
        found = links if found is None else found.unionByName(links)
    component, none = F.coalesce("component", "id"), F.lit(None).cast("long")
    if found is None:
        x = units.select("id", none.alias("component"), none.alias("n_links"))
    else:
        found = staged(found)
        parts = components(found.where("n_a = 0").select("a", "b"))
        counts = found.groupBy("a").agg(F.sum("n_a").alias("links"))
        named = classes.select("label", "key", "rep", "first", "n").join(parts, F.col("rep") == F.col("id"), "left").withColumn("part", F.coalesce("component", "rep")).drop("id", "component")
        least = named.groupBy("part").agg(F.min("first").alias("component"))
        named = named.join(least, "part").join(counts, F.col("rep") == F.col("a"), "left")
        x = units.join(named.select("label", "key", "component", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), ["label", "key"], "left")
    return x.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all vectors."""
    return vector_components(read_table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
  AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS m FROM v UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.id),
k AS (SELECT id, min(m) AS m FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(k.m, e.vec_id) AS component_id, e.vec_id = coalesce(k.m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN k ON k.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
