"""Exact n-gram Jaccard join by a token-group matrix.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets are one class, so copies are
never paired.

1. Partition similar documents. Shingles fall into blocks by range of hash; two sets of Jaccard ``t`` or more differ
   in at most ``d = (a + b) (1 - t) / (1 + t)`` shingles, so in at most ``d`` blocks. A set signs its ``d + 1`` fullest
   blocks, in an order that depends on a block's content alone: the first block in which two such sets agree is
   preceded by at most ``d`` others in either, so both sign it. The number of blocks is fixed per class of sizes, and a
   set that may have a partner in the class below signs for that one too. A set with too few filled blocks signs all it
   has and goes on with another hash function. Full blocks are seldom made of one frequent passage only, so those make
   few signatures frequent. Sets that share signatures, directly or by others, are a unit.
2. Token-group matrix. Units meet in blocks of work of about ``UNIT`` tokens. There the sets of a unit are cut into
   groups of up to ``GROUP``, neighbours by size and smallest hash, and the matrix holds which groups' unions hold
   which token. A query set reads its overlap with every group of the block; only groups that hold enough of its tokens
   for their sizes are opened, and their members counted exactly, unless all are already connected with it.
3. Components of the exact links.

Units of more than ``UNIT`` tokens are dealt as pairs of chunks: by size bands, as only neighbouring bands can link,
and salted within a band, so no unit lands in one task whole. Nothing is dropped or capped. What meets in a task before
the shuffle by signature is linked there and sends one row a signature.

Defined results: a null or wordless text has an empty set and links with nothing; a text with fewer words than a
shingle is one token; rows with a null id take no part and get no component; repeated rows are rows of one document,
rows of one id with other texts are sets of their own under that id; an empty table gives no rows; other columns are
ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import UnionFind, components, discard, keyed_runs, read_table, release, staged

N, THRESHOLD = 3, 90
#: Tokens in a block of work, sets in a group of the matrix, ids that may be broadcast (8 bytes each).
UNIT, SETS, GROUP, BROADCAST = 1_000_000, 4096, 8, 500_000
#: Signatures of a task that are thinned at once.
SIGNATURES = 1 << 20
_CACHED_WORDS = 200_000
_SEEDS = 8
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; word hashes are remembered up to a bound."""

    def __init__(self, n: int = N):
        self.n, self.known = n, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: A-Z only, and exactly the ASCII white space
        known = self.known
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > _CACHED_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([known[w] for w in words], np.uint64)
        if not len(h):
            return h
        width = min(self.n, len(h))
        x = np.full(len(h) - width + 1, np.uint64(width)) * _M1
        for i in range(width):
            x = mix(x + h[i : len(h) - width + 1 + i] + _M1)
        return np.unique(x)


class Signer:
    """Signatures of sets such that any two of the threshold's similarity share one."""

    def __init__(self, threshold: int = THRESHOLD):
        self.t, self.cuts = threshold, {}
        self.edges = [1 << i for i in range(48)]  # classes of sizes; a partner is at most a class away, as 2 t > 1

    def differ(self, a: int, b: int) -> int:
        """Shingles that only one of two similar sets of these sizes holds, at most."""
        return (a + b) * (100 - self.t) // (100 + self.t)

    def starts(self, scheme: int) -> np.ndarray:
        """Where each block of the sets in a class begins among the hashes."""
        if scheme not in self.cuts:
            top = self.edges[scheme + 1] - 1
            m = 1 + 5 * (self.differ(top, top * 100 // self.t) + 1) // 4
            self.cuts[scheme] = np.array([(i << 64) // m for i in range(m)], np.uint64)
        return self.cuts[scheme]

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        if not n:
            return np.zeros(0, np.int64)
        s, out = n.bit_length() - 1, []
        schemes = [(s, self.differ(n, n * 100 // self.t))]  # (class of the smaller set, shingles that may differ)
        if -(-n * self.t // 100) < self.edges[s]:
            schemes.append((s - 1, self.differ(n, self.edges[s] - 1)))
        for scheme, differ in schemes:
            if not differ:
                continue  # partners are equal sets, which are one class
            starts = self.starts(scheme)
            for seed in range(_SEEDS):
                x = tokens if not seed else np.sort(mix(tokens + np.uint64((seed * int(_M1)) % (1 << 64))))
                size = np.diff(np.searchsorted(x, starts), append=n)
                filled = np.flatnonzero(size)
                size = size[filled]
                sums = np.add.reduceat(mix(x ^ _M3), np.cumsum(size) - size)
                block = mix(sums + mix(filled.astype(np.uint64) + np.uint64((scheme << 48) + (seed << 40))))
                if len(block) > differ:  # the fullest come first, in the same order for any two sets
                    out.append(block[np.lexsort((block, -size))[: differ + 1]])
                    break
                out.append(block)
            else:  # each shingle alone: similar sets share one
                out.append(mix(mix(tokens + _M1) + np.uint64((scheme << 48) + (99 << 40))))
        return np.concatenate([*out, np.zeros(0, np.uint64)]).view(np.int64)


def node_of(key: bytes | None) -> int | None:
    return int.from_bytes(key[:8], "little", signed=True) if key else None


def set_key(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def document_sets(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, key, node, signatures): key identifies the set, node is a part of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sign = Shingler(n), Signer(threshold)
        for b in batches:
            sizes, keys, signatures = [], [], []
            for text in b[1].cast(pa.binary()).to_pylist():
                x = shingles(text or b"")
                sizes.append(len(x))
                keys.append(set_key(x))
                signatures.append(sign(x))
            nodes = [node_of(k) for k in keys]
            flat = pa.array(np.concatenate([*signatures, np.zeros(0, np.int64)]))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, signatures)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b[0].cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(nodes, pa.int64()), lists], ["doc_id", "n_shingles", "key", "node", "signatures"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, key binary, node long, signatures array<long>")


def tokens_of(docs: DataFrame, n: int = N) -> DataFrame:
    """(node, tokens): the set as bytes of sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for b in batches:
            x = [shingles(t or b"") for t in b[0].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(set_key(y)) for y in x], pa.int64()), pa.array([y.tobytes() for y in x], pa.binary())], ["node", "tokens"])

    return docs.select("text").mapInArrow(run, "node long, tokens binary")


class TokenGroupMatrix:
    """Groups of similar sets, each with the union of its members' tokens.

    ``near``: what is known of which sets are similar; members are grouped by it, then by size and smallest hashes."""

    def __init__(self, sets: list[np.ndarray], members: list[int], near: list[int], group: int = GROUP):
        self.sizes = np.array([len(x) for x in sets])
        self.universe, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        members = sorted(members, key=lambda i: (near[i], int(self.sizes[i]).bit_length(), *self.of(i)[:2].tolist()))
        self.groups = []
        for i in members:
            if not self.groups or len(self.groups[-1]) == group or near[self.groups[-1][0]] != near[i]:
                self.groups.append([])
            self.groups[-1].append(i)
        self.place = {i: g for g, who in enumerate(self.groups) for i in who}
        self.inside = [np.concatenate([self.of(i) for i in g]) for g in self.groups]
        self.at = [np.cumsum(self.sizes[g]) - self.sizes[g] for g in self.groups]
        unions = [np.unique(x) for x in self.inside]
        self.rows, self.row_at = np.concatenate(unions), np.cumsum([0, *map(len, unions)])[:-1]
        group_of = np.repeat(np.arange(len(unions)), [len(u) for u in unions])
        by = np.argsort(self.rows, kind="stable")
        self.holders = group_of[by]  # groups by token
        self.holders_at = np.searchsorted(self.rows[by], np.arange(len(self.universe) + 1))
        self.least, self.most = np.array([self.sizes[g].min() for g in self.groups]), np.array([self.sizes[g].max() for g in self.groups])
        self.mask = np.zeros(len(self.universe), np.uint8)

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i + 1]]

    def bounds(self, q: int) -> np.ndarray:
        """Tokens of the query that each group's union holds. ``mask`` must be set."""
        tokens = self.of(q)
        n = self.holders_at[tokens + 1] - self.holders_at[tokens]
        total = int(n.sum())
        if 4 * total < len(self.rows):  # by token, else by group
            at = np.repeat(self.holders_at[tokens] - (np.cumsum(n) - n), n) + np.arange(total)
            return np.bincount(self.holders[at], minlength=len(self.groups))
        return np.add.reduceat(self.mask[self.rows], self.row_at, dtype=np.int64)

    def qualifying(self, q: int, threshold: int, own: bool = True) -> np.ndarray:
        """Groups that may hold a set similar to ``q``; not those before its own unless ``own`` is false."""
        a, t = int(self.sizes[q]), threshold
        ok = ((100 + t) * self.bounds(q) * 100 >= t * (100 * a + np.maximum(100 * self.least, t * a))) & (100 * self.most >= t * a) & (100 * a >= t * self.least)
        return (found := np.flatnonzero(ok))[found >= self.place[q]] if own else np.flatnonzero(ok)

    def shared(self, g: int) -> np.ndarray:
        """Tokens of the query that each member of a group holds."""
        return np.add.reduceat(self.mask[self.inside[g]], self.at[g], dtype=np.int64)


def links_in(ids: list[int], sets: list[np.ndarray], side: list[int], threshold: int = THRESHOLD, near: list[int] | None = None, opened: list[int] | None = None) -> list[tuple[int, int]]:
    """Exact links that connect the sets of one block of work (a spanning forest of them).

    ``side``: 0 or 1; sets of side 0 are compared with each other and with those of side 1, unless all are on one side.
    ``opened`` gets (groups opened, groups there) added."""
    n, two = len(ids), len(set(side)) > 1
    matrix = TokenGroupMatrix(sets, [i for i in range(n) if not two or side[i] == 1], near or [0] * n)
    found, forest = [], UnionFind(n)
    for q in sorted(matrix.place, key=matrix.place.get) if not two else [i for i in range(n) if side[i] == 0]:
        matrix.mask[matrix.of(q)] = 1
        root, a = forest.find(q), len(sets[q])
        for g in matrix.qualifying(q, threshold, not two).tolist():
            who = matrix.groups[g]
            if all(forest.find(i) == root for i in who):
                continue
            if opened is not None:
                opened[0] += 1
            shared = matrix.shared(g)
            for j in np.flatnonzero(100 * shared >= threshold * (a + matrix.sizes[who] - shared)).tolist():
                if forest.join(q, who[j]):
                    found.append((ids[q], ids[who[j]]))
            root = forest.find(q)
        if opened is not None:
            opened[1] += len(matrix.groups)
        matrix.mask[matrix.of(q)] = 0
    return found


def similar_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): each node with the first that shares a signature; connected pairs hold all that may link.

    Nodes that meet in one task are linked there and send one row a signature, so a frequent one is few rows."""

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            x = np.unique(np.stack([np.concatenate(v) for v in zip(*held, strict=True)]), axis=1) if len(held) > 1 else np.unique(np.stack(held[0]), axis=1)
            first = np.concatenate([[True], x[0, 1:] != x[0, :-1]])
            run = np.cumsum(first) - 1
            edges = np.unique(np.stack([x[1, first][run[~first]], x[1, ~first]]), axis=1)
            # an edge becomes a signature that its two nodes share
            own = mix(mix(edges[0].view(np.uint64)) + edges[1].view(np.uint64)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0, first], own, own])), pa.array(np.concatenate([x[1, first], edges[0], edges[1]]))], ["signature", "node"])

        held, n = [], 0
        for b in batches:
            lists = b["signatures"]
            sizes = np.diff(lists.offsets.to_numpy())
            held.append((lists.flatten().to_numpy(), np.repeat(b["node"].to_numpy(), sizes)))
            n += len(held[-1][0])
            if n >= SIGNATURES:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = least = None
        for b in batches:
            if not b.num_rows:
                continue
            signature, node = (c.to_numpy() for c in b.columns)
            first = np.concatenate([[True], signature[1:] != signature[:-1]])
            start = node[np.maximum.accumulate(np.where(first, np.arange(len(node)), 0))]
            if signature[0] == last:
                start = np.where(signature == last, least, start)
            last, least = signature[-1], start[-1]
            keep = start != node
            if keep.any():
                x = np.unique(np.stack([start[keep], node[keep]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], ["a", "b"])

    rows = sets.where("node IS NOT NULL AND doc_id IS NOT NULL AND size(signatures) > 0").select("node", "signatures").mapInArrow(thinned, "signature long, node long")
    return rows.repartition("signature").sortWithinPartitions("signature", "node").mapInArrow(joined, "a long, b long").distinct()


def plan_of_work(members: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(node, unit, block, x, y, side) for ``members`` (node, n, unit): who meets whom in one task.

    Whole units of moderate size share a block. A larger one is a block of its own, cut into bands of sizes and salted
    chunks of those; each two chunks of the same or of neighbouring bands make a block."""
    totals = members.groupBy("unit").agg(F.sum("n").alias("total"), F.count("*").alias("sets")).withColumn("large", (F.col("total") > UNIT) | (F.col("sets") > SETS))
    totals = staged(totals)
    blocks = totals.where(~F.col("large")).agg(F.sum("total")).first()[0] or 0
    zero = F.lit(0).cast("long")
    shared = F.pmod(F.xxhash64("unit"), F.lit(max(1, -(-2 * blocks // UNIT))))
    one = members.join(totals.where(~F.col("large")).select("unit"), "unit").select("node", "unit", shared.alias("block"), F.lit(-1).cast("long").alias("x"), zero.alias("y"), F.lit(0).alias("side"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / threshold)) + 1e-9).cast("long")
    big = members.join(totals.where("large").select("unit"), "unit").withColumn("band", band)
    chunks = big.groupBy("unit", "band").agg(F.ceil(F.greatest(F.sum("n") * 2 / UNIT, F.count("*") * 2 / SETS)).alias("chunks"))
    next_ = chunks.select("unit", (F.col("band") - 1).alias("band"), F.col("chunks").alias("above"))
    last = chunks.select("unit", (F.col("band") + 1).alias("band"), F.col("chunks").alias("below"))
    plan = chunks.join(next_, ["unit", "band"], "left").join(last, ["unit", "band"], "left").na.fill(0, ["above", "below"])
    code = lambda b, c: b * (1 << 32) + c
    put = big.join(plan, ["unit", "band"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    mine = code(F.col("band"), F.col("chunk"))
    upto = lambda n: F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<bigint>"))
    here = F.transform(upto(F.col("chunks")), lambda c: F.struct(code(F.col("band"), F.least(c, F.col("chunk"))).alias("x"), code(F.col("band"), F.greatest(c, F.col("chunk"))).alias("y"), (c < F.col("chunk")).cast("int").alias("side")))
    up = F.transform(upto(F.col("above")), lambda c: F.struct(mine.alias("x"), code(F.col("band") + 1, c).alias("y"), F.lit(0).alias("side")))
    down = F.transform(upto(F.col("below")), lambda c: F.struct(code(F.col("band") - 1, c).alias("x"), mine.alias("y"), F.lit(1).alias("side")))
    many = put.select("node", "unit", F.explode(F.concat(here, up, down)).alias("to")).select("node", "unit", F.col("unit").alias("block"), "to.x", "to.y", "to.side")
    return one.unionByName(many)


def exact_links(work: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links that connect what is linked, from the blocks of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in keyed_runs(batches, 3):
            if len(c["node"]) > 1 and (found := links_in(c["node"], [np.frombuffer(t, np.uint64) for t in c["tokens"]], c["side"], threshold, c["unit"])):
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    keys = ["block", "x", "y"]
    return work.select(*keys, "side", "unit", "node", "tokens").repartition(*keys).sortWithinPartitions(*keys, "side", "node").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id. ``threshold``: in hundredths, 67 to 100."""
    spark = docs.sparkSession
    signed = staged(document_sets(docs, n, threshold, id_col, text_col))
    pairs = staged(similar_pairs(signed))
    release(spark)
    units = components(pairs)
    units = staged(units.select(F.col("id").alias("node"), F.col("component").alias("unit")))
    sets = staged(signed.drop("signatures"))
    discard(signed, pairs)
    classes = staged(sets.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("node", "key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")))
    members = staged(classes.join(units, "node").select("node", "rep", "n", "unit"))
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    wanted = F.broadcast(wanted) if members.count() <= BROADCAST else wanted  # ids of sets that are similar to another
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(wanted, "doc_id", "left_semi")
    tokens = tokens_of(texts, n).where("node IS NOT NULL").dropDuplicates(["node"])
    links = staged(exact_links(tokens.join(plan_of_work(members.select("node", "n", "unit").distinct(), threshold), "node"), threshold))
    release(spark)
    parts = components(links)
    least = classes.join(parts, F.col("node") == F.col("id")).select("node", "component", "rep")
    least = least.join(least.groupBy("component").agg(F.min("rep").alias("least")), "component").select("node", "least").distinct()
    named = classes.join(least, "node", "left").select("key", F.coalesce("least", "rep").alias("component"))
    out = sets.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM w
), c AS (SELECT min(doc_id) AS rep, list_sort(g) AS g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY list_sort(g), len(g)
), t AS (SELECT rep, n, unnest(g) AS g FROM c
), l AS (
  SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT rep AS id, rep AS m FROM c UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id
), k AS (SELECT id, min(m) AS m FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(k.m, s.doc_id) AS component_id
FROM s LEFT JOIN c ON list_sort(s.g) = c.g LEFT JOIN k ON k.id = c.rep
"""
