"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target ``t`` and size ``s`` stands for ``t / s`` copies: whole ones and a fractional
probability. Pivotal steps pair two fractional probabilities and move words at random from one to the other until one
is 0 or 1, which keeps every probability in expectation and the words in sum exact. Documents are dealt by (source, size band, part), so a source with a third of all
rows is many small buckets; each bucket leaves at most one fractional document, and the residuals of ``FAN`` parts,
then of the bands of a source, are combined the same way level by level: a reduction tree. A source's last
residual is rounded to the nearer side. Documents of more than one part in ``LARGE`` of their source, so fewer than
that, are decided first, and the words they take too many or too few are shared by the rest of the source, so the
words taken end within half a small document of the target wherever the rest can make up for it. All choices hash a seed with the ids of the pair, so reruns agree wherever the buckets run.

Targets are water filling: ``least(2 * size, level * weight)``, the level such that the targets add up. It is worked
out over one row per source. Defined results: a null text has size 0; documents of size 0 take 0; a null source is a
source of its own, last in order; repeated rows and null ids are documents of their own (equal rows are
interchangeable); when every size is 0 all targets are 0; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import keyed_runs, read_table, staged

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Documents a bucket, buckets that meet at a node of the tree, and the part of its source (one in so many) above which a document is large.
BUCKET, FAN, LARGE = 20_000, 64, 200


def sized(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source"), text_col: str = "text") -> DataFrame:
    """``keep`` and size: the number of words in the text."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(t.split()) if t else 0 for t in b["__text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(n, pa.int64())], [*keep, "size"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, f"{kinds}, size long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target): one row per source.

    Sources by code point take ``weights`` in turn. With sources by rising ``most * size / weight``, the first that
    the level reached by all later ones does not saturate fixes the level."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (n % len(weights) + 1).cast("int")))
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(whole) * share)
    per = per.withColumn("left", F.col("total") - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0)))
    per = per.withColumn("level", F.col("left") / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    free = F.col("level") * F.col("weight") <= most * F.col("source_size")
    per = per.withColumn("level", F.min(F.when(free & (F.col("source_size") > 0), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(whole)["level"])
    return per.select("source", "source_size", "n_docs", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(most * F.col("source_size"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))).alias("target"))


def _uniform(seed: int, *keys) -> float:
    return xxhash.xxh3_64_intdigest(repr((seed, *keys)).encode()) / 2**64


def pivotal(rows: Iterator[tuple], seed: int) -> Iterator[tuple]:
    """``rows``: (key, size, p), 0 < p < 1. Gives (key, 0.0 or 1.0) as they are decided, at most one residual (key, p) last.

    A step moves words between the two, one's gain being the other's loss, until a probability is 0 or 1; the two
    directions are drawn such that both probabilities keep their expectation."""
    held = None
    for b, t, q in rows:
        if held is None:
            held = (b, t, q)
            continue
        a, s, p = held
        up, down = min(1 - p, q * t / s), min(p, (1 - q) * t / s)
        x = up if _uniform(seed, a, b) * (up + down) < down else -down
        p, q = p + x, q - x * s / t
        held = None
        for key, size, new in ((a, s, p), (b, t, q)):
            if 1e-9 < new < 1 - 1e-9:
                held = (key, size, new)
            else:
                yield key, float(round(new))
    if held is not None:
        yield held[0], held[2]


def _reduce(df: DataFrame, keys: list[str], order: list[str], seed: int) -> DataFrame:
    """Rows (source, band, part, at, doc_id, size, taken_copies) with the fractions of each bucket rounded but one.

    A bucket is a run of equal ``keys`` in a partition sorted by them: one bucket in memory at a time."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal types
            for b in batches:
                types = b.schema
                yield b

        for _, c in keyed_runs(typed(), len(keys)):
            copies = list(c["taken_copies"])
            fractions = ((i, x - int(x)) for i, x in enumerate(copies) if x != int(x))
            keyed = (((i, c["doc_id"][i]), c["size"][i], p) for i, p in fractions)
            for key, p in pivotal(keyed, seed):
                copies[key[0]] = int(copies[key[0]]) + p
            c["taken_copies"] = copies
            yield pa.RecordBatch.from_arrays([pa.array(c[f.name], f.type) for f in types], schema=types)

    sort = [*(F.col(x).asc_nulls_last() for x in keys), F.col("size").desc(), *(F.col(x).asc_nulls_last() for x in order)]
    lead = [*keys, *(n for n in names if n not in keys)]
    return df.select(*lead).repartition(*keys).sortWithinPartitions(*sort).mapInArrow(run, df.select(*lead).schema).select(*names)


def mix(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17) -> DataFrame:
    """Per row of ``sizes`` (doc_id, source, size): its source's size and target and the whole copies that it gets."""
    sizes = staged(sizes)
    targets = staged(source_targets(sizes, weights, share, most))
    same = lambda x, y: x["source"].eqNullSafe(y["source"])
    fraction = lambda c: F.when(F.abs(c - F.round(c)) < 1e-12, F.round(c)).otherwise(c)
    # the few large documents of a source come first; what they take too much or too little is left to the others
    x = sizes.join(targets, same(sizes, targets), "left").select(sizes["*"], targets["target"], targets["source_size"])
    large = F.col("size") * LARGE > F.col("source_size")
    first = x.where(large).select("source", F.lit(-2).alias("band"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("at"), "doc_id", "size", fraction(F.col("target") / F.col("source_size")).alias("taken_copies"))
    first = staged(_reduce(first, ["source"], ["doc_id"], seed).withColumn("taken_copies", F.round("taken_copies")))
    took = first.groupBy("source").agg(F.sum(F.col("size") * F.col("taken_copies")).alias("words"), F.sum("size").alias("of"))
    targets_left = targets.join(took, same(targets, took), "left").select(targets["source"], ((targets["target"] - F.coalesce(took["words"], F.lit(0.0))) / F.nullif(targets["source_size"] - F.coalesce(took["of"], F.lit(0)), F.lit(0))).alias("copies"))
    targets_left = staged(targets_left.withColumn("copies", F.greatest(F.lit(0.0), F.least(F.lit(most), F.coalesce("copies", F.lit(0.0))))))
    large_row, sizes = first, x.where(~large).select("doc_id", "source", "size")
    spread = F.when(F.col("size") > 0, F.floor(4 * F.log2("size"))).otherwise(-1).cast("int")
    counts = sizes.groupBy("source", spread.alias("band")).agg(F.count("*").alias("n"))
    parts = counts.select("source", "band", F.ceil(F.col("n") / BUCKET).alias("parts"))
    banded = sizes.withColumn("band", spread)
    # one row per source, or per source and band: adaptive execution broadcasts them while they are small
    x = banded.join(parts, same(banded, parts) & (banded["band"] == parts["band"]), "left").select(banded["*"], parts["parts"])
    x = x.join(targets_left, same(x, targets_left), "left").select(x["*"], targets_left["copies"])
    copies = F.when(F.col("size") > 0, F.col("copies")).otherwise(0.0)
    x = x.select(
        "source", "band", F.pmod(F.xxhash64("doc_id", "size"), F.col("parts")).alias("part"), F.lit(0).cast("long").alias("at"), "doc_id", "size",
        fraction(copies).alias("taken_copies"),
    )
    keys = ["source", "band", "part"]
    done = staged(_reduce(x, keys, ["doc_id"], seed))
    open_ = F.col("taken_copies") != F.floor("taken_copies")
    rest = done.where(open_)
    most_parts = (parts.agg(F.max("parts")).first()[0] or 1)
    up = rest.select("source", "band", "part", F.col("part").alias("at"), "doc_id", "size", "taken_copies")
    settled = None
    level = 1
    while True:
        # parts of a band by FAN, then the bands of a source together
        last = most_parts <= 1
        up = up.withColumn("at", F.floor(F.col("at") / FAN)) if not last else up
        decided = staged(_reduce(up, ["source"] if last else ["source", "band", "at"], ["band", "part", "doc_id"], seed + level))
        closed = decided.where(~open_)
        settled = closed if settled is None else settled.unionByName(closed)
        up = decided.where(open_)
        if last:
            break
        most_parts, level = -(-most_parts // FAN), level + 1
    final = up.withColumn("taken_copies", F.round("taken_copies"))
    settled = settled.unionByName(final).select(F.col("source").alias("s"), F.col("band").alias("b"), F.col("part").alias("p"), F.col("taken_copies").alias("settled"))
    # a bucket has one residual row at most, so its key finds it
    x = done.join(settled, open_ & done["source"].eqNullSafe(settled["s"]) & (done["band"] == settled["b"]) & (done["part"] == settled["p"]), "left")
    x = x.select("doc_id", "source", "size", F.coalesce("settled", "taken_copies").cast("long").alias("copies"))
    x = x.unionByName(large_row.select("doc_id", "source", "size", F.col("taken_copies").cast("long").alias("copies")))
    return x.join(targets, same(x, targets), "left").select(x["*"], targets["source_size"], targets["target"])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    x = mix(sized(read_table(spark, sf_dir, "documents")))
    return x.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
