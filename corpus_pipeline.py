"""The corpus pipeline: quality classifier, n-gram Jaccard join, PII, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs; all but the last return the columns of ``documents``. A row is a document: rows without a doc_id and rows
that share one are told apart by all that they hold, and only rows equal in everything are one document for the second
stage. Null texts are empty, of any length texts are read whole, an empty table passes through, and each stage drops
columns that ``documents`` lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm import jaccard_join, mixing, packing, pii, quality_pu
from noticeloom.llm.common import discard, read_table, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Words in a shingle and hundredths of similarity of the near-duplicate stage; those of the op7 query are its own.
SHINGLE, SIMILAR = 5, 80


def _sized(ids: DataFrame) -> DataFrame:
    """For a join: broadcast if it has a bounded number of (narrow) rows, else left to a shuffle."""
    ids = staged(ids)
    return F.broadcast(ids) if ids.count() <= jaccard_join.BROADCAST else ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    docs = docs.select(*COLUMNS)
    model = quality_pu.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_pu.scored(docs, model, list(COLUMNS)).where(F.col("score") >= (quality_pu.CUT if model else 0)).select(*COLUMNS)


def _row_key() -> Column:
    """A number for each row, the same wherever it is read: equal rows of an id share it, others do not."""
    return F.xxhash64("doc_id", "text", "lang", "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest id, an id before none; equal rows once.

    Rows are told apart one by one: of an id with several texts those go that stand for no group."""
    rows = docs.select(*COLUMNS, _row_key().alias("__row"))
    found = staged(jaccard_join.jaccard_components(rows, n=SHINGLE, threshold=SIMILAR, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id"))
    often = _sized(found.groupBy("__row").count().where("count > 1").select("__row"))
    ids = rows.select("__row", "doc_id").distinct()
    member = found.distinct().join(ids, "__row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))["__row"]
    chosen = _sized(member.groupBy("component_id").agg(first.alias("chosen"), F.count("*").alias("n")).where("n > 1").select("component_id", "chosen"))
    gone = _sized(found.join(chosen, "component_id").where("__row <> chosen").select("__row").distinct())
    left = rows.join(gone, "__row", "left_anti")
    one = Window.partitionBy("__row").orderBy("n_chars")
    repeated = left.join(often, "__row", "left_semi").withColumn("__n", F.row_number().over(one)).where("__n = 1")
    return left.join(often, "__row", "left_anti").select(*COLUMNS).unionByName(repeated.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii.masked(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: a row is a document of its own, whatever its id.

    The mix's draws hash a row's key, so reruns agree, but for which of several equal rows are taken."""
    rows = docs.select(*COLUMNS, _row_key().alias("__hash"))
    repeated = staged(rows.groupBy("__hash").count().where("count > 1").select("__hash", F.lit(True).alias("__again")))
    again = repeated.limit(1).count() > 0
    if again:
        rows = rows.join(_sized(repeated), "__hash", "left").withColumn("__again", F.when(F.col("__again"), F.monotonically_increasing_id()))
    else:
        rows = rows.withColumn("__again", F.lit(None).cast("long"))
    rows = rows.select(*COLUMNS, F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("n")), F.col("__hash").cast("string"), F.col("__again").cast("string")).alias("__row"))
    # equal rows get numbers, which must be the same in both places where the rows are read
    rows = staged(rows) if again else rows
    sizes = mixing.sized(rows.select(F.col("__row").alias("doc_id"), "source", "text"))
    copies = _sized(mixing.mix(sizes).where("copies > 0").select(F.col("doc_id").alias("__row"), "copies"))
    return rows.join(copies, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, each copy of a document packed for itself."""
    return packing.piece_digests(packing.pack_documents(docs, packing.default_tokenizer()))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("packing", windows),
]

#: SQL cannot express a fitted classifier, seeded rounding or a tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
            if i:  # nothing reads the stage before any more
                discard(before)
    return docs
