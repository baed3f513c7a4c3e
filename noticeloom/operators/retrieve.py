"""Answers and notice ranking from a search over notice chunks (``search_index``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeloom import lexicon as lex
from noticeloom.functions import text as tx
from noticeloom.operators import tables
from noticeloom.operators.search_index import Index, build_index, query_grams, search


__all__ = ["Index", "answer", "build_context", "build_index", "extract_answer", "query_grams", "search", "search_notices"]


def extract_answer(hits: DataFrame, chunks: DataFrame, index: Index, queries: DataFrame, k: int = 5, least: float = 0.5) -> DataFrame:
    """(query_id, rank, line, source_rank, score): the lines of the hits that share most with the question."""
    rows = hits.join(chunks.select("project_no", "seq", "text"), ["project_no", "seq"])
    line = rows.select("query_id", F.col("rank").alias("source_rank"), F.posexplode(F.transform(tx.raw_lines(F.col("text")), tx.strip)).alias("at", "line"))
    line = line.withColumn("key", tx.squash(F.col("line"))).where(F.length("key") >= 6)
    one = Window.partitionBy("query_id", "key").orderBy("source_rank", "at")
    line = line.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n")
    grams = line.select("query_id", "key", F.explode(F.array_distinct(tx.bigrams(F.col("line")))).alias("gram"))
    shared = grams.join(query_grams(queries).drop("project_no"), ["query_id", "gram"]).join(index.idf, "gram").groupBy("query_id", "key").agg(F.sum("idf").alias("s"))
    x = line.join(shared, ["query_id", "key"], "left").withColumn("score", F.round(F.coalesce("s", F.lit(0.0)) + 0.3 / F.col("source_rank"), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_rank", "at")
    return x.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("score") > least)).select("query_id", "rank", "line", "source_rank", "score")


def answer(queries: DataFrame, index: Index, chunks: DataFrame, notices: DataFrame) -> DataFrame:
    """One row per query: mode, masked question, fact line, two amount evidences and the extracted lines."""
    masked = queries.withColumn("question", tx.mask(F.col("question")))
    hits = search(index, masked)
    top = tables.top_notice(hits).join(notices, "project_no", "left")
    fact = F.concat(
        F.lit("📌 "), tx.text(F.col("title")), F.lit(" — 접수 "), tx.text(F.col("receipt_start")), F.lit(" ~ "), tx.text(F.col("receipt_end")), F.lit(" ("), tx.text(F.col("status")), F.lit(") · 지원 "),
        tx.amount_text(F.col("amount")), F.lit(" · 신청 "), tx.text(F.array_join("apply.methods", ", ")), F.lit(" "), tx.text(F.array_join("apply.emails", ", ")),
    )
    facts = top.select("query_id", F.rtrim(fact).alias("fact"), F.slice(F.coalesce("amount.evidence", F.array().cast("array<string>")), 1, 2).alias("evidence"))
    said = extract_answer(hits, chunks, index, masked).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line", "source_rank"))).alias("said"))
    said = said.select("query_id", F.transform("said", lambda x: F.concat(F.lit("- "), x["line"], F.lit(" [근거 "), x["source_rank"], F.lit("]"))).alias("lines"))
    x = masked.select("query_id", F.col("question").alias("masked_question")).join(facts, "query_id", "left").join(said, "query_id", "left")
    return x.withColumn("mode", F.when(F.col("fact").isNull(), "none").otherwise("extract"))


def search_notices(queries: DataFrame, index: Index, chunks: DataFrame, notices: DataFrame, fits: DataFrame | None = None, k: int = 10, depth: int = 60) -> DataFrame:
    """(query_id, project_no, score, evidence, rank): open representatives by the sum of their hits and by what title
    and summary share with the question. ``fits``: (project_no, score, eligible) of one profile."""
    masked = queries.withColumn("question", tx.mask(F.col("question")))
    open_ = tables.representatives(tables.filter_status(notices, lex.OPEN))
    hits = tables.resolve_hits(search(index, masked.withColumn("project_no", F.lit(None).cast("string")), depth), notices).join(chunks.select("project_no", "seq", "text"), ["project_no", "seq"])
    hits = hits.join(open_.select(F.col("project_no").alias("notice_no")), "notice_no", "left_semi").withColumn("key", F.substring(tx.squash(F.col("text")), 1, 80))
    sums = hits.groupBy("query_id", "notice_no").agg(F.sum("score").alias("hit"))
    once = Window.partitionBy("query_id", "notice_no", "key").orderBy("rank")
    evidence = hits.withColumn("__n", F.row_number().over(once)).where("__n = 1")
    evidence = evidence.groupBy("query_id", "notice_no").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("e"))
    evidence = evidence.select("query_id", "notice_no", F.transform(F.slice("e", 1, 3), lambda x: x["text"]).alias("evidence"))
    named = open_.select(F.col("project_no").alias("notice_no"), F.explode(F.array_distinct(tx.bigrams(F.concat(tx.text(F.col("title")), F.lit(" "), tx.text(F.col("summary")))))).alias("gram"))
    bonus = named.join(query_grams(masked).drop("project_no"), "gram").join(index.idf, "gram", "left")
    bonus = bonus.groupBy("query_id", "notice_no").agg((1.5 * F.sum(F.coalesce(F.nullif("idf", F.lit(0.0)), F.lit(1.0)))).alias("bonus"))
    x = sums.join(bonus, ["query_id", "notice_no"], "full_outer").withColumn("score", F.coalesce("hit", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0)))
    if fits is not None:
        f = fits.select(F.col("project_no").alias("notice_no"), F.col("score").alias("fit"), "eligible")
        x = x.join(f, "notice_no", "left").withColumn("score", F.col("score") * F.when(F.col("eligible"), 0.6 + F.col("fit") / 100).when(~F.col("eligible"), 0.3).otherwise(1.0))
    x = x.withColumn("score", F.round("score", 6)).join(evidence, ["query_id", "notice_no"], "left")
    w = Window.partitionBy("query_id")
    x = x.withColumn("top", F.max("score").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "notice_no")))
    none = F.array().cast("array<string>")
    return x.where((F.col("score") >= F.col("top") * 0.15) & (F.col("rank") <= k)).select("query_id", F.col("notice_no").alias("project_no"), "score", F.coalesce("evidence", none).alias("evidence"), "rank")


def build_context(rows: DataFrame, head: str, max_chars: int = 6000) -> DataFrame:
    """(query_id, context): ranked rows (query_id, rank, fact, evidence) as one text within ``max_chars``."""
    x = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "fact", "evidence"))).alias("r"))
    per = F.greatest(F.lit(120), F.floor((max_chars - len(head) - 200) / F.greatest(F.size("r"), F.lit(1))).cast("int"))
    item = lambda r: F.concat(r["rank"], F.lit(". "), r["fact"], F.lit("\n   근거: "), F.array_join(F.transform(r["evidence"], tx.clean), " / "))
    cut = F.transform("r", lambda r: F.when(F.length(item(r)) > per, F.concat(F.substr(item(r), F.lit(1), per), F.lit("…"))).otherwise(item(r)))
    return x.select("query_id", F.substring(F.concat(F.lit(head + "\n[관련 공고]\n"), F.array_join(cut, "\n"), F.lit("\n")), 1, max_chars).alias("context"))
