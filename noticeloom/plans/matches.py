"""Registered queries of matching with every branch of the score, digests, contexts and listings of the feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeloom import lexicon as lex
from noticeloom.operators import extract, retrieve, score
from noticeloom.plans.rules import TODAY, read
from noticeloom.sources import store
from noticeloom.streaming import feed

QUERIES, SQL = {}, {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _pick(c, *values):
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


def _companies(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    return read(spark, d, "nation").select(
        k.alias("id"), F.col("n_name").alias("name"), F.lit("전북").alias("region"), F.lit("중소기업").alias("size"), F.lit(False).alias("listed"), F.array().cast("array<string>").alias("industries"),
        _pick(k, "베트남", "미국", "", "중국").alias("target_countries"), F.when(k % 5 == 0, "수출 준비 단계").otherwise("수출 초보").alias("export_stage"), (k * 4000.0).alias("export_usd"), F.lit(True).alias("direct_export"),
        (k % 2 == 0).alias("is_overseas_distributor"), F.when(k % 3 > 0, F.array(F.lit("통번역"))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )


def _offers(spark, d) -> DataFrame:
    j, texts = F.col("p_partkey"), lambda on, *v: F.when(on, F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>"))
    field = lambda name: F.struct(F.lit(name).alias("field"), F.lit(9.0).alias("score"), F.array().cast("array<string>").alias("evidence"))
    none = F.array().cast(extract.RULES)
    target = F.struct(
        texts(F.lit(False), "").alias("industries"), texts(j % 7 == 0, lex.DISTRIBUTOR).alias("company_types"), texts(F.lit(False), "").alias("regions"), none.alias("excludes"), none.alias("requires"),
        F.when(j % 5 == 0, F.array(F.struct(F.lit("미국 수출기업").alias("rule"), F.lit("").alias("evidence")))).otherwise(none).alias("prefers"), none.alias("tiers"), texts(F.lit(False), "").alias("countries"),
        texts(F.lit(True), "첫 줄").alias("text"), F.lit(None).cast("map<string,struct<from:string,evidence:string>>").alias("basis"),
    )
    amount = F.struct(F.lit(100.0).alias("max_manwon"), F.lit(None).cast("double").alias("special_max_manwon"), texts(j % 4 == 0, "베트남").alias("special_countries"), F.lit(None).cast("int").alias("rate"), texts(F.lit(True), "근거").alias("evidence"))
    return read(spark, d, "part").select(
        j.cast("string").alias("project_no"), _pick(j, "베트남 판촉전", "수출 지원", "미주 시장").alias("title"), F.lit("at").alias("source"), F.lit(lex.OPEN).alias("status"), F.date_add(F.to_date(F.lit(TODAY)), (j % 20).cast("int")).cast("string").alias("receipt_end"),
        F.lit(TODAY).alias("first_seen"), F.lit("").alias("summary"), F.lit("").alias("detail_url"), amount.cast(store.NESTED["amount"]).alias("amount"), F.when(j % 8 == 0, 1).otherwise(0).alias("early_close"),
        F.when(j % 2 == 1, F.array(field("통번역"))).otherwise(F.array(field("물류비"), field("통번역"))).alias("fields"), target.alias("target"),
        F.array(F.struct(F.lit(0).alias("seq"), F.lit("내용").alias("name"), F.when(j % 6 == 0, "소량 수출").otherwise("").alias("text"))).alias("sections"), F.lit(None).cast("string").alias("dup_of"),
    )


_SCORED = """x AS (SELECT n_nationkey AS k, p_partkey AS j, p_partkey % 20 AS d, p_partkey % 7 = 0 AND n_nationkey % 2 = 1 AS only_shops,
CASE WHEN n_nationkey % 3 = 0 THEN 20 WHEN p_partkey % 2 = 1 THEN 40 ELSE 28 END + 12 + 6
+ CASE WHEN p_partkey % 3 = 1 THEN 5 WHEN (p_partkey % 3 = 0 AND n_nationkey % 4 = 0) OR (p_partkey % 3 = 2 AND n_nationkey % 4 = 1) THEN 10 ELSE 0 END
+ CASE WHEN p_partkey % 4 = 0 AND n_nationkey % 4 = 0 THEN 5 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 AND n_nationkey % 4 = 1 THEN 5 ELSE 0 END + CASE WHEN p_partkey % 20 >= 7 THEN 10 ELSE 6 END
+ CASE WHEN n_nationkey % 5 = 0 AND p_partkey % 6 = 0 THEN 10 ELSE 7 END AS points FROM nation CROSS JOIN part),
s AS (SELECT k, j, CAST(d AS INTEGER) AS d, CAST(least(points, CASE WHEN only_shops THEN 45 ELSE 100 END) AS INTEGER) AS score, CAST(only_shops::INT + (d <= 6)::INT + (j % 8 = 0)::INT AS INTEGER) AS n_warnings FROM x)"""


@query(f"WITH {_SCORED} SELECT k AS profile_id, CAST(j AS VARCHAR) AS project_no, score, CASE WHEN score >= 80 THEN '적극 추천' WHEN score >= 60 THEN '추천' WHEN score >= 40 THEN '검토' ELSE '낮음' END AS grade, n_warnings FROM s")
def sc2_branches(spark, d):
    x = score.match(_companies(spark, d), _offers(spark, d), TODAY)
    return x.select("profile_id", "project_no", "score", "grade", F.size("warnings").alias("n_warnings"))


@query(f"WITH {_SCORED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, d, CAST(j AS VARCHAR)) AS INTEGER) AS rank FROM s) SELECT k AS profile_id, CAST(j AS VARCHAR) AS project_no, rank, score FROM r WHERE rank <= 20")
def jo1_best(spark, d):
    return score.best_matches(_companies(spark, d), _offers(spark, d), TODAY).select("profile_id", "project_no", "rank", "score")


@query(f"""WITH {_SCORED}, m AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, d, CAST(j AS VARCHAR)) AS INTEGER) AS item, count(*) OVER (PARTITION BY k) AS n FROM s
WHERE score >= CASE WHEN k % 2 = 0 THEN 70 ELSE 75 END AND (j + k) % 4 <> 0 AND (k % 6 <> 1 OR j % 3 = 2))
SELECT 'c' || k AS sub_key, CAST(j AS VARCHAR) AS project_no, item, greatest(n - 15, 0) AS n_more, k % 4 <> 0 AS first FROM m WHERE item <= 15""")
def sc6_digest(spark, d):
    k, none = F.col("id"), F.array().cast("array<string>")
    c = _companies(spark, d).withColumn("sub_key", F.concat(F.lit("c"), k)).withColumn("min_score", F.when(k % 2 == 0, 50).otherwise(75)).withColumn("sources", none).withColumn("keywords", F.when(k % 6 == 1, F.array(F.lit("미주"))).otherwise(none))
    n = _offers(spark, d)
    sent = c.crossJoin(n.select("project_no")).where((F.col("project_no").cast("long") + k) % 4 == 0).select("sub_key", "project_no")  # what has been sent is most of what there is
    return score.digest(c.drop("id"), n, sent, c.where(k % 4 == 0).select("sub_key"), TODAY).select("sub_key", "project_no", "item", "n_more", "first")


@query("""WITH r AS (SELECT o_custkey AS q, o_orderkey AS o, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
i AS (SELECT q, rank, greatest(120, (6000 - 2 - 200) // n) AS per, rank || '. F' || o || chr(10) || '   근거: ' || s || ' / ' || repeat('x', o % 300) AS item FROM r)
SELECT q AS query_id, md5(substring('머리' || chr(10) || '[관련 공고]' || chr(10) || string_agg(CASE WHEN length(item) > per THEN substring(item, 1, per) || '…' ELSE item END, chr(10) ORDER BY rank) || chr(10), 1, 6000)) AS context FROM i GROUP BY q""")
def rt5_context(spark, d):
    o = read(spark, d, "orders")
    x = o.select(F.col("o_custkey").alias("query_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"), F.concat(F.lit("F"), "o_orderkey").alias("fact"), F.array("o_orderstatus", F.repeat(F.lit("x"), (F.col("o_orderkey") % 300).cast("int"))).alias("evidence"))
    return retrieve.build_context(x, "머리").select("query_id", F.md5(F.col("context").cast("binary")).alias("context"))


@query("""WITH e AS (SELECT 's' || user_id % 5 AS source, CAST(day(ts) // 10 AS VARCHAR) AS listing, CAST(user_id AS VARCHAR) AS p FROM events), n AS (SELECT source, listing, count(DISTINCT p) AS n FROM e GROUP BY ALL),
g AS (SELECT source, listing, n >= n + CASE WHEN source = 's3' AND listing >= '2' OR source = 's4' THEN 1 ELSE 0 END AS good FROM n), l AS (SELECT source, max(listing) AS listing FROM g WHERE good GROUP BY source)
SELECT DISTINCT source, listing, p AS project_no, 'now' AS what FROM e SEMI JOIN l USING (source, listing) UNION ALL
SELECT DISTINCT source, listing, p, 'waits' FROM e WHERE source = 's4' OR (source = 's3' AND listing >= '2')""")
def ss1_listings(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("s"), F.col("user_id") % 5).alias("source"), F.floor(F.dayofmonth("ts") / 10).cast("string").alias("listing"), F.col("user_id").cast("string").alias("project_no"))
    n = e.groupBy("source", "listing").agg(F.countDistinct("project_no").alias("n"))
    cut = ((F.col("source") == "s3") & (F.col("listing") >= "2")) | (F.col("source") == "s4")
    rows = e.join(n, ["source", "listing"]).select("project_no", "source", F.lit("t").alias("title"), F.array().cast("array<string>").alias("attachment_names"), "listing", (F.col("n") + cut.cast("int")).cast("int").alias("listing_rows"))
    now, waiting = feed.complete_listings(rows)
    shown = lambda df, what: df.select("source", "listing", "project_no", F.lit(what).alias("what")).distinct()
    return shown(now, "now").unionAll(shown(waiting, "waits"))
