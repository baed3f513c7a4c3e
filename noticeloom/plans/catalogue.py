"""The registered queries of the notice library over the driver's tables, and their SQL.

documents stand for notices and their bodies, benchmark for questions, orders and parts for dated items, nations for
profiles, events for snapshots and sent state. Latin word lists go through the same rule functions as Korean ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.functions import text as tx
from noticeloom.lexicon import Lexicon
from noticeloom.operators import extract, html, link, retrieve, score, search_index, tables
from noticeloom.plans import matches, notices, rules
from noticeloom.sources import store

TODAY = "1997-06-15"
#: Support fields that companies ask for: kinds of parts.
NEEDS = ("STANDARD", "SMALL", "MEDIUM", "PROMO")
#: Latin word lists for the test tables.
LATIN = Lexicon(
    fields={"alpha": {"the": 1, "tion": 2}, "beta": {"chen": 2, "und": 1}, "gamma": {"que": 2, "eux": 3}, "delta": {"ción": 3, "los": 1}},
    industries=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), industry_rules=(("tin|brass", ("AUTOMOBILE",), True),),
    old_industry={"CARS": ("AUTOMOBILE",), "HOME": ("FURNITURE", "HOUSEHOLD")}, compat={"BUILDING": ("FURNITURE",)},
)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _documents(spark, d) -> DataFrame:
    """documents as notices: the first line is the title."""
    return _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("project_no"), "source", F.substring_index(tx.text(F.col("text")), "\n", 1).alias("title"), tx.text(F.col("text")).alias("text"))


def _orders(spark, d) -> DataFrame:
    """orders as dated notices: three weeks from the order date, open while pending or partial."""
    o = _t(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "접수중").when(F.col("o_orderstatus") == "P", "접수예정").otherwise("접수마감")
    return o.select(
        F.col("o_orderkey").cast("string").alias("project_no"), F.col("o_orderpriority").alias("source"), status.alias("status"), F.col("o_custkey").alias("customer"),
        F.to_date("o_orderdate").cast("string").alias("receipt_start"), F.date_add(F.to_date("o_orderdate"), 21).cast("string").alias("receipt_end"),
        F.when(F.col("o_orderkey") % 7 == 0, (F.col("o_orderkey") + 1).cast("string")).alias("dup_of"), F.col("o_totalprice").alias("price"),
    )


_ORDERS = """SELECT CAST(o_orderkey AS VARCHAR) AS project_no, o_orderpriority AS source,
  CASE o_orderstatus WHEN 'O' THEN '접수중' WHEN 'P' THEN '접수예정' ELSE '접수마감' END AS status, o_custkey AS customer,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS receipt_start, CAST(CAST(o_orderdate AS DATE) + 21 AS VARCHAR) AS receipt_end,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey + 1 AS VARCHAR) END AS dup_of, o_totalprice AS price FROM orders"""
_TITLE = "split_part(coalesce(text, ''), chr(10), 1)"
_GRAMS = """list_filter(flatten(list_transform(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> ''),
  lambda w: CASE WHEN length(w) = 1 THEN [w] ELSE list_transform(range(1, length(w)), lambda i: substring(w, i, 2)) END)), lambda g: g IS NOT NULL)"""
_SET = "CASE WHEN length({x}) >= {n} THEN list_distinct(list_transform(range(1, length({x}) - {n} + 2), lambda i: substring({x}, i, {n}))) ELSE [] END"


# --- retrieval -----------------------------------------------------------------------------------------------------


def _chunks(spark, d) -> DataFrame:
    return _documents(spark, d).select("project_no", F.lit(0).alias("seq"), F.lit("").alias("heading"), "text")


def _questions(spark, d) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("project_no"))


def rt1_search(spark, d):
    return retrieve.search(retrieve.build_index(_chunks(spark, d)), _questions(spark, d)).select("query_id", "project_no", "score", "rank")


_RT1 = f"""WITH c AS MATERIALIZED (SELECT p, {_GRAMS.format(x="' ' || coalesce(text, '')")} AS g FROM ({{documents}})),
n AS (SELECT count(*) AS n, avg(len(g)) AS avg FROM c),
t AS MATERIALIZED (SELECT p, g, len, count(*) AS tf FROM (SELECT p, len(g) AS len, unnest(g) AS g FROM c) GROUP BY p, g, len),
i AS MATERIALIZED (SELECT g, ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t GROUP BY g),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_GRAMS.format(x="coalesce(text, '')")}) AS g FROM benchmark),
s AS (SELECT item_id AS query_id, t.p AS project_no, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg FROM n)))), 6) AS score
  FROM q JOIN t USING (g) JOIN i USING (g) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, project_no) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT query_id, project_no, score, rank FROM r WHERE rank <= 6"""
RT1 = _RT1.replace("{documents}", "SELECT CAST(doc_id AS VARCHAR) AS p, text FROM documents")


def rt1_index_upkeep(spark, d):
    """A search after an update: every hundredth notice is rewritten with its neighbour's source in front, every 101st
    goes. The index is updated, its deleted chunks are dropped, and neither cuts a text again that did not change."""
    chunks, number = _chunks(spark, d), F.col("project_no").cast("long")
    index = search_index.build_index(chunks)
    new = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("project_no"), F.lit(0).alias("seq"), F.lit("").alias("heading"), F.concat_ws(" ", "source", "lang", "text").alias("text"))
    rewritten = new.where(number % 100 == 3)
    gone = chunks.where(number % 101 == 5).select("project_no").join(rewritten.select("project_no"), "project_no", "left_anti")
    index = search_index.update_index(index, rewritten.select("project_no").unionByName(gone), rewritten)
    return retrieve.search(search_index.compact_index(index), _questions(spark, d)).select("query_id", "project_no", "score", "rank")


RT1_UPKEEP = _RT1.replace("{documents}", """SELECT CAST(doc_id AS VARCHAR) AS p, CASE WHEN doc_id % 100 = 3 THEN concat_ws(' ', source, lang, text) ELSE text END AS text
FROM documents WHERE doc_id % 100 = 3 OR doc_id % 101 <> 5""")


def rt2_answer_lines(spark, d):
    index, q = retrieve.build_index(_chunks(spark, d)), _questions(spark, d)
    return retrieve.extract_answer(retrieve.search(index, q), _chunks(spark, d), index, q)


def rt4_notice_ranking(spark, d):
    notices = _documents(spark, d).select("project_no", "title", F.lit("").alias("summary"), F.lit("접수중").alias("status"), F.lit(None).cast("string").alias("dup_of"))
    return retrieve.search_notices(_questions(spark, d), retrieve.build_index(_chunks(spark, d)), _chunks(spark, d), notices).select("query_id", "project_no", "score", "rank")


def ag4_idf(spark, d):
    return retrieve.build_index(_chunks(spark, d)).idf.select("gram", "df", F.round("idf", 6).alias("idf"))


AG4 = f"""WITH c AS (SELECT doc_id, {_GRAMS.format(x="coalesce(text, '')")} AS g FROM documents),
t AS (SELECT DISTINCT doc_id, unnest(g) AS gram FROM c)
SELECT gram, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t GROUP BY gram"""

# --- scalar functions ----------------------------------------------------------------------------------------------


def fn1_clean(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", F.md5(tx.clean(t).cast("binary")).alias("cleaned"), F.md5(tx.squash(t).cast("binary")).alias("squashed"), F.size(tx.lines(t)).alias("n_lines"))


FN1 = """SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS cleaned, md5(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS squashed,
CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS INTEGER) AS n_lines FROM documents"""


def fn3_mask(spark, d):
    a = _t(spark, d, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), "text")
    b = _t(spark, d, "conversations").select(F.lit("c").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text")
    return a.unionByName(b).select("kind", "id", "part", F.md5(tx.mask(F.col("text")).cast("binary")).alias("masked"), F.size(tx.emails(F.col("text"))).alias("n_emails"))


_B, _E = "(^|[^\\pL\\pN_])", "($|[^\\pL\\pN_])"
FN3 = f"""WITH x AS (SELECT 'd' AS kind, doc_id AS id, 0 AS part, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'c', conv_id, turn, coalesce(text, '') FROM conversations)
SELECT kind, id, part, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_B}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{5}}{_E}', '\\1***-**-*****\\2', 'g'),
'{_B}[0-9]{{6}}-[0-9]{{7}}{_E}', '\\1******-*******\\2', 'g'), '{_B}01[016789]-?[0-9]{{3,4}}-?[0-9]{{4}}{_E}', '\\1010-****-****\\2', 'g'), '[\\pL\\pN_.+-]+@[\\pL\\pN_-]+\\.[\\pL\\pN_.]+', '***@***', 'g')) AS masked,
CAST(len(list_distinct(regexp_extract_all(text, '[\\pL\\pN_.+-]+@[\\pL\\pN_-]+\\.[\\pL\\pN_.]+'))) AS INTEGER) AS n_emails FROM x"""


def fn5_period(spark, d):
    later = lambda c: F.add_months(F.to_date(c), 240).cast("string")  # noqa: E731  periods are of this century
    x = _orders(spark, d).select("project_no", F.concat(F.translate(later("receipt_start"), "-", "."), F.lit(" ~ "), later("receipt_end")).alias("p"), "receipt_end")
    x = x.select("project_no", tx.parse_period(F.col("p")).alias("d"), tx.d_day(F.col("receipt_end"), TODAY).alias("days"))
    return x.select("project_no", F.col("d.start").cast("string").alias("first"), F.col("d.end").cast("string").alias("last"), "days", tx.dday_label(F.col("days")).alias("label"))


FN5 = f"""WITH o AS ({_ORDERS}), x AS (SELECT *, CAST(receipt_end AS DATE) - DATE '{TODAY}' AS days FROM o)
SELECT project_no, CAST(CAST(CAST(receipt_start AS DATE) + INTERVAL 20 YEAR AS DATE) AS VARCHAR) AS first, CAST(CAST(CAST(receipt_end AS DATE) + INTERVAL 20 YEAR AS DATE) AS VARCHAR) AS last, CAST(days AS INTEGER) AS days,
CASE WHEN days = 0 THEN 'D-Day' WHEN days > 0 THEN 'D-' || days ELSE 'D+' || -days END AS label FROM x"""


def fn15_title_keys(spark, d):
    t = F.col("title")
    return _documents(spark, d).select("project_no", tx.norm_title(t).alias("title_key"), tx.file_stem(F.concat(t, F.lit(".pdf"))).alias("stem"), F.size(tx.char_ngrams(tx.norm_title(t), 2)).alias("n_grams"), F.size(tx.bigrams(t)).alias("n_tokens"))


_KEY = f"lower(regexp_replace({_TITLE}, '[^가-힣A-Za-z0-9]', '', 'g'))"
FN15 = f"""WITH x AS (SELECT doc_id, {_TITLE} AS t, lower(regexp_replace(regexp_replace(regexp_replace({_TITLE}, '\\[[^\\]]*\\]|<[^>]*>|20[0-9]{{2}}\\s*년?도?', ' ', 'g'), '[^가-힣A-Za-z0-9]', '', 'g'), '(지원)+$', '')) AS k FROM documents),
y AS (SELECT *, lower(regexp_replace(regexp_replace(t, '20[0-9]{{2}}\\s*년?', '', 'g'), '[^가-힣A-Za-z0-9]', '', 'g')) AS s FROM x)
SELECT CAST(doc_id AS VARCHAR) AS project_no, k AS title_key, CASE WHEN length(s) >= 6 THEN s ELSE '' END AS stem,
CAST(len({_SET.format(x="k", n=2)}) AS INTEGER) AS n_grams, CAST(len({_GRAMS.format(x="t")}) AS INTEGER) AS n_tokens FROM y"""


def st3_similarity(spark, d):
    """Title similarity of parts with the next part."""
    p = _t(spark, d, "part").select("p_partkey", tx.char_ngrams(F.lower("p_name"), 2).alias("g"))
    x = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("g").alias("h")), "p_partkey")
    return x.select("p_partkey", F.round(tx.dice(F.col("g"), F.col("h")), 6).alias("dice"), F.round(tx.jaccard(F.col("g"), F.col("h")), 6).alias("jaccard"))


ST3 = f"""WITH p AS (SELECT p_partkey, {_SET.format(x="lower(p_name)", n=2)} AS g FROM part),
x AS (SELECT a.p_partkey, len(a.g) AS n, len(b.g) AS m, len(list_intersect(a.g, b.g)) AS s FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, CASE WHEN n > 0 AND m > 0 THEN round(2.0 * s / (n + m), 6) ELSE 0.0 END AS dice, CASE WHEN n > 0 AND m > 0 THEN round(1.0 * s / (n + m - s), 6) ELSE 0.0 END AS jaccard FROM x"""


def ex12_fields(spark, d):
    x = _documents(spark, d).select("project_no", F.posexplode(extract.extract_fields(F.col("title"), F.lit(""), F.col("text"), LATIN)).alias("at", "f"))
    return x.select("project_no", "at", "f.field", "f.score")


_COUNT = "(length({x}) - length(replace({x}, '{w}', ''))) / {n}"
EX12 = "WITH s AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {i} AS o, '{name}' AS field, round(" + " + ".join(f"{weight} * (4.0 * ({_COUNT.format(x=_TITLE, w=w, n=len(w))}) + 0.5 * least({_COUNT.format(x="coalesce(text, '')", w=w, n=len(w))}, 10))" for w, weight in words.items()) + ", 1) AS score FROM documents"
    for i, (name, words) in enumerate(LATIN.fields.items())
) + """), k AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM s WHERE score >= 6)
SELECT CAST(doc_id AS VARCHAR) AS project_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) - 1 AS INTEGER) AS at, field, CAST(score AS DOUBLE) AS score FROM k WHERE score >= top * 0.25"""


def fn7_industries(spark, d):
    c = _t(spark, d, "customer")
    names = F.array("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "HOME").otherwise(" CARS "))
    return c.select("c_custkey", F.array_join(tx.normalize_industries(names, LATIN), ",").alias("industries"))


FN7 = """SELECT c_custkey, array_to_string(list_filter(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'],
lambda x: x = c_mktsegment OR (c_custkey % 2 = 0 AND x IN ('FURNITURE', 'HOUSEHOLD')) OR (c_custkey % 2 = 1 AND x = 'AUTOMOBILE')), ',') AS industries FROM customer"""

# --- filters, aggregates, ranks ------------------------------------------------------------------------------------


def fl3_publishable(spark, d):
    return tables.publishable(_orders(spark, d), TODAY).select("project_no", "status", "receipt_end")


FL3 = f"WITH o AS ({_ORDERS}) SELECT project_no, status, receipt_end FROM o WHERE status = '접수중' OR CAST(receipt_end AS DATE) >= DATE '{TODAY}' - 60"


def fl4_keyword(spark, d):
    return tables.filter_keyword(_t(spark, d, "part").withColumnRenamed("p_name", "title"), "e w").select("p_partkey", "title")


FL4 = "SELECT p_partkey, p_name AS title FROM part WHERE contains(regexp_replace(p_name, '\\s+', '', 'g'), 'ew')"


def ag1_counts(spark, d):
    return tables.status_counts(_orders(spark, d)).select(F.lit("status").alias("kind"), F.col("status").alias("value"), "n").unionByName(tables.source_counts(_orders(spark, d)).select(F.lit("source").alias("kind"), F.col("source").alias("value"), "n"))


AG1 = f"WITH o AS ({_ORDERS}) SELECT 'status' AS kind, status AS value, count(*) AS n FROM o GROUP BY status UNION ALL SELECT 'source', source, count(*) FROM o GROUP BY source"


def ag2_metrics(spark, d):
    return tables.publish_metrics(_orders(spark, d))


AG2 = f"WITH o AS ({_ORDERS}) SELECT count(*) FILTER (status = '접수중' AND dup_of IS NULL) AS count_open, count(dup_of) AS count_dups, count(*) AS count_total FROM o"


def ag8_contacts(spark, d):
    x = tables.contacts(_documents(spark, d).select(F.col("source").alias("project_no"), "text"))
    return x.select(F.col("project_no").alias("source"), F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"))


AG8 = """WITH e AS (SELECT source, unnest(regexp_extract_all(coalesce(text, ''), '[\\pL\\pN_.+-]+@[\\pL\\pN_-]+\\.[\\pL\\pN_.]+')) AS e FROM documents),
p AS (SELECT source, unnest(regexp_extract_all(coalesce(text, ''), '0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}')) AS p FROM documents),
a AS (SELECT source, string_agg(DISTINCT e, ',' ORDER BY e) AS emails FROM e GROUP BY source), b AS (SELECT source, string_agg(DISTINCT p, ',' ORDER BY p) AS phones FROM p GROUP BY source)
SELECT s.source, coalesce(a.emails, '') AS emails, coalesce(b.phones, '') AS phones FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN a ON a.source IS NOT DISTINCT FROM s.source LEFT JOIN b ON b.source IS NOT DISTINCT FROM s.source"""


def ag9_texts(spark, d):
    x = tables.notice_text(_t(spark, d, "conversations").select(F.col("conv_id").alias("project_no"), F.col("turn").alias("doc_seq"), "text"))
    return x.select("project_no", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("chars"))


AG9 = """WITH x AS (SELECT conv_id AS project_no, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id)
SELECT project_no, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS chars FROM x"""


def wn3_due_soon(spark, d):
    return tables.due_soon(_orders(spark, d), TODAY).select("project_no", "d_day")


WN3 = f"WITH o AS ({_ORDERS}) SELECT project_no, CAST(CAST(receipt_end AS DATE) - DATE '{TODAY}' AS INTEGER) AS d_day FROM o WHERE CAST(receipt_end AS DATE) >= DATE '{TODAY}' ORDER BY d_day, project_no LIMIT 8"


def wn5_first(spark, d):
    return tables.first_seen_dedupe(_t(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


WN5 = "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id"


def wn8_digest(spark, d):
    x = _orders(spark, d).select(F.col("customer").alias("sub_key"), "project_no", F.col("price").alias("score"), tx.d_day(F.col("receipt_end"), TODAY).alias("d_day"))
    return tables.digest_items(x, 3).select("sub_key", "project_no", "item", "n_more")


WN8 = f"""WITH o AS ({_ORDERS}), r AS (SELECT customer AS sub_key, project_no,
CAST(row_number() OVER (PARTITION BY customer ORDER BY price DESC, CAST(receipt_end AS DATE), project_no) AS INTEGER) AS item, count(*) OVER (PARTITION BY customer) AS n FROM o)
SELECT sub_key, project_no, item, greatest(n - 3, 0) AS n_more FROM r WHERE item <= 3"""

# --- joins ---------------------------------------------------------------------------------------------------------


def _copies(spark, d) -> DataFrame:
    """documents, exact copies marked with the first of them."""
    x = _t(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("title"), F.md5(tx.text(F.col("text")).cast("binary")).alias("h"))
    first = x.groupBy("h").agg(F.min("doc_id").alias("rep"))
    x = x.join(first, "h")
    return x.select(F.col("doc_id").alias("project_no"), "source", "title", F.when(F.col("doc_id") != F.col("rep"), F.col("rep")).alias("dup_of"))


_COPIES = """SELECT doc_id AS project_no, source, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY coalesce(text, '')) THEN min(doc_id) OVER (PARTITION BY coalesce(text, '')) END AS dup_of FROM documents"""


def jo3_also(spark, d):
    return tables.attach_also(_copies(spark, d)).select("project_no", F.array_join(F.transform("also", lambda a: a["project_no"]), ",").alias("also"))


JO3 = f"""WITH n AS ({_COPIES}), a AS (SELECT dup_of, string_agg(CAST(project_no AS VARCHAR), ',' ORDER BY project_no) AS also FROM n WHERE dup_of IS NOT NULL GROUP BY dup_of)
SELECT n.project_no, coalesce(a.also, '') AS also FROM n LEFT JOIN a ON a.dup_of = n.project_no WHERE n.dup_of IS NULL"""


def jo7_resolve(spark, d):
    n = _copies(spark, d)
    return tables.resolve_hits(n.select("project_no", F.lit(1.0).alias("score")), n).groupBy("notice_no").agg(F.sum("score").alias("score"))


JO7 = f"WITH n AS ({_COPIES}) SELECT coalesce(dup_of, project_no) AS notice_no, CAST(count(*) AS DOUBLE) AS score FROM n GROUP BY 1"


def jo4_new_items(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("sub_key"), F.concat("event_type", F.col("event_id") % 97).alias("project_no"), F.dayofmonth("ts").alias("day"))
    return tables.new_items(e.where("day > 15").select("sub_key", "project_no").distinct(), e.where("day <= 15").select("sub_key", "project_no"))


JO4 = """WITH e AS (SELECT user_id AS sub_key, event_type || (event_id % 97) AS project_no, day(ts) AS d FROM events)
SELECT DISTINCT sub_key, project_no FROM e WHERE d > 15 AND NOT EXISTS (SELECT 1 FROM e s WHERE s.sub_key = e.sub_key AND s.project_no = e.project_no AND s.d <= 15)"""


def _snapshot(spark, d, half: str) -> DataFrame:
    e = _t(spark, d, "events").where(f"day(ts) {half}")
    return e.groupBy(F.col("user_id").alias("project_no")).agg(F.array_sort(F.collect_set("event_type")).alias("attachment_names")).withColumn("source", F.concat(F.lit("s"), F.col("project_no") % 5))


def jo5_snapshot(spark, d):
    known = _snapshot(spark, d, "<= 15").withColumn("status", F.when(F.col("project_no") % 3 == 0, "접수마감").otherwise("접수중"))
    listing = _snapshot(spark, d, "> 15")
    return tables.snapshot_diff(known, listing, listing.where("source <> 's4'").select("source").distinct())


JO5 = """WITH k AS (SELECT user_id AS id, list_sort(list(DISTINCT event_type)) AS names FROM events WHERE day(ts) <= 15 GROUP BY user_id),
l AS (SELECT user_id AS id, list_sort(list(DISTINCT event_type)) AS names FROM events WHERE day(ts) > 15 GROUP BY user_id),
x AS (SELECT coalesce(k.id, l.id) AS project_no, k.id AS kid, l.id AS lid, k.names AS kn, l.names AS ln FROM k FULL JOIN l ON k.id = l.id)
SELECT project_no, 's' || (project_no % 5) AS source, CASE WHEN project_no % 5 = 4 THEN 'none' WHEN lid IS NULL THEN CASE WHEN project_no % 3 <> 0 THEN 'close' ELSE 'none' END
WHEN kid IS NULL OR kn <> ln THEN 'analyze' WHEN project_no % 3 <> 0 THEN 'skip' ELSE 'reopen' END AS action FROM x"""


def ag11_sent_state(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("sub_key"), F.col("event_type").alias("project_no"), F.dayofmonth("ts").alias("day"))
    sent, delivered = e.where("day <= 15").select("sub_key", "project_no").distinct(), e.where("day > 25").select("sub_key", "project_no").distinct()
    return tables.update_sent_state(sent, delivered, e.where("sub_key % 2 = 0").select("project_no").distinct())


AG11 = """WITH s AS (SELECT DISTINCT user_id AS sub_key, event_type AS project_no FROM events WHERE day(ts) <= 15), d AS (SELECT DISTINCT user_id AS sub_key, event_type AS project_no FROM events WHERE day(ts) > 25),
o AS (SELECT DISTINCT event_type AS project_no FROM events WHERE user_id % 2 = 0)
SELECT * FROM s WHERE sub_key NOT IN (SELECT sub_key FROM d) OR project_no IN (SELECT project_no FROM o) UNION SELECT * FROM d"""


def io4_upsert(spark, d):
    o = _orders(spark, d).select("project_no", "status", "price", F.col("receipt_start").alias("first_seen"), F.col("receipt_start").alias("last_seen"))
    old, new = o.where("cast(project_no AS bigint) % 3 <> 0"), o.where("cast(project_no AS bigint) % 5 = 0").select("project_no", F.lit("접수중").alias("status"), (F.col("price") + 1).alias("price"))
    return store.upsert_notices(old, new, TODAY).select("project_no", "status", F.round("price", 2).alias("price"), "first_seen", "is_new")


IO4 = f"""WITH o AS ({_ORDERS}), x AS (SELECT *, CAST(project_no AS BIGINT) % 3 <> 0 AS was, CAST(project_no AS BIGINT) % 5 = 0 AS is FROM o)
SELECT project_no, CASE WHEN x.is THEN '접수중' ELSE status END AS status, round(CASE WHEN x.is THEN price + 1 ELSE price END, 2) AS price, CASE WHEN was THEN receipt_start ELSE '{TODAY}' END AS first_seen, x.is AND NOT was AS is_new FROM x WHERE was OR x.is"""

# --- pages ---------------------------------------------------------------------------------------------------------


def fn28_html(spark, d):
    p = html.parse_html(_t(spark, d, "pages"), "page_id", "html")
    return p.select("page_id", F.size("lines").alias("n_lines"), F.size("links").alias("n_links"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("text_md5"))


def fn30_links(spark, d):
    return html.html_links(html.parse_html(_t(spark, d, "pages"), "page_id", "html"), "page_id", r"([^/?#]+)/?$")


# --- linkage and matching ------------------------------------------------------------------------------------------


def _linkable(spark, d) -> tuple[DataFrame, DataFrame]:
    """parts as notices of four sources that share their titles; the brand is all their text."""
    k = F.col("p_partkey")
    prefix = F.element_at(F.array(*map(F.lit, ("JB-", "AT-", "KOTRA-", "BIZ-"))), (k % 4 + 1).cast("int"))
    n = _t(spark, d, "part").select(F.concat(prefix, k.cast("string")).alias("project_no"), F.col("p_name").alias("title"), F.when(k % 5 > 0, F.lit(TODAY)).alias("receipt_end"), "p_brand")
    notices = n.select(
        "project_no", "title", F.lit("접수중").alias("status"), "receipt_end", F.lit("").alias("first_seen"),
        F.lit(None).cast("array<struct<name:string,files:array<string>>>").alias("attachments"), F.lit(None).cast("struct<regions:array<string>>").alias("target"),
        F.lit(None).cast("string").alias("dup_of"), F.lit(None).cast("string").alias("dup_reason"),
    )
    return notices, n.select("project_no", F.lit(0).alias("doc_seq"), F.lit("x.txt").alias("file_name"), F.col("p_brand").alias("text"))


def dd4_linkage(spark, d):
    """Parts of four sources, linked by title."""
    return link.mark_duplicates(*_linkable(spark, d)).where("dup_of IS NOT NULL").select("project_no", "dup_of", "dup_reason")


def _nations(spark, d) -> DataFrame:
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("n_nationkey") % len(v) + 1).cast("int"))
    return n.select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("region"), F.when(F.col("n_nationkey") % 6 == 0, "대기업").otherwise("중소기업").alias("size"), (F.col("n_nationkey") % 4 == 0).alias("listed"),
        F.array(pick(*LATIN.industries)).alias("industries"), F.lit("").alias("target_countries"), F.lit("수출 초보").alias("export_stage"),
        (F.col("n_nationkey") * 4000.0).alias("export_usd"), (F.col("n_nationkey") % 5 != 0).alias("direct_export"), F.lit(False).alias("is_overseas_distributor"),
        F.array(pick(*NEEDS)).alias("needs"),
    )


def _parts(spark, d) -> DataFrame:
    p, k = _t(spark, d, "part"), F.col("p_partkey")
    empty, rule = F.array().cast(extract.RULES), lambda on, name: F.when(on, F.array(F.struct(F.lit(name).alias("rule"), F.lit("").alias("evidence")))).otherwise(F.array().cast(extract.RULES))
    second = F.element_at(F.array(*map(F.lit, NEEDS)), (k % 4 + 1).cast("int"))
    field = lambda name, s: F.struct(name.alias("field"), F.lit(s).alias("score"), F.array().cast("array<string>").alias("evidence"))
    some = lambda on, *v: F.when(on, F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>"))
    target = F.struct(
        some(k % 3 == 0, "AUTOMOBILE", "BUILDING").alias("industries"), some(k % 4 == 0, "중소기업").alias("company_types"), some(k % 5 == 0, "ASIA", "EUROPE").alias("regions"),
        rule(k % 7 == 0, "상장기업 제외").alias("excludes"), rule(k % 8 == 0, "직수출 기업").alias("requires"), empty.alias("prefers"), rule(k % 9 == 0, "수출실적별 차등지원").alias("tiers"),
        F.array().cast("array<string>").alias("countries"), F.array().cast("array<string>").alias("text"), F.lit(None).cast("map<string,struct<from:string,evidence:string>>").alias("basis"),
    )
    return p.select(
        k.cast("string").alias("project_no"), F.col("p_name").alias("title"), F.col("p_brand").alias("source"), F.lit("접수중").alias("status"),
        F.date_add(F.to_date(F.lit(TODAY)), (k % 40 - 5).cast("int")).cast("string").alias("receipt_end"), F.date_sub(F.to_date(F.lit(TODAY)), (k % 30).cast("int")).cast("string").alias("first_seen"),
        F.lit("").alias("summary"), F.lit("").alias("detail_url"), F.lit(None).cast(store.NESTED["amount"]).alias("amount"), F.lit(0).alias("early_close"),
        F.array(field(F.col("p_type"), 9.0), field(second, 7.0)).alias("fields"), target.alias("target"), F.lit(None).cast("array<struct<seq:int,name:string,text:string>>").alias("sections"), F.lit(None).cast("string").alias("dup_of"),
    )


def sc_match(spark, d):
    """Nations as companies, parts as notices."""
    x = score.match(_nations(spark, d), _parts(spark, d), TODAY, lexicon=LATIN)
    return tables.rank_matches(x).select("profile_id", "project_no", "score", "grade", "d_day", F.size("fails").alias("n_fails"), "rank")


_MATCH = f"""n AS (SELECT n_nationkey AS k, r_name AS region, (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[n_nationkey % 5 + 1] AS ind, (['STANDARD', 'SMALL', 'MEDIUM', 'PROMO'])[n_nationkey % 4 + 1] AS need FROM nation JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT p_partkey AS j, [p_type, (['STANDARD', 'SMALL', 'MEDIUM', 'PROMO'])[p_partkey % 4 + 1]] AS w, p_partkey % 40 - 5 AS d, p_partkey % 30 AS age FROM part),
x AS (SELECT k, j, d, age,
  (d < 0)::INT + (j % 5 = 0 AND region NOT IN ('ASIA', 'EUROPE'))::INT + (j % 7 = 0 AND k % 4 = 0)::INT + (j % 4 = 0 AND k % 6 = 0)::INT + (j % 8 = 0 AND k % 5 = 0)::INT + (j % 3 = 0 AND ind NOT IN ('AUTOMOBILE', 'BUILDING'))::INT AS fails,
  CASE WHEN w[1] = need THEN 40 WHEN w[2] = need THEN 28 ELSE 0 END + CASE WHEN j % 3 <> 0 THEN 12 WHEN ind IN ('AUTOMOBILE', 'BUILDING') THEN 20 ELSE 0 END
  + CASE WHEN j % 5 <> 0 THEN 6 WHEN region IN ('ASIA', 'EUROPE') THEN 10 ELSE 0 END + 5 + CASE WHEN d >= 7 THEN 10 WHEN d >= 0 THEN 6 ELSE 0 END + CASE WHEN j % 9 <> 0 THEN 7 WHEN k * 4000 >= 50000 THEN 10 ELSE 6 END AS points FROM n CROSS JOIN p),
s AS (SELECT k AS profile_id, CAST(j AS VARCHAR) AS project_no, age, CAST(CASE WHEN fails > 0 THEN 0 ELSE least(points, 100) END AS INTEGER) AS score, CAST(d AS INTEGER) AS d_day, CAST(fails AS INTEGER) AS n_fails FROM x)"""
SC = f"""WITH {_MATCH}
SELECT profile_id, project_no, score, CASE WHEN n_fails > 0 THEN '부적합' WHEN score >= 80 THEN '적극 추천' WHEN score >= 60 THEN '추천' WHEN score >= 40 THEN '검토' ELSE '낮음' END AS grade, d_day, n_fails,
CAST(row_number() OVER (PARTITION BY profile_id ORDER BY n_fails > 0, score DESC, d_day, project_no) AS INTEGER) AS rank FROM s"""


def sc5_alerts(spark, d):
    x = score.match(_nations(spark, d), _parts(spark, d), TODAY, include_ineligible=False, lexicon=LATIN)
    return score.alerts(x, TODAY).select("profile_id", "project_no", "score", "kind")


SC5 = f"""WITH {_MATCH} SELECT profile_id, project_no, score, CASE WHEN age <= 7 THEN '신규·' ELSE '' END || CASE WHEN d_day <= 14 THEN '마감임박' ELSE '추천' END AS kind
FROM s WHERE n_fails = 0 AND score >= 70 AND (age <= 7 OR d_day <= 14)"""


QUERIES = {
    "rt1_search": rt1_search, "rt1_index_upkeep": rt1_index_upkeep, "rt2_answer_lines": rt2_answer_lines, "rt4_notice_ranking": rt4_notice_ranking, "ag4_idf": ag4_idf,
    "fn1_clean": fn1_clean, "fn3_mask": fn3_mask, "fn5_period": fn5_period, "fn15_title_keys": fn15_title_keys, "st3_similarity": st3_similarity, "ex12_fields": ex12_fields, "fn7_industries": fn7_industries,
    "fl3_publishable": fl3_publishable, "fl4_keyword": fl4_keyword, "ag1_counts": ag1_counts, "ag2_metrics": ag2_metrics, "ag8_contacts": ag8_contacts, "ag9_texts": ag9_texts,
    "wn3_due_soon": wn3_due_soon, "wn5_first": wn5_first, "wn8_digest": wn8_digest, "jo3_also": jo3_also, "jo4_new_items": jo4_new_items, "jo5_snapshot": jo5_snapshot, "jo7_resolve": jo7_resolve,
    "ag11_sent_state": ag11_sent_state, "io4_upsert": io4_upsert, "fn28_html": fn28_html, "fn30_links": fn30_links, "dd4_linkage": dd4_linkage, "sc_match": sc_match, "sc5_alerts": sc5_alerts,
}

SQL = {
    "rt1_search": RT1, "rt1_index_upkeep": RT1_UPKEEP, "ag4_idf": AG4, "fn1_clean": FN1, "fn3_mask": FN3, "fn5_period": FN5, "fn15_title_keys": FN15, "st3_similarity": ST3, "ex12_fields": EX12, "fn7_industries": FN7,
    "fl3_publishable": FL3, "fl4_keyword": FL4, "ag1_counts": AG1, "ag2_metrics": AG2, "ag8_contacts": AG8, "ag9_texts": AG9, "wn3_due_soon": WN3, "wn5_first": WN5, "wn8_digest": WN8,
    "jo3_also": JO3, "jo4_new_items": JO4, "jo5_snapshot": JO5, "jo7_resolve": JO7, "ag11_sent_state": AG11, "io4_upsert": IO4, "sc_match": SC, "sc5_alerts": SC5,
}

FLAGSHIP = "rt1_search"

QUERIES |= rules.QUERIES | notices.QUERIES | matches.QUERIES
SQL |= rules.SQL | notices.SQL | matches.SQL
