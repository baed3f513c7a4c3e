"""Registered queries of the scalar rules, filters, joins and aggregates over rows spliced from the driver's tables.

The tables hold no Korean, so each part, customer or order gets one of a few phrases by its key; the SQL states what
the rule must give for that phrase, and what follows from the row's own values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import text as tx
from noticeloom.operators import extract, html, lines, tables

TODAY = "1997-06-15"


def read(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("n"))


PARTS = "p AS (SELECT p_partkey AS k, p_name AS name, p_size AS n FROM part)"


class Cases:
    """Rows of constants, of which a row of a table takes one by its key."""

    def __init__(self, *rows: tuple):
        self.rows = rows

    def col(self, i: int) -> Column:
        return F.element_at(F.array(*(F.lit(r[i]) for r in self.rows)), (F.col("k") % len(self.rows) + 1).cast("int"))

    def sql(self, i: int) -> str:
        put = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
        return f"(list_value({', '.join(put(r[i]) for r in self.rows)}))[k % {len(self.rows)} + 1]"


def tail(c: Column) -> Column:
    """The text, then the row's key."""
    return F.concat(c, F.lit(" "), F.col("k").cast("string"))


def listed(c: Column) -> Column:
    return F.array_join(c, ",")


QUERIES, SQL = {}, {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL over ``p``."""

    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql if sql.lstrip().startswith("WITH") else f"WITH {PARTS} {sql}"
        return f

    return put


# --- texts ---------------------------------------------------------------------------------------------------------

_MADE = "화장품(뷰티),공예품,생활용품(소비재),의료기기,기타 공산품"
INDUSTRY = Cases(
    ("농식품 수출", "농수산,식품", "농수산,식품", "농식품"), ("K-뷰티 화장품 기업", "화장품(뷰티)", "화장품(뷰티)", "뷰티"), ("제조기업 모집", _MADE, _MADE, "제조기업"), ("식품소비재 기업", "식품", "식품", "식품"),
    ("AI 활용 마케팅 지원", "", "", ""), ("부품 수출", "기타 공산품", "", "부품"), ("한지 굿즈 medica", "공예품,의료기기", "공예품,의료기기", "한지"),
)


@query(f"SELECT k, {INDUSTRY.sql(1)} AS title_industries, {INDUSTRY.sql(2)} AS body_industries, {INDUSTRY.sql(3)} AS evidence FROM p")
def fn8_rule_hits(spark, d):
    t = tail(INDUSTRY.col(0))
    x = parts(spark, d).select("k", tx.rule_hits(t).alias("t"), tx.rule_hits(t, True).alias("b"))
    return x.select("k", listed(F.col("t.industries")).alias("title_industries"), listed(F.col("b.industries")).alias("body_industries"), "t.evidence")


@query(f"SELECT k, {INDUSTRY.sql(1)} AS industries FROM p")
def fn9_title_industries(spark, d):
    return parts(spark, d).select("k", listed(tx.title_industries(F.concat(F.lit("[지방특화] "), tail(INDUSTRY.col(0))))).alias("industries"))


SIDO = Cases(("경기도 수원", "경기"), ("김제시 기업", "전북"), ("전라남도 목포", "전남"), ("전남광주통합특별시", "전남"), ("해외 바이어", None), ("완도군 수산", "전남"))


@query(f"SELECT k, {SIDO.sql(1)} AS province FROM p")
def fn10_sido(spark, d):
    return parts(spark, d).select("k", tx.sido_of(tail(SIDO.col(0))).alias("province"))


TITLE = Cases(
    ("[경기] 수출 지원", "경기"), ("강원 글로벌 점프업 패키지", "강원"), ("2026년 김제시 수출사다리", "전북"), ("부산지역 중소기업 지원", "부산"), ("[천안·아산] 수출 지원", "충남"),
    ("부산 국제 전시회", None), ("수출 상담회 참가", None),
)


@query(f"SELECT k, {TITLE.sql(1)} AS region, '전남' AS trailing FROM p")
def fn11_title_region(spark, d):
    return parts(spark, d).select("k", tx.title_region(tail(TITLE.col(0))).alias("region"), tx.title_region(F.concat(F.lit("수출 "), F.col("k").cast("string"), F.lit(" (전남광주)"))).alias("trailing"))


TARGET = Cases(("전북 소재 중소기업", "전북"), ("서울 소재 코엑스 개최", None), ("경기도 관내 기업", "경기"), ("수출 기업", None), ("제주 지역 수출기업", "제주"))


@query(f"SELECT k, {TARGET.sql(1)} AS region, CASE WHEN {TARGET.sql(1)} IS NOT NULL THEN {TARGET.sql(0)} || ' ' || k END AS evidence FROM p")
def fn12_target_region(spark, d):
    x = parts(spark, d).select("k", tx.target_region(F.concat(F.lit("지원 개요\n"), tail(TARGET.col(0)), F.lit("\n끝"))).alias("t"))
    return x.select("k", "t.region", "t.evidence")


AGENCY = Cases(("수출 지원", "충청남도", "충남"), ("[경기] 수출 지원", "부산광역시", "경기"), ("수출 지원", "산업통상자원부", None), ("수출 지원", "서울산업진흥원", None), ("수출 지원", "수원시", "경기"))


@query(f"SELECT k, {AGENCY.sql(2)} AS region FROM p")
def fn13_notice_region(spark, d):
    return parts(spark, d).select("k", tx.notice_region(tail(AGENCY.col(0)), AGENCY.col(1)).alias("region"))


WHERE = Cases(  # title, agency, target, source, page, region, regions, where it is said
    ("[경기] 수출", "", "", "bizinfo", "", "경기", "경기", "제목"), ("수출", "", "전북 소재 기업", "at", "", "전북", "전북", "지원대상"), ("수출 전북 세미나", "", "", "jbexport", "", "전북", "전북", "제목"),
    ("수출", "", "", "jbexport", "우리 도내 기업은 신청", "전북", "전북", "지원대상"), ("수출", "", "", "kotra", "도내 기업", "전국", "", None), ("전남 수출", "", "", "at", "", "전남", "전남,광주", "제목"),
)


@query(f"SELECT k, {WHERE.sql(5)} AS region, {WHERE.sql(6)} AS regions, {WHERE.sql(7)} AS said FROM p")
def fn14_apply_region(spark, d):
    x = parts(spark, d).select("k", extract.apply_region(tail(WHERE.col(0)), WHERE.col(1), WHERE.col(2), WHERE.col(3), WHERE.col(4)).alias("r"))
    return x.select("k", "r.region", listed(F.col("r.regions")).alias("regions"), F.col("r.basis.from").alias("said"))


COUNTRY = Cases(("베트남, 미국", "동남아,미주"), ("UAE 두바이", "중동"), ("독일 쾰른", "유럽"), ("나고야", "일본"), ("국내", ""), ("중국·대만 홍콩", "중화권"), (None, ""))


@query(f"SELECT k, {COUNTRY.sql(1)} AS groups FROM p")
def fn19_country_groups(spark, d):
    return parts(spark, d).select("k", listed(tx.country_groups(COUNTRY.col(0))).alias("groups"))


UNIT = Cases(("억", 10000.0), ("천만", 1000.0), ("백만", 100.0), ("만", 1.0), ("원", None))


@query(f"SELECT k, CAST(k * {UNIT.sql(1)} AS DOUBLE) AS manwon FROM p")
def fn21_to_manwon(spark, d):
    return parts(spark, d).select("k", tx.to_manwon(F.format_number("k", 0), UNIT.col(0)).alias("manwon"))


_WON = "CASE WHEN {x} >= 1000 THEN format('{{:,}}', CAST(round_even({x} / 100.0, 0) AS BIGINT)) || '백만원' ELSE format('{{:,}}', CAST({x} AS BIGINT)) || '만원' END"
_AMOUNT = "a AS (SELECT k, (k % 400) * 25 AS x, CASE WHEN k % 3 = 0 THEN (k % 400) * 25 + 150 END AS s, CASE WHEN k % 4 = 0 THEN k % 100 END AS r FROM p)"


def _amount(spark, d) -> DataFrame:
    x, none = (F.col("k") % 400) * 25, F.array().cast("array<string>")
    amount = F.struct(x.cast("double").alias("max_manwon"), F.when(F.col("k") % 3 == 0, x + 150).cast("double").alias("special_max_manwon"), none.alias("special_countries"), F.when(F.col("k") % 4 == 0, F.col("k") % 100).cast("int").alias("rate"), none.alias("evidence"))
    return parts(spark, d).withColumn("amount", amount)


_SHOWN = f"CASE WHEN x > 0 THEN '최대 ' || {_WON.format(x='x')} || CASE WHEN s > 0 THEN ' (특례 ' || {_WON.format(x='s')} || ')' ELSE '' END || CASE WHEN r > 0 THEN ' · ' || r || '% 이내' ELSE '' END ELSE '공고문 참조' END"


@query(f"WITH {PARTS}, {_AMOUNT} SELECT k, {_SHOWN} AS amount FROM a")
def fn22_amount_text(spark, d):
    return _amount(spark, d).select("k", tx.amount_text(F.col("amount")).alias("amount"))


EARLY = Cases(("예산 소진 시 마감", 0, 1), ("상시 접수", 0, 0), ("예산\n소진", 0, 1), ("", 100, 1), ("", 6000, 0))


@query(f"SELECT k, {EARLY.sql(2)} = 1 AS early FROM p")
def fn24_early_close(spark, d):
    doc = F.concat(F.repeat(F.lit("가"), EARLY.col(1)), F.when(EARLY.col(1) > 0, "예산소진").otherwise(""))
    return parts(spark, d).select("k", tx.early_close(EARLY.col(0), doc).alias("early"))


def _fielded(spark, d) -> DataFrame:
    field = lambda name, s: F.struct(F.lit(name).alias("field"), F.lit(s).alias("score"), F.array().cast("array<string>").alias("evidence"))
    fields = F.when(F.col("k") % 5 > 0, F.slice(F.array(field("통번역", 9.0), field("물류비", 8.0), field("금융·보험", 7.0)), F.lit(1), (F.col("k") % 4).cast("int"))).otherwise(F.array().cast("array<struct<field:string,score:double,evidence:array<string>>>"))
    return _amount(spark, d).withColumn("fields", fields).withColumn("industries", F.when(F.col("k") % 2 == 0, F.array(F.lit("식품"), F.lit("농수산"))).otherwise(F.array().cast("array<string>"))).withColumn("end", F.when(F.col("k") % 3 > 0, F.concat(F.lit("2026-12-"), F.lpad((F.col("k") % 28 + 1).cast("string"), 2, "0"))))


_NAMES = "CASE WHEN k % 5 = 0 THEN [] ELSE list_slice(['통번역', '물류비', '금융·보험'], 1, k % 4) END"
_END = "CASE WHEN k % 3 > 0 THEN '2026-12-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') END"
_PLAIN = "CASE WHEN x >= 1000 THEN '최대 ' || CAST(round_even(x / 100.0, 0) AS BIGINT) || '백만원' WHEN x > 0 THEN '최대 ' || x || '만원' END"


@query(f"""WITH {PARTS}, {_AMOUNT}, f AS (SELECT *, {_NAMES} AS names FROM a)
SELECT k, array_to_string(list_filter([CASE WHEN len(names) > 0 THEN array_to_string(names[1:2], '/') END, {_PLAIN}, CASE WHEN r > 0 THEN r || '% 이내' END, CASE WHEN k % 2 = 0 THEN '대상:식품·농수산' END, '~' || {_END}], lambda v: v IS NOT NULL), ' | ') AS summary FROM f""")
def fn25_summary(spark, d):
    return _fielded(spark, d).select("k", tx.make_summary(F.col("fields"), F.col("amount"), F.col("industries"), F.col("end")).alias("summary"))


@query(f"""WITH {PARTS}, {_AMOUNT}, f AS (SELECT a.*, name, {_NAMES} AS names FROM a JOIN p USING (k))
SELECT k, name || ' | 접수 2026-11-01~' || coalesce({_END}, '상시') || ' | 지원 ' || {_SHOWN} || ' | 분야 ' || array_to_string(names, '·') || ' | 신청 이메일 제출, 문서24 | https://x/' || k AS fact FROM f""")
def fn26_fact_line(spark, d):
    methods = F.array(F.lit("이메일 제출"), F.lit("문서24"))
    return _fielded(spark, d).select("k", tx.fact_line(F.col("name"), F.lit("2026-11-01"), F.col("end"), F.col("amount"), F.col("fields"), methods, F.concat(F.lit("https://x/"), F.col("k"))).alias("fact"))


@query("""WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment, c_acctbal FROM customer)
SELECT k, '소재지 전남 / 규모 중소기업 / 업종 농수산·' || CASE WHEN k % 2 = 0 THEN '공예품' ELSE '의료기기' END || ' / 품목 ' || c_mktsegment || ' ***@*** / 희망국가 베트남 / 수출단계 수출 초보 / 전년 수출실적 ' ||
format('{:,}', CAST(round_even(abs(c_acctbal), 0) AS BIGINT)) || '달러 / 직수출 ' || CASE WHEN k % 3 = 0 THEN '예' ELSE '아니오' END || ' / 필요분야 통번역, 물류비' AS brief FROM c""")
def fn27_profile_brief(spark, d):
    c = read(spark, d, "customer").withColumn("k", F.col("c_custkey"))
    profile = F.struct(
        F.lit("전남").alias("region"), F.lit("중소기업").alias("size"), F.array(F.lit("농산"), F.when(F.col("k") % 2 == 0, "공예").otherwise("의료")).alias("industries"),
        F.concat("c_mktsegment", F.lit(" sales"), F.col("k"), F.lit("@mail.example.com")).alias("items"), F.lit("베트남").alias("target_countries"), F.lit("수출 초보").alias("export_stage"),
        F.abs("c_acctbal").alias("export_usd"), (F.col("k") % 3 == 0).alias("direct_export"), F.array(F.lit("통번역"), F.lit("물류비")).alias("needs"),
    )
    return c.select("k", tx.profile_brief(profile).alias("brief"))


BULLET = Cases(("- 항목", "항목"), ("○ ◦x", "x"), ("※ 참고", "※ 참고"), ("  ● 점", "● 점"), ("□ 칸", "□ 칸"), ("o 글", "글"), ("-x", "x"), ("평문", "평문"))


@query(f"SELECT k, {BULLET.sql(1)} || ' ' || k AS bare FROM p")
def fn31_strip_bullet(spark, d):
    return parts(spark, d).select("k", tx.strip_bullet(tail(BULLET.col(0))).alias("bare"))


@query("SELECT c_custkey AS k, substring(sha256(lower(c_name) || '@mail.example'), 1, 16) AS sub_key FROM customer")
def fn4_sub_key(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("k"), tx.sub_key(F.concat(F.lit("  "), F.upper("c_name"), F.lit("@Mail.example "))).alias("sub_key"))


@query("SELECT k, CASE k % 3 WHEN 0 THEN 'a' || k || ',b' WHEN 1 THEN 'b,a' || k || ',c' ELSE 'a' || k || ',b,c' END AS firsts FROM p")
def st2_ordered_union(spark, d):
    own, one = F.concat(F.lit("a"), F.col("k")), lambda *v: F.array(*v)
    a = F.when(F.col("k") % 3 == 0, one(own, own)).when(F.col("k") % 3 == 1, one(F.lit("b"), own)).otherwise(one(own, F.lit("b")))
    b = F.when(F.col("k") % 3 == 0, one(F.lit("b"), own)).otherwise(one(F.lit("b"), F.lit("c"), F.lit("e")))
    return parts(spark, d).select("k", listed(tx.ordered_union(a, b, 3)).alias("firsts"))


# --- filters -------------------------------------------------------------------------------------------------------

STATE = Cases(("접수중",), ("접수예정",), ("접수마감",), ("온라인 접수중(연장)",), (None,))


def _stated(spark, d) -> DataFrame:
    return parts(spark, d).select("k", F.col("k").cast("string").alias("project_no"), STATE.col(0).alias("status"), F.when(F.col("k") % 6 == 0, (F.col("k") + 1).cast("string")).alias("dup_of"), F.when(F.col("k") % 4 > 0, F.date_add(F.to_date(F.lit(TODAY)), (F.col("k") % 60 - 20).cast("int")).cast("string")).alias("receipt_end"))


_STATED = f"s AS (SELECT k, CAST(k AS VARCHAR) AS project_no, {STATE.sql(0)} AS status, CASE WHEN k % 6 = 0 THEN CAST(k + 1 AS VARCHAR) END AS dup_of, CASE WHEN k % 4 > 0 THEN CAST(CAST(DATE '{TODAY}' + CAST(k % 60 - 20 AS INTEGER) AS DATE) AS VARCHAR) END AS receipt_end FROM p)"


@query(f"WITH {PARTS}, {_STATED} SELECT k, 'open' AS shown FROM s WHERE status LIKE '%접수중%' UNION ALL SELECT k, 'all' FROM s UNION ALL SELECT k, 'every' FROM s")
def fl1_status(spark, d):
    s = _stated(spark, d)
    shown = lambda df, name: df.select("k", F.lit(name).alias("shown"))
    return shown(tables.filter_status(s, "접수중"), "open").unionAll(shown(tables.filter_status(s, "all"), "all")).unionAll(shown(tables.filter_status(s, None), "every"))


@query(f"WITH {PARTS}, {_STATED} SELECT k FROM s WHERE k % 6 <> 0")
def fl2_representatives(spark, d):
    return tables.representatives(_stated(spark, d)).select("k")


@query("SELECT k FROM p WHERE contains(name, 'in') OR contains('물류비', 'in') UNION ALL SELECT k FROM p WHERE k % 5 > 0 AND k % 4 >= 2")
def fl6_search_catalog(spark, d):
    x = _fielded(spark, d).withColumnRenamed("name", "title")
    return tables.search_catalog(x.withColumn("fields", F.array().cast("array<string>")), "in").select("k").unionAll(tables.search_catalog(x, "물류비").select("k"))


_SUBS = """CASE k % 4 WHEN 0 THEN [] WHEN 1 THEN ['at', 'kotra'] ELSE ['kotra'] END"""


@query("""SELECT k FROM p WHERE 60 + k % 40 >= greatest(70, CASE k % 3 WHEN 0 THEN 70 WHEN 1 THEN 85 ELSE 70 END)
AND (k % 4 = 0 OR CASE WHEN k % 2 = 0 THEN 'kotra' ELSE 'at' END IN (SELECT unnest(CASE k % 4 WHEN 1 THEN ['at', 'kotra'] ELSE ['kotra'] END)))
AND (k % 5 <> 0 OR contains(lower(name), 'an') OR contains('물류비', 'an'))""")
def fl5_subscriber_filter(spark, d):
    some = lambda *v: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    x = parts(spark, d).select(
        "k", (60 + F.col("k") % 40).cast("int").alias("score"), F.when(F.col("k") % 3 == 0, 60).when(F.col("k") % 3 == 1, 85).cast("int").alias("min_score"), F.when(F.col("k") % 2 == 0, "kotra").otherwise("at").alias("source"),
        F.when(F.col("k") % 4 == 0, some()).when(F.col("k") % 4 == 1, some("at", "kotra")).otherwise(some("kotra")).alias("sources"), F.when(F.col("k") % 5 == 0, some("AN")).alias("keywords"),
        F.upper("name").alias("title"), F.lit("").alias("summary"), some("물류비").alias("fields"), F.lit(None).cast("string").alias("section_text"),
    )
    return tables.subscriber_filter(x).select("k")


NORMAL = Cases(
    ("진행중", "접수중", "접수마감", "접수중"), ("예정", "접수예정", "접수마감", "접수예정"), ("종료", "접수마감", "접수마감", "접수마감"), ("신청가능", "접수마감", "접수마감", "접수중"),
    ("오늘마감", "접수마감", "접수마감", "접수중"), ("접수중", "접수마감", "접수중", "접수중"), ("공고중", "접수마감", "접수예정", "접수중"),
)


@query(f"SELECT k, {NORMAL.sql(1)} AS jexport, {NORMAL.sql(2)} AS jbexport, {NORMAL.sql(3)} AS kotra FROM p")
def fl8_status(spark, d):
    return parts(spark, d).select("k", *(tx.normalize_status(NORMAL.col(0), s).alias(s) for s in ("jexport", "jbexport", "kotra")))


ORIGIN = Cases(("JB-", "jbexport"), ("AT-", "at"), ("KOTRA-", "kotra"), ("BIZ-", "bizinfo"), ("", "jexport"))


@query(f"SELECT k, {ORIGIN.sql(1)} AS source FROM p")
def fl9_source(spark, d):
    return parts(spark, d).select("k", tx.source_of(F.concat(ORIGIN.col(0), F.col("k"))).alias("source"))


FILE = Cases(("공고.hwp",), ("예산.XLSX",), ("표.xls",), ("매크로.xlsm",), ("안내.pdf",), (None,))


@query("SELECT k FROM p WHERE k % 6 IN (0, 4, 5)")
def fl10_body_documents(spark, d):
    return tables.body_documents(parts(spark, d).withColumn("file_name", FILE.col(0))).select("k")


SITE = Cases(  # id, title, period, status
    ("x", " 수출\n지원 ", "2026-11-01 ~ 2026-12-10", "진행", "2026-11-01", "2026-12-10", "접수중"), ("y", "상담회", "26.11.01~26.12.10", "예정", "2026-11-01", "2026-12-10", "접수예정"),
    ("z", "", "2026-11-01", "진행", None, None, None), ("w", "전시회", "2026.13.40", "종료", None, None, "접수마감"),
)


@query(f"""SELECT 'BIZ-{{0}}' || k AS project_no, trim(regexp_replace({SITE.sql(1)}, '\\s+', ' ', 'g')) AS title, name || ' · 부서' AS subtitle, {SITE.sql(4)} AS receipt_start, {SITE.sql(5)} AS receipt_end,
{SITE.sql(6)} AS status, 'https://b/' || k AS url, 'a@b.kr' AS email FROM p WHERE k % 4 <> 2""".replace("{0}", ""))
def fl7_standardize(spark, d):
    x = parts(spark, d).select(F.col("k").alias("no"), SITE.col(1).alias("t"), SITE.col(2).alias("p"), SITE.col(3).alias("s"), F.col("name").alias("a"), F.lit(" 부서 ").alias("b"), F.lit("a@b.kr").alias("m"))
    y = tables.standardize_listing(x.withColumn("no", F.col("no").cast("string")), "bizinfo", "BIZ-", {"id": "no", "title": "t", "period": "p", "status": "s", "subtitle1": "a", "subtitle2": "b", "email": "m"}, "https://b/")
    return y.select("project_no", "title", "subtitle", "receipt_start", "receipt_end", "status", F.col("detail_url").alias("url"), F.col("contact")["이메일"].alias("email"))


CONDITION = Cases(  # min_score, industries, keywords, usd, direct, listed
    ("65", "농산, 수산", " 할랄 ,, 김", "1000.5", "false", "true", 70, "농수산", "할랄,김", 1000.5, 0, 1), ("85", "의료", "", None, None, None, 85, "의료기기", "", 0.0, 1, 0), ("120", "없음", None, "x", "true", "false", 100, "", "", 0.0, 1, 0),
    (None, "식품,공예", "a", "0", "false", None, 70, "식품,공예품", "a", 0.0, 0, 0),
)


@query(f"SELECT k, {CONDITION.sql(6)} AS min_score, {CONDITION.sql(7)} AS industries, {CONDITION.sql(8)} AS keywords, CAST({CONDITION.sql(9)} AS DOUBLE) AS export_usd, {CONDITION.sql(10)} = 1 AS direct_export, {CONDITION.sql(11)} = 1 AS listed FROM p")
def fl11_conditions(spark, d):
    names = ("min_score", "industries", "keywords", "export_usd", "direct_export", "listed")
    x = parts(spark, d).select("k", *(CONDITION.col(i).alias(n) for i, n in enumerate(names)), F.lit("").alias("needs"), F.lit(None).cast("string").alias("sources"))
    return tables.clean_conditions(x).select("k", "min_score", listed(F.col("industries")).alias("industries"), listed(F.col("keywords")).alias("keywords"), "export_usd", "direct_export", "listed")


ADDRESS = Cases(("@mail.kr", "active", None, 1), ("@mail", "active", None, 0), (" x@mail.kr", "active", None, 0), ("@mail.kr", "pending", None, 0), ("@mail.kr", "active", "new", 1), ("@mail.kr", "active", "", 1))


def _subscribers(spark, d) -> DataFrame:
    return parts(spark, d).select("k", F.concat(F.lit("s"), F.col("k"), ADDRESS.col(0)).alias("email"), ADDRESS.col(1).alias("status"), F.lit("old").alias("conditions"), ADDRESS.col(2).alias("pending"))


@query(f"SELECT k, CASE WHEN k % 6 = 4 THEN 'new' ELSE 'old' END AS conditions FROM p WHERE {ADDRESS.sql(3)} = 1")
def fl12_active(spark, d):
    return tables.active_subscribers(_subscribers(spark, d)).select("k", "conditions")


# --- joins and aggregates ------------------------------------------------------------------------------------------


@query(f"WITH {PARTS}, {_STATED} SELECT project_no, seq FROM s, (VALUES (0), (1)) v(seq) WHERE status LIKE '%접수중%'")
def jo6_semi_chunks(spark, d):
    s = _stated(spark, d)
    chunks = s.select("project_no", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    return tables.semi_chunks(chunks, tables.filter_status(s, "접수중"))


@query(f"""SELECT k, CASE WHEN k % 2 = 0 AND {ADDRESS.sql(3)} = 1 THEN 'sent' ELSE 'rejected' END AS what FROM p""")
def jo9_eligible(spark, d):
    s = _subscribers(spark, d)
    messages = s.select("k", F.concat(F.lit(" "), F.upper(F.when(F.col("k") % 2 == 0, F.col("email")).otherwise("nobody@x.kr"))).alias("to"))
    good, bad = tables.eligible_messages(messages, s)
    return good.select("k", F.lit("sent").alias("what")).unionAll(bad.select("k", F.lit("rejected").alias("what")))


@query(f"""WITH {PARTS}, {_STATED}, o AS (SELECT * FROM s WHERE status LIKE '%접수중%' AND dup_of IS NULL), f AS (SELECT unnest({_NAMES}) AS field FROM o)
SELECT 'open' AS what, count(*) AS n FROM o UNION ALL SELECT 'due', count(*) FILTER (CAST(receipt_end AS DATE) - DATE '{TODAY}' BETWEEN 0 AND 14) FROM o
UNION ALL SELECT 'profiles', count(*) FROM customer UNION ALL (SELECT field, count(*) FROM f GROUP BY field ORDER BY count(*) DESC, field LIMIT 2)""")
def ag3_dashboard(spark, d):
    n = _stated(spark, d).join(_fielded(spark, d).select("k", "fields"), "k")
    x = tables.dashboard(n, read(spark, d, "customer"), TODAY, 2)
    counts = x["counts"].select(F.explode(F.map_from_arrays(F.array(F.lit("open"), F.lit("due"), F.lit("profiles")), F.array("n_open", "n_due", "n_profiles"))).alias("what", "n"))
    return counts.unionAll(x["fields"].select(F.col("field").alias("what"), "n"))


@query("""WITH h AS (SELECT user_id AS q, event_type AS p, value AS s, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS r FROM events),
g AS (SELECT q, p, round(sum(round(s, 2)), 6) AS total, min(r) AS first FROM h WHERE r <= 4 GROUP BY q, p), w AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY total DESC, first) AS n FROM g)
SELECT q AS query_id, p AS project_no, total FROM w WHERE n = 1""")
def ag5_top_notice(spark, d):
    from pyspark.sql import Window

    e = read(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("project_no"), F.col("value").alias("score"), "event_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "event_id")
    return tables.top_notice(e.withColumn("rank", F.row_number().over(w)))


@query("""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id AS project_no, CAST(length(t) AS INTEGER) AS chars, CAST(len(list_filter(string_split(t, chr(10)), lambda v: trim(v) <> '')) AS INTEGER) AS paragraphs FROM x""")
def ag10_document_stats(spark, d):
    x = read(spark, d, "documents").select(F.col("doc_id").alias("project_no"), F.lit("f").alias("file_name"), F.lit(0).alias("n_tables"), "text")
    return tables.document_stats(x).select("project_no", "chars", "paragraphs")


@query(f"""WITH o AS (SELECT o_custkey AS doc_id, CAST(o_orderdate AS DATE) AS e, CAST(o_orderkey AS VARCHAR) AS label FROM orders), x AS (SELECT *, CAST(e - DATE '{TODAY}' AS INTEGER) AS d FROM o WHERE e >= DATE '{TODAY}'),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, label) AS n FROM x) SELECT doc_id, d AS d_day, CAST(e AS VARCHAR) AS "end", label FROM r WHERE n = 1""")
def ag12_next_deadline(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.to_date("o_orderdate").cast("string").alias("end"), F.col("o_orderkey").cast("string").alias("label"))
    x = tables.next_deadline(o.withColumn("d_day", tx.d_day(F.col("end"), TODAY)))
    return x.select("doc_id", "next.d_day", "next.end", "next.label")


@query("SELECT count(DISTINCT o_custkey) AS n_messages, count(*) AS n_items FROM orders")
def ag13_totals(spark, d):
    return tables.digest_totals(read(spark, d, "orders").select(F.col("o_custkey").alias("sub_key"), "o_orderkey"))


@query("""WITH s AS (SELECT DISTINCT user_id AS k FROM events WHERE day(ts) <= 10), n AS (SELECT DISTINCT user_id AS k FROM events WHERE day(ts) > 20 AND value > 50), u AS (SELECT DISTINCT user_id AS k FROM events)
SELECT u.k AS sub_key, CASE WHEN s.k IS NULL THEN '1997-06-15' ELSE '1997-01-01' END AS since, CASE WHEN n.k IS NOT NULL THEN '1997-06-15' WHEN s.k IS NOT NULL THEN '1997-05-01' END AS last FROM u LEFT JOIN s ON s.k = u.k LEFT JOIN n ON n.k = u.k""")
def ag11_sub_state(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("sub_key"), F.dayofmonth("ts").alias("day"), "value")
    state = e.where("day <= 10").select("sub_key").distinct().select("sub_key", F.lit("1997-01-01").alias("since"), F.lit("1997-05-01").alias("last"))
    return tables.update_sub_state(state, e.where("day > 20 AND value > 50"), e.select("sub_key").distinct(), TODAY)


# --- orders of rows ------------------------------------------------------------------------------------------------


@query(f"WITH {PARTS}, {_STATED}, r AS (SELECT k, row_number() OVER (ORDER BY receipt_end NULLS LAST, project_no) AS n FROM s) SELECT k FROM r WHERE n <= 100")
def wn2_deadline_order(spark, d):
    return tables.order_by_deadline(_stated(spark, d)).limit(100).select("k")


@query(f"""WITH {PARTS}, {_STATED}, x AS (SELECT k, CAST(receipt_end AS DATE) - DATE '{TODAY}' AS d, k % 7 AS score FROM s), r AS (SELECT k, row_number() OVER (ORDER BY coalesce(d, 999), score DESC, k % 3, CAST(k AS VARCHAR)) AS n FROM x) SELECT k FROM r WHERE n <= 100""")
def wn4_alert_order(spark, d):
    x = _stated(spark, d).withColumn("d_day", tx.d_day(F.col("receipt_end"), TODAY)).withColumn("score", F.col("k") % 7).withColumn("profile_id", F.col("k") % 3)
    return tables.order_alerts(x).limit(100).select("k")


@query(f"""WITH {PARTS}, x AS (SELECT k, k % 50 AS g, CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 99 ELSE 0 END AS o, 'd' || k % 3 AS f FROM p) SELECT g, arg_min(k, (o, f, CAST(k AS VARCHAR))) AS k FROM x GROUP BY g""")
def wn6_representative(spark, d):
    source = Cases(("jbexport",), ("at",), ("kotra",), ("other",), ("jexport",))
    x = parts(spark, d).select("k", (F.col("k") % 50).alias("g"), F.col("k").cast("string").alias("project_no"), source.col(0).alias("source"), F.concat(F.lit("d"), F.col("k") % 3).alias("first_seen"))
    return tables.representative_rank(x).groupBy("g").agg(F.min_by("k", "rank_key").alias("k"))


@query("WITH r AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_name) AS n FROM customer) SELECT k, CAST((n - 1) // 20 AS INTEGER) AS batch FROM r WHERE n <= 70")
def wn9_batches(spark, d):
    return tables.delivery_batches(read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("sub_key")), 20, 70).select("k", "batch")


@query("SELECT 'c' AS source, c_custkey AS id, c_name AS title, NULL AS status FROM customer UNION ALL SELECT 's', s_suppkey, NULL, s_name FROM supplier")
def st1_union_sources(spark, d):
    c = read(spark, d, "customer").select(F.lit("c").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    s = read(spark, d, "supplier").select(F.lit("s").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("status"))
    return tables.union_sources(c, s)


# --- pages and tables ----------------------------------------------------------------------------------------------


@query("SELECT k AS page_id, '접수기간' AS key, '2026 ' || k AS value FROM p UNION ALL SELECT k, '담당', name FROM p UNION ALL SELECT k, '분류', 'b' FROM p WHERE k % 2 = 0")
def fn29_html_pairs(spark, d):
    page = F.concat(
        F.lit("<table><tr><th>접수기간 :</th><td> 2026\n"), F.col("k"), F.lit("</td><th>빈 것</th></tr><tr><th>x</th></tr></table><dl><dt>담당</dt><dd>"), F.col("name"), F.lit("</dd></dl>"),
        F.when(F.col("k") % 2 == 0, "<dl><dt>분류</dt><dd>a</dd><dt>분류</dt><dd>b</dd></dl>").otherwise(""),
    )
    parsed = html.parse_html(parts(spark, d).select(F.col("k").alias("page_id"), page.alias("page")), "page_id", "page")
    return html.html_key_values(parsed, "page_id", " :").select("page_id", F.col("k").alias("key"), F.col("v").alias("value"))


def _cells(spark, d) -> DataFrame:
    """Two rows of three: a title over all, then a and b over two columns, then a later cell over the last place."""
    cell = lambda o, r, c, h, w, t: F.struct(F.lit(o).alias("cell_order"), F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(h).alias("row_span"), F.lit(w).alias("col_span"), t.alias("text"))
    own = F.concat(F.lit("a"), F.col("k"))
    x = parts(spark, d).select(F.col("k").cast("string").alias("doc_id"), F.lit(1).alias("table_no"), F.explode(F.array(cell(0, 0, 0, 1, 3, F.lit("제목")), cell(1, 1, 0, 1, 1, own), cell(2, 1, 1, 1, 2, F.lit("b")), cell(3, 1, 2, 0, 0, F.when(F.col("k") % 2 == 0, "c").otherwise("b")))).alias("c"))
    return x.select("doc_id", "table_no", "c.*")


@query("""SELECT CAST(k AS VARCHAR) AS doc_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, CASE WHEN r = 0 THEN '제목' WHEN c = 0 THEN 'a' || k WHEN c = 2 AND k % 2 = 0 THEN 'c' ELSE 'b' END AS text FROM p, range(2) x(r), range(3) y(c)""")
def fn32_expand_cells(spark, d):
    return lines.expand_cells(_cells(spark, d)).select("doc_id", "row", "col", "text")


@query("SELECT CAST(k AS VARCHAR) AS doc_id, '앞' || chr(10) || '제목' || chr(10) || 'a' || k || ' | b' || CASE WHEN k % 2 = 0 THEN ' | c' ELSE '' END || chr(10) || '뒤 [표 1]' AS text FROM p")
def fn33_inline_tables(spark, d):
    x = parts(spark, d).select(F.col("k").cast("string").alias("doc_id"), F.posexplode(F.array(F.lit("앞"), F.lit("[표 1]"), F.lit("뒤 [표 1]"))).alias("line_no", "text"))
    return lines.inline_tables(x, lines.expand_cells(_cells(spark, d)))
