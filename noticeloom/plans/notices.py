"""Registered queries of line analysis, metadata extraction and records over documents spliced from the parts table.

Each part becomes a document of Korean lines with its key, name and figures of it in them; the SQL states what must be
read from such a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import text as tx
from noticeloom.operators import extract, lines, tables
from noticeloom.plans.rules import _MADE, PARTS, Cases, listed, parts, read, tail
from noticeloom.sources import store
from noticeloom.sources.staging import dealt

NOW = "2026-12-15"
QUERIES, SQL = {}, {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL over ``p``."""

    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql if sql.lstrip().startswith("WITH") else f"WITH {PARTS} {sql}"
        return f

    return put


def _two(c) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


#: The lines of a document, as SQL over k and name.
_LINES = (
    "'수출지원사업 공고 ' || k",
    "'1. 사업 개요'",
    "'가. 목적'",
    "'○ 사업명 : 수출 지원 ' || k",
    "'- 하나 ' || name",
    "'- 둘'",
    "'※ 참고'",
    "'본문 줄'",
    "'2. 신청 방법'",
    "'접수기간 : 2026.12.' || (k % 28 + 1) || ' ~ 1.10 18:00'",
    "'2026. 12. ~ 2027. ' || (k % 12 + 1) || '.'",
    "'지원조건'",
    "'- 첫째 ' || k",
    "'※ 단서'",
    "'1) 둘째'",
    "'끝'",
    "'최대 ' || (k % 9 + 1) || '백만원, ' || (k % 100) || '% 지원'",
    "(k % 50 + 1) || '㎡ 이상'",
    "'붙임 2 「신청서 ' || k || '」 1부'",
    "'【붙임 1】'",
)


def _columns() -> list[Column]:
    """The lines of a document."""
    return [
        F.concat(F.lit("수출지원사업 공고 "), F.col("k")),
        F.lit("1. 사업 개요"),
        F.lit("가. 목적"),
        F.concat(F.lit("○ 사업명 : 수출 지원 "), F.col("k")),
        F.concat(F.lit("- 하나 "), F.col("name")),
        F.lit("- 둘"),
        F.lit("※ 참고"),
        F.lit("본문 줄"),
        F.lit("2. 신청 방법"),
        F.concat(F.lit("접수기간 : 2026.12."), F.col("k") % 28 + 1, F.lit(" ~ 1.10 18:00")),
        F.concat(F.lit("2026. 12. ~ 2027. "), F.col("k") % 12 + 1, F.lit(".")),
        F.lit("지원조건"),
        F.concat(F.lit("- 첫째 "), F.col("k")),
        F.lit("※ 단서"),
        F.lit("1) 둘째"),
        F.lit("끝"),
        F.concat(F.lit("최대 "), F.col("k") % 9 + 1, F.lit("백만원, "), F.col("k") % 100, F.lit("% 지원")),
        F.concat(F.col("k") % 50 + 1, F.lit("㎡ 이상")),
        F.concat(F.lit("붙임 2 「신청서 "), F.col("k"), F.lit("」 1부")),
        F.lit("【붙임 1】"),
    ]


def _lines(spark, d) -> DataFrame:
    return parts(spark, d).select(F.col("k").cast("string").alias("doc_id"), F.posexplode(F.array(*_columns())).alias("line_no", "text"))


def _from(*numbers: int) -> str:
    """SQL of these lines joined."""
    return " || chr(10) || ".join(_LINES[i] for i in numbers)


_DOC = "CAST(k AS VARCHAR) AS doc_id"


# --- lines ---------------------------------------------------------------------------------------------------------


@query(f"SELECT {_DOC}, l AS line_no, CASE WHEN l = 2 THEN 2 ELSE 1 END AS level FROM p, (VALUES (1), (2), (8), (19)) v(l)")
def ex1_headings(spark, d):
    return lines.find_headings(_lines(spark, d)).where("level IS NOT NULL").select("doc_id", "line_no", "level")


@query(f"""SELECT {_DOC}, CAST(l AS INTEGER) AS line_no, CASE WHEN l = 0 THEN '' WHEN l < 8 THEN '1. 사업 개요' WHEN l < 19 THEN '2. 신청 방법' ELSE '【붙임 1】' END AS section, CASE WHEN l BETWEEN 2 AND 7 THEN '가. 목적' ELSE '' END AS subsection FROM p, range(20) v(l)""")
def jo8_section_of(spark, d):
    return lines.section_of(_lines(spark, d)).select("doc_id", "line_no", "section", "subsection")


_KEYS = f"""kv AS (SELECT {_DOC}, 3 AS line_no, '1. 사업 개요' AS section, '가. 목적' AS subsection, '사업명' AS key, '수출 지원 ' || k AS value, '하나 ' || name || ';둘;※ 참고' AS items FROM p
UNION ALL SELECT {_DOC}, 9, '2. 신청 방법', '', '접수기간', '2026.12.' || (k % 28 + 1) || ' ~ 1.10 18:00', '' FROM p)"""


@query(f"WITH {PARTS}, {_KEYS} SELECT * FROM kv")
def ex2_key_values(spark, d):
    return lines.key_values(_lines(spark, d)).withColumn("items", F.array_join("items", ";"))


@query(f"WITH {PARTS}, {_KEYS} SELECT doc_id, key AS topic, value FROM kv")
def ex3_topics(spark, d):
    return lines.topics(lines.key_values(_lines(spark, d))).select("doc_id", "topic", "value")


_DAY = "'2026-12-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0')"


@query(f"""SELECT {_DOC}, 9 AS line_no, '2. 신청 방법' AS section, '' AS subsection, '접수기간' AS label, {_DAY} AS start, '2027-01-10' AS "end", '18:00' AS time, 26 AS d_day,
CASE WHEN k % 28 + 1 <= 15 THEN '진행중' ELSE '예정' END AS status, {_from(9)} AS line FROM p""")
def ex4_schedule(spark, d):
    return lines.schedule(_lines(spark, d), NOW)


@query(f"SELECT {_DOC}, 10 AS line_no, '2. 신청 방법' AS label, '2026-12' AS start, '2027-' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') AS \"end\", '월단위' AS status FROM p")
def ex5_month_ranges(spark, d):
    return lines.month_ranges(_lines(spark, d)).select("doc_id", "line_no", "label", "start", "end", "status")


@query(f"SELECT {_DOC}, 11 AS line_no, '지원조건' AS title, '첫째 ' || k || '  (※ 단서);둘째' AS items FROM p")
def ex6_requirements(spark, d):
    return lines.requirements(_lines(spark, d)).withColumn("items", F.array_join("items", ";"))


_NUMBERS = f"""n AS (SELECT {_DOC}, 16 AS line_no, 'money' AS kind, CAST(k % 9 + 1 AS VARCHAR) AS value, '백만원' AS unit, {_from(16)} AS context FROM p
UNION ALL SELECT {_DOC}, 16, 'percent', CAST(k % 100 AS VARCHAR), '%', {_from(16)} FROM p UNION ALL SELECT {_DOC}, 17, 'area', CAST(k % 50 + 1 AS VARCHAR), '㎡', {_from(17)} FROM p)"""


@query(f"WITH {PARTS}, {_NUMBERS} SELECT * FROM n")
def ex7_numbers(spark, d):
    return lines.numbers(_lines(spark, d))


@query(f"SELECT {_DOC}, 2 AS no, '신청서 ' || k AS title FROM p")
def ex8_forms(spark, d):
    return lines.forms(_lines(spark, d))


@query(f"SELECT {_DOC}, 1 AS table_no, '항목0;항목1;항목2' || CASE WHEN k % 2 = 0 THEN ';항목3' ELSE '' END AS fields FROM p WHERE k % 3 > 0")
def ex9_blank_fields(spark, d):
    filled = F.when((F.col("row") == 3) & (F.col("k") % 2 == 1), F.lit("값")).when((F.col("row") == 1) & (F.col("k") % 3 == 0), "값").when((F.col("row") >= 2) & (F.col("k") % 3 == 0), "값").otherwise("")
    x = parts(spark, d).withColumn("row", F.explode(F.array(*map(F.lit, range(4)))))
    cells = F.array(F.struct(F.lit(0).alias("col"), F.concat(F.lit("항목"), F.col("row")).alias("text")), F.struct(F.lit(1).alias("col"), filled.alias("text")))
    x = x.select(F.col("k").cast("string").alias("doc_id"), F.lit(1).alias("table_no"), "row", F.explode(cells).alias("c")).select("doc_id", "table_no", "row", "c.*")
    return lines.blank_fields(x).withColumn("fields", F.array_join("fields", ";"))


_SECTIONS = f"""s AS (SELECT {_DOC}, '공고 안내' AS name, {_from(0)} AS text FROM p UNION ALL SELECT {_DOC}, '사업개요', '[사업 개요]' || chr(10) || {_from(*range(2, 8))} FROM p
UNION ALL SELECT {_DOC}, '신청방법·접수', '[신청 방법]' || chr(10) || {_from(*range(9, 14))} FROM p UNION ALL SELECT {_DOC}, '기타', '[둘째]' || chr(10) || {_from(*range(15, 18))} FROM p)"""


@query(f"WITH {PARTS}, {_SECTIONS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['공고 안내', '사업개요', '신청방법·접수', '기타'], name)) - 1 AS INTEGER) AS at, name, text FROM s")
def ex10_sections(spark, d):
    return extract.doc_sections(_lines(spark, d)).select("doc_id", F.posexplode("sections").alias("at", "s")).select("doc_id", "at", "s.name", "s.text")


@query("""WITH p AS (SELECT p_partkey AS k, 200 + p_partkey % 100 AS n FROM part), c AS (SELECT k, n, 0 AS i, '개요' AS heading, 4 AS chars FROM p
UNION ALL SELECT k, n, unnest(range(1, CASE WHEN n < 250 THEN 3 ELSE 4 END)), '1. 머리', unnest(CASE WHEN n < 250 THEN [2 * n + 1, n] ELSE [n, n, n] END) FROM p)
SELECT CAST(k AS VARCHAR) AS project_no, CAST(i AS INTEGER) AS seq, heading, CAST(chars AS INTEGER) AS chars FROM c""")
def ex11_chunks(spark, d):
    x = parts(spark, d).withColumn("project_no", F.col("k").cast("string"))
    sections = x.select("project_no", F.lit(0).alias("seq"), F.lit("개요").alias("name"), F.lit("가나다라").alias("text"))
    row = F.repeat(F.lit("x"), (200 + F.col("k") % 100).cast("int"))
    docs = x.select("project_no", F.lit(0).alias("doc_seq"), F.lit("f.hwp").alias("file_name"), F.concat_ws("\n", F.lit("1. 머리"), row, row, row).alias("text"))
    return extract.make_chunks(sections, docs).select("project_no", "seq", "heading", F.length("text").alias("chars"))


@query(f"SELECT {_DOC}, '지원조건;  - 첫째 ' || k || ';  ※ 단서;최대 ' || (k % 9 + 1) || '백만원, ' || (k % 100) || '% 지원' AS lines FROM p")
def ex17_pick_lines(spark, d):
    return lines.pick_lines(_lines(spark, d), "지원조건|백만원").withColumn("lines", F.array_join("lines", ";"))


@query(f"""WITH {PARTS}, {_KEYS}, {_NUMBERS} SELECT doc_id, 'key_values' AS what, 2 AS n FROM kv WHERE key = '사업명' UNION ALL SELECT {_DOC}, w, c FROM p, (VALUES ('topics', 2), ('schedule', 1), ('months', 1), ('requirements', 1), ('numbers', 3), ('forms', 1)) v(w, c)""")
def io8_analysis_tables(spark, d):
    out = None
    for name, df in store.analysis_tables(_lines(spark, d), NOW).items():
        x = df.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(name).alias("what"), "n")
        out = x if out is None else out.unionAll(x)
    return out


# --- metadata ------------------------------------------------------------------------------------------------------

AIM = Cases(  # title, target text, text of the documents: industries, types, regions, excludes, requires, prefers, tiers, countries, where the industries are said
    ("전남 농식품 수출 지원", "전남 소재 중소기업으로 수출 실적이 있는 곳\n코스닥 상장 기업 제외", "", "농수산,식품", "중소기업", "전남", "상장기업 제외", "", "", 0, "", "제목"),
    ("해외 상담회 참가 지원", "화장품 제조를 하는 수출 기업이 대상이 됩니다\n직접 수출 기업만 신청 가능", "", "화장품(뷰티)", "수출기업", "", "", "직수출 기업", "", 0, "", "지원대상"),
    ("[경기] 베트남 판촉전", "해외 유통매장 운영사와 중소 제조사가 함께 신청\n할랄인증 기업 우선 지원", "", _MADE, "해외 유통매장 운영사,중소기업", "경기", "", "", "할랄인증 기업", 0, "베트남", "지원대상"),
    ("수출 물류비 지원", "짧은 글", "30만불 이상 수출 기업은 70%\n10만불 이상은 50%", "", "수출기업", "", "", "", "", 2, "", None),
)


@query(f"""SELECT k, {AIM.sql(3)} AS industries, {AIM.sql(4)} AS types, {AIM.sql(5)} AS regions, {AIM.sql(6)} AS excludes, {AIM.sql(7)} AS requires, {AIM.sql(8)} AS prefers, {AIM.sql(9)} AS tiers, {AIM.sql(10)} AS countries, {AIM.sql(11)} AS said FROM p""")
def ex13_target(spark, d):
    x = dealt(parts(spark, d)).select("k", extract.extract_target(AIM.col(0), tail(AIM.col(1)), F.lit(""), F.lit(""), AIM.col(2)).alias("t"))
    rule = lambda c: listed(F.transform(F.col(f"t.{c}"), lambda r: r["rule"]))
    return x.select("k", listed(F.col("t.industries")).alias("industries"), listed(F.col("t.company_types")).alias("types"), listed(F.col("t.regions")).alias("regions"), rule("excludes").alias("excludes"), rule("requires").alias("requires"), rule("prefers").alias("prefers"), F.size("t.tiers").alias("tiers"), listed(F.col("t.countries")).alias("countries"), F.try_element_at("t.basis", F.lit("industries"))["from"].alias("said"))


def _page() -> Column:
    return F.concat(
        F.lit("지원한도: 기업당 최대 "), F.col("k") % 90 + 10, F.lit("만원\n총 지원규모 9,000만원 이내\n"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("※ 단, 중동 최대 "), F.col("k") % 90 + 1000, F.lit("만원\n"))).otherwise(""),
        F.lit("소요비용의 "), F.col("k") % 50 + 10, F.lit("% 이내 지원\n비용 "), F.col("k") % 50 + 10, F.lit("% 보조\n5% 이내\n99% 차등 지원\n80% 이내"),
    )


@query("""SELECT k, CAST(k % 90 + 10 AS DOUBLE) AS top, CASE WHEN k % 3 = 0 THEN CAST(k % 90 + 1000 AS DOUBLE) END AS special, CASE WHEN k % 3 = 0 THEN '중동' ELSE '' END AS countries, CAST(k % 50 + 10 AS INTEGER) AS rate,
'총 지원규모 9,000만원 이내' AS first_evidence FROM p WHERE k % 4 > 0 UNION ALL SELECT k, 120.0, NULL, '', NULL, '지원금액 120만원' FROM p WHERE k % 4 = 0""")
def ex14_amount(spark, d):
    page = F.when(F.col("k") % 4 > 0, _page()).otherwise("문의는 담당자에게")
    x = parts(spark, d).select("k", extract.extract_amount(page, F.lit("지원금액 120만원\n지원금액 5만원")).alias("a"))
    return x.select("k", F.col("a.max_manwon").alias("top"), F.col("a.special_max_manwon").alias("special"), listed(F.col("a.special_countries")).alias("countries"), "a.rate", F.element_at("a.evidence", 1).alias("first_evidence"))


HOW = Cases(  # method, page's address, documents: methods, emails, phones
    ("온라인 신청\n문의 061-123-4567", "a@b.kr", "x@y.kr", "온라인 신청", "a@b.kr", "061-123-4567,02-111-2222"), ("이메일 접수 c@d.kr", "", "문서24 제출", "이메일 제출,문서24", "c@d.kr", "02-111-2222"),
    ("", "", "p@q.kr r@s.kr p@q.kr t@u.kr v@w.kr", "공고문 참조", "p@q.kr,r@s.kr,t@u.kr", "02-111-2222"), ("우편 또는 방문 제출", "", "", "우편/방문", "", "02-111-2222"),
)


def _apply() -> Column:
    detail = F.map_from_arrays(F.array(F.lit("이메일"), F.lit("전화번호"), F.lit("이름")), F.array(HOW.col(1), F.lit("02-111-2222"), F.col("k").cast("string")))
    return extract.extract_apply(HOW.col(0), detail, HOW.col(2), "")


@query(f"SELECT k, {HOW.sql(3)} AS methods, {HOW.sql(4)} AS emails, {HOW.sql(5)} AS phones, CAST(k AS VARCHAR) AS person FROM p")
def ex15_apply(spark, d):
    x = parts(spark, d).select("k", _apply().alias("a"))
    return x.select("k", listed(F.col("a.methods")).alias("methods"), listed(F.col("a.emails")).alias("emails"), listed(F.col("a.phones")).alias("phones"), F.col("a.contact")["이름"].alias("person"))


MORE = Cases(  # section on applying: methods after all, address added, key lines
    ("[신청방법]\n수출e음 홈페이지 신청\n기타 줄", "수출e음 온라인 신청", "", "수출e음 홈페이지 신청"), ("접수: m@n.kr\n제출 | 기간 | 표", "이메일 제출", "m@n.kr", "접수: m@n.kr"), ("문서24로 제출", "문서24", "", "문서24로 제출"),
)


@query(f"""WITH {PARTS}, x AS (SELECT k, {HOW.sql(3)} AS methods, {HOW.sql(4)} AS emails, {MORE.sql(1)} AS more, {MORE.sql(2)} AS address, {MORE.sql(3)} AS keys FROM p)
SELECT k, array_to_string(list_filter([CASE WHEN methods = '공고문 참조' THEN NULL ELSE methods END, CASE WHEN contains(methods, more) THEN NULL ELSE more END], lambda v: v IS NOT NULL), ',') AS methods,
CASE WHEN address = '' THEN emails WHEN emails = '' THEN address ELSE emails || ',' || address END AS emails, keys AS doc_lines FROM x""")
def ex16_enrich_apply(spark, d):
    sections = F.array(F.struct(F.lit(4).alias("seq"), F.lit("신청방법·접수").alias("name"), MORE.col(0).alias("text")))
    x = parts(spark, d).select("k", _apply().alias("a"), sections.alias("s")).select("k", extract.enrich_apply(F.col("a"), F.col("s"), F.lit("")).alias("a"))
    return x.select("k", listed(F.col("a.methods")).alias("methods"), listed(F.col("a.emails")).alias("emails"), listed(F.col("a.doc_lines")).alias("doc_lines"))


# --- records -------------------------------------------------------------------------------------------------------


def _records(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notices, documents, document sections) of the parts."""
    x = parts(spark, d).withColumn("project_no", F.col("k").cast("string"))
    part = lambda seq, name, c: F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("name"), c.alias("text"))
    notices = x.select(
        "project_no", F.when(F.col("k") % 2 == 0, "bizinfo").otherwise("jexport").alias("source"), F.when(F.col("k") % 3 == 0, F.lit("[경기] 통번역 물류비 지원")).otherwise("통번역 통번역 지원").alias("title"), F.lit("부산광역시 · 부서").alias("subtitle"),
        F.lit("접수중").alias("status"), F.concat(F.lit("2026-11-01 ~ 2026-12-"), _two(F.col("k") % 28 + 1)).alias("period"), F.create_map(F.lit("이메일"), F.lit("a@b.kr")).alias("contact"),
        F.array(part(0, "지원대상", F.lit("화장품 수출 중소기업이라면 누구나 신청할 수 있습니다")), part(1, "지원방법", F.lit("이메일 접수")), part(2, "지원내용", F.concat(F.lit("기업당 최대 "), F.col("k") % 90 + 10, F.lit("만원")))).alias("sections"),
    )
    docs = x.select("project_no", F.explode(F.array(F.lit(0), F.lit(1))).alias("doc_seq"), "k").select("project_no", "doc_seq", F.lit("f.hwp").alias("file_name"), F.when((F.col("doc_seq") == 1) & (F.col("k") % 5 == 0), "예산 소진 시 마감 02-333-4444").otherwise("수출 지원").alias("text"), F.lit(0).alias("n_tables"))
    sections = x.select(F.col("project_no").alias("doc_id"), F.array(part(4, "신청방법·접수", F.lit("문서24로 제출"))).alias("sections"))
    return notices, docs, sections


_RECORD = """r AS (SELECT CAST(k AS VARCHAR) AS project_no, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 3 = 0 THEN '경기' ELSE '부산' END END AS region, CASE WHEN k % 3 = 0 THEN '경기' WHEN k % 2 = 0 THEN '부산' ELSE '' END AS regions,
CASE WHEN k % 3 = 0 THEN '통번역,물류비' ELSE '통번역' END AS fields, '화장품(뷰티)' AS industries, CAST(k % 90 + 10 AS DOUBLE) AS top, '이메일 제출,문서24' AS methods, '2026-12-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') AS receipt_end, CAST(CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS early_close,
CASE WHEN k % 3 = 0 THEN '통번역/물류비' ELSE '통번역' END || ' | 최대 ' || (k % 90 + 10) || '만원 | 대상:화장품(뷰티) | ~2026-12-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') AS summary FROM p)"""


@query(f"WITH {PARTS}, {_RECORD} SELECT * FROM r")
def ex19_records(spark, d):
    x = extract.build_records(*_records(spark, d))
    return x.select("project_no", "region", listed(F.col("target.regions")).alias("regions"), listed(F.transform("fields", lambda f: f["field"])).alias("fields"), listed(F.col("target.industries")).alias("industries"), F.col("amount.max_manwon").alias("top"), listed(F.col("apply.methods")).alias("methods"), "receipt_end", "early_close", "summary")


@query(f"WITH {PARTS}, {_RECORD} SELECT project_no, coalesce(region, 'old') AS region, regions, summary FROM r")
def jo10_reanalyze(spark, d):
    notices, docs, sections = _records(spark, d)
    stale = extract.build_records(notices, docs, sections).withColumn("region", F.lit("old")).withColumn("summary", F.lit("old")).withColumn("target", F.col("target").withField("regions", F.array(F.lit("old"))))
    x = extract.reanalyze(stale, docs, sections)
    return x.select("project_no", "region", listed(F.col("target.regions")).alias("regions"), "summary")


@query(f"""SELECT CAST(k AS VARCHAR) AS project_no, 'a@b.kr' AS emails, CASE WHEN k % 5 = 0 THEN '02-333-4444' ELSE '' END AS phones, '2027-01-10' AS deadline, 26 AS d_day, '첫째 ' || k || '  (※ 단서);둘째' AS items FROM p""")
def ex18_summarize(spark, d):
    notices, docs, _ = _records(spark, d)
    page = notices.withColumn("sections", F.array(F.struct(F.lit(0).alias("seq"), F.lit("문의").alias("name"), F.lit("a@b.kr").alias("text"))))
    x = lines.schedule(_lines(spark, d), NOW), lines.requirements(_lines(spark, d))
    y = extract.summarize_notice(page, *x, docs)
    return y.select("project_no", listed(F.col("all_emails")).alias("emails"), listed(F.col("all_phones")).alias("phones"), F.col("next_deadline.end").alias("deadline"), "next_deadline.d_day", F.array_join(F.element_at("requirements", 1)["items"], ";").alias("items"))


# --- sources -------------------------------------------------------------------------------------------------------


@query("SELECT CAST(k AS VARCHAR) AS project_no, CASE WHEN k % 3 > 0 THEN '통번역' || k END AS field, CASE WHEN k % 4 > 0 THEN CAST(k AS DOUBLE) END AS top FROM p")
def io1_decode(spark, d):
    x = parts(spark, d).select(F.col("k").cast("string").alias("project_no"), F.when(F.col("k") % 3 > 0, F.concat(F.lit('[{"field":"통번역'), F.col("k"), F.lit('","score":9.5,"evidence":["a"]}]'))).alias("fields_json"), F.when(F.col("k") % 4 > 0, F.concat(F.lit('{"max_manwon":'), F.col("k"), F.lit("}"))).alias("amount_json"))
    return store.decode_notices(x).select("project_no", F.try_element_at("fields", F.lit(1))["field"].alias("field"), F.col("amount.max_manwon").alias("top"))


@query("SELECT CAST(k AS VARCHAR) AS id, '<' || name || '> & \"' || k || '\"' AS title, CASE WHEN k % 2 = 0 THEN '2026' ELSE 'a ~ b' END AS period FROM p UNION ALL SELECT k || 'b', 'b', 'c ~ ' FROM p WHERE k % 3 = 0")
def io2_listing(spark, d):
    first = F.struct(F.col("k").cast("string").alias("SP_SEQ"), F.concat(F.lit(" &lt;"), "name", F.lit("&gt;  &amp; &quot;"), F.col("k"), F.lit("&quot;")).alias("js_title"), F.when(F.col("k") % 2 == 0, "2026").otherwise(" ").alias("SGI"), F.lit("a").alias("start_dt"), F.lit("b").alias("end_dt"))
    second = F.struct(F.concat(F.col("k"), F.lit("b")).alias("SP_SEQ"), F.when(F.col("k") % 3 == 0, "b").otherwise(" ").alias("js_title"), F.lit(None).cast("string").alias("SGI"), F.lit("c").alias("start_dt"), F.lit(None).cast("string").alias("end_dt"))
    x = parts(spark, d).select(F.to_json(F.struct(F.array(first, second).alias("data"))).alias("payload"))
    return store.read_listing_json(x).select("id", "title", "period")


@query("""WITH c AS (SELECT c_custkey AS k, c_name, c_acctbal FROM customer)
SELECT c_name AS name, CASE WHEN k % 2 = 0 THEN '전북' ELSE '전남' END AS region, '중소기업' AS size, k % 3 = 0 AS listed, CASE WHEN k % 2 = 0 THEN '농수산,공예품' ELSE '의료기기' END AS industries, CASE WHEN k % 5 = 0 THEN 0.0 ELSE c_acctbal END AS export_usd, k % 4 <> 0 AS direct_export, '통번역,물류비' AS needs FROM c WHERE k % 7 > 0""")
def io3_profiles(spark, d):
    c = read(spark, d, "customer").withColumn("k", F.col("c_custkey"))
    wide = c.select(
        F.when(F.col("k") % 7 > 0, F.concat(F.lit(" "), "c_name")).alias("기업명 "), F.lit("1").alias("사업자번호"), F.when(F.col("k") % 2 == 0, "전북").otherwise(" ").alias("소재지(시·도)"), F.lit("전남").alias("소재지(전남/광주/기타)"), F.when(F.col("k") % 3 == 0, F.lit("예")).otherwise("N").alias("상장여부(Y/N)"),
        F.when(F.col("k") % 2 == 0, "공예, 농산").otherwise("의료").alias("업종 (복수)"), F.when(F.col("k") % 5 == 0, F.lit("없음")).otherwise(F.col("c_acctbal").cast("string")).alias("전년도 수출실적(USD)"), F.when(F.col("k") % 4 == 0, F.lit("N")).otherwise(F.lit(None)).cast("string").alias("직수출(Y/N)"), F.lit("통번역, ,물류비").alias("필요 지원분야(쉼표구분)"),
    )
    return store.import_profiles(wide).select("name", "region", "size", "listed", listed(F.col("industries")).alias("industries"), "export_usd", "direct_export", listed(F.col("needs")).alias("needs"))


@query("SELECT o_custkey AS project_no, o_orderkey AS seq, 'old' AS text FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 1, 'new' FROM customer WHERE c_custkey % 3 = 0")
def io5_replace_children(spark, d):
    old = read(spark, d, "orders").select(F.col("o_custkey").alias("project_no"), F.col("o_orderkey").alias("seq"), F.lit("old").alias("text"))
    changed = read(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("project_no"))
    return store.replace_children(old, changed, changed.select("project_no", F.lit(1).cast("long").alias("seq"), F.lit("new").alias("text")))


@query(f"""WITH {PARTS}, {_RECORD} SELECT project_no, CASE WHEN CAST(project_no AS BIGINT) % 3 = 0 THEN '[경기] 통번역 물류비 지원' ELSE '통번역 통번역 지원' END AS title, 2 AS n_documents, '신청방법·접수' AS section, 2 AS n_chunks FROM r""")
def io6_publish(spark, d):
    notices, docs, sections = _records(spark, d)
    records = extract.build_records(notices, docs, sections).withColumn("dup_of", F.lit(None).cast("string"))
    chunks = docs.select("project_no", F.col("doc_seq").alias("seq"), "text")
    made = store.published(records, docs, chunks, NOW, sections)
    n = made["chunks"].groupBy("project_no").agg(F.count("*").alias("n_chunks"))
    return made["notices"].join(n, "project_no").select("project_no", "title", F.size("documents").alias("n_documents"), F.element_at("doc_sections", 1)["name"].alias("section"), "n_chunks")


@query(f"""WITH {PARTS}, {_RECORD} SELECT project_no, CASE WHEN early_close = 1 THEN '예' ELSE '' END AS early_close, replace(fields, ',', ', ') AS fields, industries, replace(regions, ',', '·') AS regions, '최대 ' || CAST(top AS INTEGER) || '만원' AS amount, replace(methods, ',', ', ') AS methods, summary FROM r""")
def io7_notice_report(spark, d):
    records = extract.build_records(*_records(spark, d)).withColumn("detail_url", F.lit(""))
    return store.notice_report(records).select("project_no", "early_close", "fields", "industries", "regions", "amount", "methods", "summary")


@query("SELECT max(o_orderkey) AS id FROM orders")
def io9_last_run(spark, d):
    return store.last_run(read(spark, d, "orders").select(F.col("o_orderkey").alias("id")))
