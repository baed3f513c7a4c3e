"""Line-level extraction, sections, chunks, metadata."""

import pytest
from pyspark.sql import functions as F

from noticeloom.operators import extract, html, lines

TODAY = "2026-11-27"


def doc(spark, *texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, line_no int, text string")


def test_key_values_and_sections(spark):
    d = doc(spark, "1. 사업 개요", "가. 목적", "○ 사업명 : 수출 지원", "- 하나", "- 둘", "※ 참고", "본문", "지원대상: 중소기업")
    rows = lines.key_values(d).orderBy("line_no").collect()
    assert [(r.key, r.value, r["items"], r.section, r.subsection) for r in rows] == [("사업명", "수출 지원", ["하나", "둘", "※ 참고"], "1. 사업 개요", "가. 목적"), ("지원대상", "중소기업", [], "1. 사업 개요", "가. 목적")]
    assert {(r.topic, r.key) for r in lines.topics(lines.key_values(d)).collect()} == {("사업명", "사업명"), ("지원대상", "지원대상")}


def test_schedule(spark):
    d = doc(spark, "접수기간 : 2026.12.20(일) ~ 1.10(일) 18:00", "2026. 12. ~ 2027. 1.", "2026.13.1 ~ 2026.14.2", "신청 2026-11-01 ~ 2026-11-20")
    rows = lines.schedule(d, TODAY).orderBy("line_no").collect()
    assert [(r.start, r.end, r.time, r.label, r.status) for r in rows] == [("2026-12-20", "2027-01-10", "18:00", "접수기간", "예정"), ("2026-11-01", "2026-11-20", "", "", "마감")]
    assert [(r.start, r.end) for r in lines.month_ranges(d).collect()] == [("2026-12", "2027-1".replace("-1", "-01"))]


def test_requirements(spark):
    d = doc(spark, "지원조건", "바깥 줄", "- 첫째", "※ 단서", "1) 둘째", "끝", "- 아님", "자격요건", "없음")
    (r,) = lines.requirements(d).collect()
    assert r.title == "지원조건" and r["items"] == ["첫째  (※ 단서)", "둘째"]


def test_numbers_forms_pick(spark):
    d = doc(spark, "최대 3백만원, 70% 지원", "30㎡ 이상", "붙임 2 「신청서」 1부", "지원내용 안내", "- 상세", "- 더", "- 셋")
    assert {(r.kind, r.value, r.unit) for r in lines.numbers(d).collect()} == {("money", "3", "백만원"), ("percent", "70", "%"), ("area", "30", "㎡")}
    assert [(r.no, r.title) for r in lines.forms(d).collect()] == [(2, "신청서")]
    assert lines.pick_lines(d, "지원내용").first().lines == ["지원내용 안내", "  - 상세", "  - 더"]


def test_tables(spark):
    cells = spark.createDataFrame([("d", 1, 0, 0, 0, 1, 2, "이름"), ("d", 1, 1, 1, 0, 1, 1, "a"), ("d", 1, 2, 1, 1, 1, 1, "b")], "doc_id string, table_no int, cell_order int, row int, col int, row_span int, col_span int, text string")
    grid = lines.expand_cells(cells)
    assert grid.count() == 4
    assert lines.inline_tables(doc(spark, "앞", "[표 1]", "뒤 [표 1]"), grid).first().text == "앞\n이름\na | b\n뒤 [표 1]"
    form = spark.createDataFrame([("d", 1, r, c, t) for r in range(3) for c, t in ((0, f"항목{r}"), (1, ""))], "doc_id string, table_no int, row int, col int, text string")
    assert lines.blank_fields(form).first().fields == ["항목0", "항목1", "항목2"]


def test_doc_sections(spark):
    d = doc(spark, "안내문", "1. 사업개요", "수출을 돕는다", "2. 신청방법", "이메일 접수", "【붙임 1】", "3. 기타")
    got = {s.name: s.text for s in extract.doc_sections(d).first().sections}
    assert got == {"공고 안내": "안내문", "사업개요": "[사업개요]\n수출을 돕는다", "신청방법·접수": "[신청방법]\n이메일 접수"}


def test_chunks(spark):
    sections = spark.createDataFrame([("p", 0, "개요", "가나다")], "project_no string, seq int, name string, text string")
    docs = spark.createDataFrame([("p", 0, "f.hwp", "1. 머리\n" + "\n".join(["x" * 300] * 3) + "\n" + "y" * 1200)], "project_no string, doc_seq int, file_name string, text string")
    got = extract.make_chunks(sections, docs).orderBy("seq").collect()
    assert [(r.seq, r.heading, len(r.text)) for r in got] == [(0, "개요", 3), (1, "1. 머리", 300), (2, "1. 머리", 300), (3, "1. 머리", 300), (4, "1. 머리", 500), (5, "1. 머리", 700)]


def test_fields_and_amount(spark):
    df = spark.createDataFrame([("물류비 지원", "기업당 최대 300만원 한도\n지원율 70% 이내\n물류비 운임", "")], "t string, p string, d string")
    r = df.select(extract.extract_fields(F.col("t"), F.col("p"), F.col("d")).alias("f"), extract.extract_amount(F.col("p"), F.col("d")).alias("a")).first()
    assert r.f[0].field == "물류비" and r.f[0].score == 3 * 6 + 2 * 2 and r.f[0].evidence == ["물류비 지원", "물류비 운임"]
    assert (r.a.max_manwon, r.a.rate, r.a.special_max_manwon, r.a.evidence) == (300.0, 70, None, ["기업당 최대 300만원 한도"])


def test_target(spark):
    df = spark.createDataFrame([("[경기] 화장품 수출 지원", "경기도 소재 중소기업\n상장기업 제외\n직수출 기업\n베트남 진출 기업 우선 지원")], "t string, g string")
    t = df.select(extract.extract_target(F.col("t"), F.col("g"), F.lit(""), F.lit(""), F.lit("")).alias("x")).first().x
    assert t.industries == ["화장품(뷰티)"] and t.company_types == ["중소기업"] and t.regions == ["경기"] and t.countries == ["베트남"]
    assert [e.rule for e in t.excludes] == ["상장기업 제외"] and [e.rule for e in t.requires] == ["직수출 기업"] and t.prefers[0].rule == "베트남 진출 기업"


def test_html(spark):
    page = '<table><tr><th>이름 필수</th><td>a <b>b</b></td><td>x</td></tr></table><dl><dt>기간</dt><dd>1</dd></dl><a href="/f?id=7" onclick="go(7)">파일</a><a href="/f?id=7">again</a><script>no</script>'
    p = html.parse_html(spark.createDataFrame([("p", page), ("q", None)], "id string, html string"), "id", "html")
    assert {(r.k, r.v) for r in html.html_key_values(p, "id", "필수").collect()} == {("이름", "a b"), ("기간", "1")}
    assert [(r.file_id, r.text) for r in html.html_links(p, "id", r"id=(\d+)").collect()] == [("7", "파일")]
    assert "no" not in [r.text for r in html.html_lines(p, "id").collect()]


@pytest.mark.parametrize("none", [None, ""])
def test_nothing(spark, none):
    d = spark.createDataFrame([("d", 0, none)], "doc_id string, line_no int, text string")
    assert lines.key_values(d).count() == lines.requirements(d).count() == lines.numbers(d).count() == extract.doc_sections(d).count() == 0
