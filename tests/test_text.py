"""Scalar functions on Korean rows; expected values follow the rules by hand."""

import pytest
from pyspark.sql import functions as F

from noticeloom.functions import text as tx
from noticeloom.operators import extract
from noticeloom.plans.catalogue import LATIN


def one(spark, value, f):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("title", "region"),
    [
        ("[경기] 수출기업 모집", "경기"), ("강원 글로벌 점프업 패키지 지원사업", "강원"), ("2026년 김제시 수출사다리", "전북"), ("부산지역 중소기업 지원", "부산"),
        ("[천안·아산] 설명회", "충남"), ("수출 지원 (전남광주)", "전남"), ("부산 국제 전시회 참가", None), ("", None), (None, None),
    ],
)
def test_title_region(spark, title, region):
    assert one(spark, title, tx.title_region) == region


def test_industries(spark):
    hit = lambda t, body=False: one(spark, t, lambda c: tx.rule_hits(c, body)["industries"])
    assert hit("농식품 수출") == ["농수산", "식품"]
    assert hit("소비재 수출") == ["식품", "화장품(뷰티)", "공예품", "생활용품(소비재)"]
    assert hit("식품소비재") == ["식품"]
    assert hit("AI 활용 마케팅") == []
    assert hit("부품 기업", True) == [] and hit("부품 기업") == ["기타 공산품"]
    assert one(spark, "농산,공산품/뷰티", lambda c: tx.normalize_industries(tx.split_industries(c)))[:2] == ["농수산", "화장품(뷰티)"]


def test_period_and_days(spark):
    period = lambda t: tuple(str(x) if x else None for x in one(spark, t, tx.parse_period))
    assert period("2026-11-01 ~ 2026-12-10") == ("2026-11-01", "2026-12-10")
    assert period("26.11.01~26.12.10") == ("2026-11-01", "2026-12-10")
    assert period("2026.1.5 까지") == ("2026-01-05", None)
    assert period("2026-13-40") == (None, None)
    assert one(spark, "2026-12-04T10:00", lambda c: tx.d_day(c, "2026-11-27")) == 7
    assert [one(spark, "x", lambda c, d=d: tx.dday_label(F.lit(d).cast("int"))) for d in (0, 3, -2, None)] == ["D-Day", "D-3", "D+2", "-"]


def test_mask(spark):
    assert one(spark, "123-45-67890 900101-1234567 010-1234-5678 01012345678 a.b@c.kr", tx.mask) == "***-**-***** ******-******* 010-****-**** 010-****-**** ***@***"
    assert one(spark, "가123-45-67890", tx.mask) == "가123-45-67890"


def test_title_keys(spark):
    assert one(spark, "[재공고] 2026년 미국 관세정책 대응 심층컨설팅 지원사업 공고", tx.norm_title) == "미국관세정책대응심층컨설팅"
    assert one(spark, "2026년 수출바우처 안내문.hwpx", tx.file_stem) == "수출바우처안내문" and one(spark, "ab.pdf", tx.file_stem) == ""
    assert one(spark, "ab cde f", tx.bigrams) == ["ab", "cd", "de", "f"]
    assert one(spark, "a", lambda c: tx.char_ngrams(c, 2)) == [] and one(spark, "aaa", lambda c: tx.char_ngrams(c, 2)) == ["aa"]


def test_small_things(spark):
    assert one(spark, "중국, 베트남", tx.country_groups) == ["동남아", "중화권"]
    assert one(spark, "aaaa", lambda c: tx.count_literal(c, "aa")) == 2
    assert one(spark, "- ○ x", tx.strip_bullet) == "x" and one(spark, " - ", tx.strip_bullet) == "-"
    assert one(spark, "경기도 소재 기업", tx.target_region)["region"] == "경기"
    assert one(spark, "부산 소재 행사장 개최", tx.target_region)["region"] is None
    assert one(spark, "김제시", tx.sido_of) == "전북" and one(spark, "KOTRA-1", tx.source_of) == "kotra" and one(spark, "X", tx.source_of) == "jexport"
    assert one(spark, "1,000", lambda c: tx.to_manwon(c, F.lit("백만"))) == 100000.0
    assert one(spark, "예산  소진 시", lambda c: tx.early_close(c, F.lit(""))) is True
    assert one(spark, "HOME", lambda c: tx.normalize_industries(F.array(c), LATIN)) == ["FURNITURE", "HOUSEHOLD"]
    assert one(spark, "a", lambda c: tx.dice(F.array(c), F.array(c, F.lit("b")))) == pytest.approx(2 / 3)


def test_amount_text(spark):
    a = spark.range(1).select(F.struct(F.lit(300.0).alias("max_manwon"), F.lit(1500.0).alias("special_max_manwon"), F.lit(70).alias("rate")).alias("a"))
    assert a.select(tx.amount_text(F.col("a"))).first()[0] == "최대 300만원 (특례 15백만원) · 70% 이내"


def test_what_a_rule_reads_is_worked_out_once(spark):
    """Inside a lambda an expression is worked out for every element; each use of one that is not bound repeats it."""
    said = str(tx.in_order(F.reverse(F.col("found")), ("a", "b", "c")))
    assert said.index("reverse(") < said.index("filter(")
    said = str(extract.extract_target(F.col("title"), F.upper(F.col("target")), F.reverse(F.col("page")), F.col("doc"), F.col("own"))).lower()
    assert said.count("upper(") == said.count("reverse(") == 1
    assert said.count("rlike") <= 34 and said.count("regexp") <= 30  # 89 and 308 without


def test_word_lists_do_not_make_the_plan_grow(spark):
    said = str(extract.extract_fields(F.col("title"), F.col("page"), F.col("doc")))
    assert said.count("replace(") <= 4  # one for each text and its lines, not for each word
    row = spark.createDataFrame([("통번역 통번역 지원", "운임\n특송 물류비 안내", "")], "title string, page string, doc string")
    got = row.select(extract.extract_fields(F.col("title"), F.col("page"), F.col("doc")).alias("f")).first()["f"]
    assert [(f.field, f.score, f.evidence) for f in got] == [("통번역", 48.0, ["통번역 통번역 지원"]), ("물류비", 16.0, ["특송 물류비 안내", "운임"])]
    one = LATIN.__class__(fields={"a'b\\c": {"it's": 2, "\\": 1}})
    got = spark.createDataFrame([("it's it's",)], "t string").select(extract.extract_fields(F.col("t"), F.lit(""), F.lit(""), one).alias("f")).first()["f"]
    assert [(f.field, f.score) for f in got] == [("a'b\\c", 16.0)]
