"""Texts and evidence of the region and industry rules, with and without a basis."""

from noticeloom.operators import score

RULES = "array<struct<rule:string,evidence:string>>"
TARGET = f"struct<industries:array<string>,company_types:array<string>,regions:array<string>,excludes:{RULES},requires:{RULES},prefers:{RULES},tiers:{RULES},countries:array<string>,text:array<string>,basis:map<string,struct<from:string,evidence:string>>>"
NOTICE = f"project_no string, title string, source string, status string, receipt_end string, first_seen string, summary string, detail_url string, early_close int, dup_of string, fields array<struct<field:string,score:double,evidence:array<string>>>, target {TARGET}, amount struct<max_manwon:double,special_max_manwon:double,special_countries:array<string>,rate:int,evidence:array<string>>, sections array<struct<seq:int,name:string,text:string>>"
PROFILE = "id string, name string, region string, size string, listed boolean, direct_export boolean, is_overseas_distributor boolean, industries array<string>, needs array<string>, target_countries string, export_usd double, export_stage string"


def _notice(no, basis, requires=()):
    target = (["식품"], [], ["경기"], [], list(requires), [], [], [], ["모집 대상 문장"], basis)
    return (no, "t", "s", "접수중", None, "d", "", "u", 0, None, [], target, None, [])


def test_basis_and_evidence_of_regions_and_industries(spark):
    full = {"regions": ("제목", "[경기] 문장"), "industries": ("신청자격", "식품 기업 문장")}
    notices = spark.createDataFrame([_notice("1", full), _notice("2", None), _notice("3", {}, [("본사 소재", "본사 문장")])], NOTICE)
    profiles = spark.createDataFrame([("in", "a", "경기", "중소기업", False, True, False, ["식품"], [], "", None, ""), ("out", "b", "서울", "중소기업", False, True, False, ["뷰티"], [], "", None, "")], PROFILE)
    got = {(r.profile_id, r.project_no): r for r in score.match(profiles, notices, "2026-01-01").collect()}
    texts = lambda r, c, word: [(x["text"], x["evidence"]) for x in r[c] if word in x["text"]]
    assert texts(got["in", "1"], "reasons", "지역") == [("지역 요건 충족 (경기, 제목 기준)", "[경기] 문장")]
    assert texts(got["in", "1"], "reasons", "업종") == [("업종 일치: 식품, 신청자격 기준", "식품 기업 문장")]
    assert texts(got["out", "1"], "fails", "지역") == [("지역 요건 불일치 (공고: 경기, 제목 기준 / 기업: 서울)", "[경기] 문장")]
    (industry,) = texts(got["out", "1"], "fails", "업종")
    assert industry[0].startswith("업종 불일치 (공고: 식품, 신청자격 기준 / 기업: ") and industry[1] == "식품 기업 문장"
    assert texts(got["in", "2"], "reasons", "지역") == [("지역 요건 충족 (경기)", "")] and texts(got["in", "2"], "reasons", "업종") == [("업종 일치: 식품", "모집 대상 문장")]
    assert texts(got["in", "3"], "reasons", "지역") == [("지역 요건 충족 (경기)", "본사 문장")]
