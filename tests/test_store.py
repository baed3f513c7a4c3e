"""Reports, publishing, runs and answers, end to end on a few notices."""

from noticeloom.operators import retrieve, score
from noticeloom.sources import store
from tests.test_reasons import NOTICE, PROFILE, _notice


def test_reports_of_matches_and_alerts(spark):
    notices = spark.createDataFrame([_notice("1", {"regions": ("제목", "줄")}), _notice("2", None)], NOTICE)
    profiles = spark.createDataFrame([("in", "가", "경기", "중소기업", False, True, False, ["식품"], [], "", None, ""), ("out", "나", "서울", "중소기업", False, True, False, [], [], "", None, "")], PROFILE)
    matches = score.match(profiles, notices, "2026-01-01")
    rows = {(r["name"], r["project_no"]): r for r in store.match_report(matches).collect()}
    assert len(rows) == 4 and {r["rank"] for r in rows.values()} == {1, 2}
    assert "(+10) 지역 요건 충족 (경기, 제목 기준)" in rows["가", "1"]["reasons"].split("\n") and rows["가", "1"]["notes"] == ""
    assert rows["나", "1"]["score"] == 0 and rows["나", "1"]["notes"].startswith("지역 요건 불일치")
    alerts = spark.createDataFrame([("p", "1", "가", "신규", "t1", 80, None, "u1"), ("p", "2", "가", "마감", "t2", 75, 3, "u2"), ("p", "3", "가", "마감", "t3", 90, 3, "u3")], "profile_id string, project_no string, name string, kind string, title string, score int, d_day int, detail_url string")
    assert [r.title for r in store.alert_report(alerts).collect()] == ["t3", "t2", "t1"]


def test_stored_notices_runs_and_published_tables(spark, tmp_path):
    spark.createDataFrame([("1", '[{"field": "전시", "score": 7.5, "evidence": ["줄"]}]', None)], "project_no string, fields_json string, amount_json string").write.parquet(f"{tmp_path}/n")
    (r,) = store.read_notices(spark, f"{tmp_path}/n").collect()
    assert r.fields[0].field == "전시" and r.fields[0].evidence == ["줄"] and r.amount is None
    for i in (1, 2):
        store.append_run(spark, f"{tmp_path}/runs", {"id": i, "started_at": "a", "finished_at": "b", "n_list": i, "n_new": 0, "n_analyzed": 0, "log": ""})
    assert store.last_run(spark.read.parquet(f"{tmp_path}/runs")).first().n_list == 2
    notices = spark.createDataFrame([("1", "s", "t", "접수중", None, None), ("2", "s", "t", "접수마감", "2025-12-20", None), ("3", "s", "t", "접수마감", "2025-01-01", None), ("4", "s", "t", "접수중", None, "1")], "project_no string, source string, title string, status string, receipt_end string, dup_of string")
    documents = spark.createDataFrame([("1", "a.pdf", "본문", 1), ("3", "b.pdf", "본문", 0)], "project_no string, file_name string, text string, n_tables int")
    chunks = spark.createDataFrame([(p, 0, "", "x") for p in "123"], "project_no string, seq int, heading string, text string")
    sections = spark.createDataFrame([], "doc_id string, sections array<struct<seq:int,name:string,text:string>>")
    store.publish(notices, documents, chunks, "2026-01-01", sections, f"{tmp_path}/out")
    read = lambda name: spark.read.json(f"{tmp_path}/out/{name}").collect()
    assert {r.project_no for r in read("chunks")} == {"1", "2"} and {"1", "2"} <= {r.project_no for r in read("notices")}
    assert (read("metrics")[0].count_open, read("metrics")[0].count_dups, read("metrics")[0].count_total) == (1, 1, 4)


def test_answers_and_notice_ranking_with_a_profile(spark):
    notices = spark.createDataFrame([
        ("1", "수출 물류비 지원", "요약", "2026-01-01", "2026-02-01", "접수중", (500.0, None, [], None, ["최대 500만원 지원", "한도 안내"]), (["온라인"], ["a@b.kr"], [], [], [], {}), None),
        ("2", "전시회 참가", "요약", "2026-01-01", None, "접수중", None, ([], [], [], [], [], {}), None),
    ], "project_no string, title string, summary string, receipt_start string, receipt_end string, status string, amount struct<max_manwon:double,special_max_manwon:double,special_countries:array<string>,rate:int,evidence:array<string>>, apply struct<methods:array<string>,emails:array<string>,phones:array<string>,lines:array<string>,doc_lines:array<string>,contact:map<string,string>>, dup_of string")
    chunks = spark.createDataFrame([("1", 0, "지원내용", "물류비를 최대 500만원까지 지원합니다\n다른 줄 내용입니다"), ("2", 0, "지원내용", "해외 전시회 부스 임차료를 지원합니다")], "project_no string, seq int, heading string, text string")
    queries = spark.createDataFrame([("q", "물류비 얼마나 지원? 010-1234-5678", None), ("none", "zzz", None)], "query_id string, question string, project_no string")
    index = retrieve.build_index(chunks)
    got = {r.query_id: r for r in retrieve.answer(queries, index, chunks, notices).collect()}
    assert got["none"].mode == "none" and got["none"].fact is None and got["none"].lines is None
    a = got["q"]
    assert a.mode == "extract" and a.masked_question == "물류비 얼마나 지원? 010-****-****" and a.fact.startswith("📌 수출 물류비 지원 — 접수 2026-01-01 ~ 2026-02-01")
    assert a.evidence == ["최대 500만원 지원", "한도 안내"] and a.lines[0] == "- 물류비를 최대 500만원까지 지원합니다 [근거 1]"
    plain = {(r.query_id, r.project_no): r.score for r in retrieve.search_notices(queries, index, chunks, notices).collect()}
    fits = spark.createDataFrame([("1", 50, False), ("2", 50, True)], "project_no string, score int, eligible boolean")
    fit = {(r.query_id, r.project_no): r.score for r in retrieve.search_notices(queries, index, chunks, notices, fits).collect()}
    assert abs(fit["q", "1"] - 0.3 * plain["q", "1"]) < 1e-5
    assert ("q", "2") not in plain or abs(fit["q", "2"] - 1.1 * plain["q", "2"]) < 1e-5
