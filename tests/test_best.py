"""The k best matches of each profile through bounds, against ranking every pair."""

import random

from pyspark.sql import functions as F

from noticeloom import lexicon as lex
from noticeloom.operators import score, tables
from noticeloom.plans import matches

TODAY = "2026-11-01"
FIELDS = ["통번역", "물류비", "전시회", "인증", "마케팅", "금융"]
REGIONS = ["전북", "경기", "서울", "부산"]


def _notices(spark, n, seed=3):
    r = random.Random(seed)
    schema = matches._offers(spark, "/root/testdata/sf0.001").schema
    some = lambda values, most: r.sample(values, r.randrange(most + 1))
    rule = lambda chance, text: [(text, "줄")] if r.random() < chance else []
    rows = []
    for i in range(n):
        target = {
            "industries": some(["제조업", "농식품", "화장품"], 2) if r.random() < 0.5 else [], "company_types": r.choice([[], [], [lex.SME], [lex.DISTRIBUTOR]]), "regions": some(REGIONS, 2),
            "excludes": rule(0.1, "상장기업 제외"), "requires": rule(0.1, "직수출 기업"), "prefers": rule(0.2, "베트남 수출기업"), "tiers": rule(0.2, "실적 구간"), "countries": some(["베트남", "미국", "중국"], 1), "text": ["첫 줄"], "basis": None,
        }
        end = None if r.random() < 0.1 else f"2026-{r.choice([10, 11, 11, 11, 12])}-{r.randrange(1, 29):02}"
        amount = {"max_manwon": 1.0, "special_max_manwon": None, "special_countries": some(["베트남"], 1), "rate": None, "evidence": []}
        row = {"project_no": f"p{i:05}", "title": r.choice(["수출 지원", "미국 진출", "베트남 판촉"]), "source": "at", "status": r.choice([lex.OPEN, lex.OPEN, lex.OPEN, "마감"]), "receipt_end": end, "first_seen": TODAY, "summary": "", "detail_url": "", "amount": amount, "early_close": 0,
               "fields": [(f, 5.0, ["줄"]) for f in some(FIELDS, 3)], "target": target, "sections": [(0, "내용", r.choice(["", "소량 수출"]))], "dup_of": None}
        rows.append(row)
    names = {f.name for f in schema["target"].dataType.fields}
    amounts = {f.name for f in schema["amount"].dataType.fields}
    for row in rows:
        row["target"] = {k: v for k, v in row["target"].items() if k in names}
        row["amount"] = {k: v for k, v in row["amount"].items() if k in amounts}
    return spark.createDataFrame([tuple(row[c] for c in schema.names) for row in rows], schema)


def _profiles(spark):
    r = random.Random(4)
    schema = matches._companies(spark, "/root/testdata/sf0.001").schema
    rows = []
    for i in range(12):
        row = {"id": i, "name": f"c{i}", "region": r.choice([*REGIONS, ""]), "size": r.choice(["중소기업", "대기업"]), "listed": r.random() < 0.3, "industries": r.choice([[], ["제조업"], ["농식품"], ["화장품"]]), "target_countries": r.choice(["베트남", "미국", "", "중국"]),
               "export_stage": r.choice(["수출 준비 단계", "수출 초보"]), "export_usd": float(r.choice([0, 40000, 60000])), "direct_export": r.random() < 0.5, "is_overseas_distributor": r.random() < 0.3, "needs": r.sample(FIELDS, r.randrange(4))}
        rows.append(tuple(row[c] for c in schema.names))
    return spark.createDataFrame(rows, schema)


def test_best_matches(spark):
    notices, profiles = _notices(spark, 1500), _profiles(spark)
    columns = ["profile_id", "project_no", "rank", "score", "grade", F.to_json("reasons").alias("reasons")]
    every = score.match(profiles, notices, TODAY).withColumn("lost", F.lit(0))
    want = tables.rank_matches(every).where("eligible AND rank <= 20").select(columns).collect()
    got = score.best_matches(profiles, notices, TODAY).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 200
    n = score.prepare_notices(notices, TODAY)
    n = n.where((n.status == lex.OPEN) & (F.coalesce("d_day", F.lit(0)) >= 0))
    pairs = score.candidate_classes(score.prepare_profiles(profiles), score.classes(n, 20).where("place = 1"), 20)
    assert pairs.count() < 0.5 * every.where("eligible").count()
    assert pairs.select("profile_id", "project_no").distinct().count() == pairs.count()


def test_best_matches_of_one_class_and_of_nothing(spark):
    """A class of all notices: no more than k of it are ranked; empty sides give no rows."""
    one = _notices(spark, 1)
    many = one.withColumn("status", F.lit(lex.OPEN)).withColumn("receipt_end", F.lit("2026-12-20")).crossJoin(spark.range(500)).withColumn("project_no", F.format_string("n%04d", "id")).drop("id")
    n = score.prepare_notices(many, TODAY)
    assert score.classes(n, 20).count() == 20
    got = score.best_matches(_profiles(spark), many, TODAY, k=7).groupBy("profile_id").agg(F.min("project_no"), F.max("project_no"), F.max("rank")).collect()
    assert got and all(tuple(x)[1:] == ("n0000", "n0006", 7) for x in got)
    assert score.best_matches(_profiles(spark), many.limit(0), TODAY).count() == 0
    assert score.best_matches(_profiles(spark).limit(0), many, TODAY).count() == 0
