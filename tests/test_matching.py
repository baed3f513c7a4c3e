"""Tables, linkage, scoring, retrieval, the feed, against plain Python where rules are long."""

import random

from pyspark.sql import functions as F

from noticeloom.operators import link, retrieve, tables
from noticeloom.plans import catalogue
from noticeloom.sources import store

FP = "project_no string, source string, end string, title_grams array<string>, doc_grams array<string>, stems array<string>, regions array<string>, rank_key struct<priority:int,first_seen:string,project_no:string>"


def _same(a, b):
    (_, sa, ea, ta, da, ra_stems, ra, _), (_, sb, eb, tb, db, rb_stems, rb, _) = a, b
    jac = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x and y else 0
    dice = lambda x, y: 2 * len(set(x) & set(y)) / (len(x) + len(y)) if x and y else 0
    if sa == sb or (ea and eb and ea != eb) or (ra and rb and not set(ra) & set(rb)):
        return 0
    ds, ts = jac(da, db), dice(ta, tb)
    if ds >= 0.55:
        return 0.5 + ds / 2
    if set(ra_stems) & set(rb_stems) and ts >= 0.5:
        return 0.7 + ts / 4
    if bool(ra) != bool(rb):
        return 0
    if ts >= 0.86 and (ea or eb):
        return 0.4 + ts / 2
    return 0.3 + (ts + ds) / 4 if ts >= 0.6 and ds >= 0.3 else 0


def test_linkage_is_exact(spark):
    r = random.Random(5)
    rows = []
    for i in range(60):
        base = r.randrange(6)
        grams = lambda k, n, base=base: sorted({f"{k}{base}-{j}" for j in range(n) if r.random() < 0.85} | {f"{k}{r.randrange(50)}"})
        rows.append((f"p{i:02}", f"s{r.randrange(4)}", r.choice(["", "2026-12-01", "2026-12-02"]), grams("t", 9), r.choice([[], grams("d", 30)]), r.choice([[], [f"stem{base}"]]), r.choice([[], [], ["경기"], ["강원", "경기"]]), (r.randrange(3), "", f"p{i:02}")))
    fps = spark.createDataFrame(rows, FP)
    got = {(x.a, x.b): round(x.score, 6) for x in link.pair_score(link.candidate_pairs(fps), fps).collect()}
    want = {(a[0], b[0]): round(s, 6) for a in rows for b in rows if a[7] < b[7] and (s := _same(a, b))}
    assert got == want and len(want) > 20
    of, took = {}, {}
    key = {x[0]: x[7] for x in rows}
    source = {x[0]: x[1] for x in rows}
    for (a, b), _ in sorted(want.items(), key=lambda x: (-x[1], key[x[0][1]], key[x[0][0]])):
        if a not in of and b not in of and b not in took and source[b] not in took.get(a, ()):
            of[b] = a
            took.setdefault(a, set()).add(source[b])
    assert {x.project_no: x.dup_of for x in link.assign_duplicates(link.pair_score(link.candidate_pairs(fps), fps)).collect()} == of


def test_search(spark):
    chunks = spark.createDataFrame([("a", 0, "", "수출 지원 사업"), ("a", 1, "", "물류비 지원"), ("b", 0, "", "교육"), ("c", 0, "", "물류비 지원")], "project_no string, seq int, heading string, text string")
    index = retrieve.build_index(chunks)
    q = spark.createDataFrame([(1, "물류비 지원 물류비", None), (2, "zzz", None), (3, "지원", "a")], "query_id int, question string, project_no string")
    hits = {(x.query_id, x["rank"]): (x.project_no, x.seq) for x in retrieve.search(index, q).collect()}
    assert hits[1, 1] == ("a", 1) and hits[1, 2] == ("c", 0) and not any(k[0] == 2 for k in hits) and {v[0] for k, v in hits.items() if k[0] == 3} == {"a"}


def test_snapshot_diff(spark):
    known = spark.createDataFrame([("1", "s", "접수중", ["a"]), ("2", "s", "접수중", ["a"]), ("3", "s", "접수마감", ["a"]), ("4", "s", "접수중", ["a", "b"]), ("5", "t", "접수중", [])], "project_no string, source string, status string, attachment_names array<string>")
    listing = spark.createDataFrame([("2", "s", ["a"]), ("3", "s", ["a"]), ("4", "s", ["b", "a"]), ("6", "s", [])], "project_no string, source string, attachment_names array<string>")
    ok = spark.createDataFrame([("s",)], "source string")
    got = {r.project_no: r.action for r in tables.snapshot_diff(known, listing, ok).collect()}
    assert got == {"1": "close", "2": "skip", "3": "reopen", "4": "analyze", "5": "none", "6": "analyze"}


def test_profiles_and_listing(spark):
    df = spark.createDataFrame([(" 가나 ", "농산,식품", "예", "물류비, 통번역", ""), (None, "", "", "", "")], "`기업명` string, `업종(쉼표)` string, `상장여부(Y/N)` string, `필요 지원분야(쉼표구분)` string, `소재지(시·도)` string")
    (p,) = store.import_profiles(df).collect()
    assert (p.name, p.industries, p.listed, p.needs, p.region, p.size, p.direct_export) == ("가나", ["농수산", "식품"], True, ["물류비", "통번역"], "전남", "중소기업", True)
    j = spark.createDataFrame([('{"data":[{"SP_SEQ":"9","js_title":"A &amp; B","STS_TXT":"접수중","start_dt":"2026-01-01","end_dt":"2026-02-01"},{"SP_SEQ":"","js_title":"x"}]}',)], "payload string")
    (r,) = store.read_listing_json(j).collect()
    assert (r.id, r.title, r.period) == ("9", "A & B", "2026-01-01 ~ 2026-02-01")


def test_digest_and_batches(spark):
    m = spark.createDataFrame([("s", str(i), 100 - i, i) for i in range(17)], "sub_key string, project_no string, score int, d_day int")
    got = tables.digest_items(m).collect()
    assert len(got) == 15 and {r.n_more for r in got} == {2}
    b = tables.delivery_batches(spark.range(120).select(F.format_string("%03d", "id").alias("sub_key")))
    assert b.count() == 100 and b.agg(F.max("batch")).first()[0] == 4


def test_registered_queries_name_their_columns(spark):
    for name in ("sc_match", "wn8_digest", "jo5_snapshot", "ag1_counts", "fn30_links", "dd4_linkage"):
        df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.columns and df.count() >= 0
