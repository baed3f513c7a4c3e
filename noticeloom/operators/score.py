"""Rule-scored matching of profiles with notices, alerts and digests.

Each side is prepared once, before the two meet; scoring works row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom import lexicon as lex
from noticeloom.functions import text as tx
from noticeloom.lexicon import KOREAN, Lexicon
from noticeloom.operators import tables
from noticeloom.sources.staging import stage

#: A key that every notice has.
_ANY = "*"

_NO_REASONS = "array<struct<type:string,points:int,text:string,evidence:string>>"
_NO_TEXTS = "array<struct<text:string,evidence:string>>"


def _none(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def prepare_profiles(profiles: DataFrame, lexicon: Lexicon = KOREAN) -> DataFrame:
    """What matching reads of a profile: p_industries, p_compat, p_groups."""
    p = profiles.withColumn("p_industries", tx.normalize_industries(F.col("industries"), lexicon))
    extra = [F.when(F.array_contains("p_industries", name), F.array(*map(F.lit, more))).otherwise(_none()) for name, more in lexicon.compat.items()]
    p = p.withColumn("p_compat", F.array_distinct(F.concat("p_industries", *extra)))
    return p.withColumn("p_groups", tx.country_groups(F.col("target_countries"), lexicon)).withColumnRenamed("id", "profile_id")


def prepare_notices(notices: DataFrame, today: str, lexicon: Lexicon = KOREAN) -> DataFrame:
    """What matching reads of a notice, for open and closed representatives alike."""
    t, join = F.col("target"), lambda c: F.array_join(F.coalesce(c, _none()), " ")
    based = "basis" in notices.schema["target"].dataType.names
    basis = lambda k, part: tx.text(F.try_element_at(t["basis"], F.lit(k))[part]) if based else F.lit("")
    via = lambda k: F.when(basis(k, "from") != "", F.concat(F.lit(", "), basis(k, "from"), F.lit(" 기준"))).otherwise("")
    first_text = F.coalesce(F.try_element_at(t["text"], F.lit(1)), F.lit(""))
    seated = F.try_element_at(F.filter(t["requires"], lambda r: r["rule"].contains("본사")), F.lit(1))["evidence"]
    return tables.representatives(notices).select(
        "project_no", "title", "source", "status", "receipt_end", "first_seen", "summary", "detail_url", "amount", "early_close",
        F.coalesce("fields", _none("array<struct<field:string,score:double,evidence:array<string>>>")).alias("fields"),
        F.coalesce(t["regions"], _none()).alias("n_regions"), F.coalesce(t["company_types"], _none()).alias("types"),
        *(F.coalesce(t[k], _none("array<struct<rule:string,evidence:string>>")).alias(k) for k in ("excludes", "requires", "prefers", "tiers")),
        tx.normalize_industries(t["industries"], lexicon).alias("n_industries"),
        tx.country_groups(F.concat(join(t["countries"]), F.lit(" "), tx.text(F.col("title"))), lexicon).alias("n_groups"),
        tx.country_groups(join(F.col("amount.special_countries")), lexicon).alias("special_groups"),
        first_text.alias("first_text"), via("regions").alias("region_via"), via("industries").alias("industry_via"),
        F.coalesce(F.nullif(basis("regions", "evidence"), F.lit("")), seated, F.lit("")).alias("region_evidence"),
        F.coalesce(F.nullif(basis("industries", "evidence"), F.lit("")), first_text).alias("industry_evidence"),
        tx.d_day(F.col("receipt_end"), today).alias("d_day"),
        F.concat(join(F.transform(F.coalesce("sections", _none("array<struct<seq:int,name:string,text:string>>")), lambda s: s["text"])), tx.text(F.col("title"))).alias("all_text"),
    )


def hard_fails() -> Column:
    """Array of (text, evidence): why a profile may not apply."""
    c = F.col
    fail = lambda when, text, evidence=F.lit(""): F.when(when, F.struct(text.alias("text"), evidence.alias("evidence")))
    rule = lambda name, word: F.filter(name, lambda x: x["rule"].contains(word))
    listed = F.transform(rule("excludes", "상장"), lambda x: F.struct(F.lit("상장기업은 지원 제외").alias("text"), x["evidence"].alias("evidence")))
    direct = F.transform(rule("requires", "직수출"), lambda x: F.struct(F.lit("직수출 기업만 지원 (현재 간접수출)").alias("text"), x["evidence"].alias("evidence")))
    has = lambda col, x: F.array_contains(col, x)
    region_off = (F.size("n_regions") > 0) & (tx.text(c("region")) != "") & ~F.array_contains(c("n_regions"), tx.text(c("region")))
    industry_off = (F.size("n_industries") > 0) & (F.size("p_industries") > 0) & ~F.arrays_overlap("p_compat", "n_industries")
    return F.concat(
        F.array_compact(F.array(
            fail(~tx.text(c("status")).contains(lex.OPEN) | (F.coalesce(c("d_day"), F.lit(0)) < 0), F.concat(F.lit("접수 마감 ("), F.coalesce("receipt_end", "status", F.lit("")), F.lit(")"))),
            fail(region_off, F.concat(F.lit("지역 요건 불일치 (공고: "), F.array_join("n_regions", "·"), c("region_via"), F.lit(" / 기업: "), tx.text(c("region")), F.lit(")")), c("region_evidence")),
        )),
        F.when(F.coalesce(c("listed"), F.lit(False)), listed).otherwise(_none(_NO_TEXTS)),
        F.array_compact(F.array(fail(has("types", lex.SME) & ~has("types", lex.DISTRIBUTOR) & tx.text(c("size")).isin("중견기업", "대기업"), F.concat(F.lit("중소기업 대상 사업 (기업규모: "), tx.text(c("size")), F.lit(")")), c("first_text")))),
        F.when(c("direct_export") == F.lit(False), direct).otherwise(_none(_NO_TEXTS)),
        F.array_compact(F.array(fail(industry_off, F.concat(F.lit("업종 불일치 (공고: "), F.array_join("n_industries", "·"), c("industry_via"), F.lit(" / 기업: "), F.array_join("p_industries", "·"), F.lit(")")), c("industry_evidence")))),
    )


def reasons() -> Column:
    """Array of (type, points, text, evidence) whose points add up to the soft score."""
    c = F.col
    plus = lambda points, text, evidence=F.lit(""): F.struct(F.lit("+").alias("type"), (points if isinstance(points, Column) else F.lit(points)).cast("int").alias("points"), text.alias("text"), tx.text(evidence).alias("evidence"))
    zero = lambda text: F.struct(F.lit("-").alias("type"), F.lit(0).alias("points"), text.alias("text"), F.lit("").alias("evidence"))
    names = F.transform("fields", lambda f: f["field"])
    needs = F.coalesce(c("needs"), _none())
    hit = F.filter(names, lambda n: F.array_contains(needs, n))
    shown = lambda a: F.array_join(F.array_sort(a), ", ")
    evidence = lambda fs: F.try_element_at(F.try_element_at(fs, F.lit(1))["evidence"], F.lit(1))
    hit_fields = F.filter("fields", lambda f: F.array_contains(needs, f["field"]) & (F.size(f["evidence"]) > 0))
    need = (
        F.when(F.size(needs) == 0, plus(20, F.lit("필요 분야 미입력 — 기본 점수")))
        .when((F.size(hit) > 0) & (F.try_element_at(hit, F.lit(1)) == F.try_element_at(names, F.lit(1))), plus(40, F.concat(F.lit("필요 분야 일치: "), F.array_join(hit, ", ")), evidence(c("fields"))))
        .when(F.size(hit) > 0, plus(28, F.concat(F.lit("필요 분야 일부 일치: "), F.array_join(hit, ", ")), evidence(hit_fields)))
        .otherwise(zero(F.concat(F.lit("필요 분야와 다름 (공고 분야: "), F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("미분류")), F.lit(")"))))
    )
    both = (F.size("n_industries") > 0) & (F.size("p_industries") > 0)
    industry = F.when(both & F.arrays_overlap("p_compat", "n_industries"), plus(20, F.concat(F.lit("업종 일치: "), F.array_join(F.filter("n_industries", lambda x: F.array_contains(c("p_compat"), x)), "·"), c("industry_via")), c("industry_evidence"))).when(F.size("n_industries") == 0, plus(12, F.lit("업종 제한 없음")))
    region = F.when((F.size("n_regions") > 0) & F.array_contains(c("n_regions"), tx.text(c("region"))), plus(10, F.concat(F.lit("지역 요건 충족 ("), tx.text(c("region")), c("region_via"), F.lit(")")), c("region_evidence"))).when(F.size("n_regions") == 0, plus(6, F.lit("지역 제한 명시 없음")))
    country = (
        F.when(F.arrays_overlap("p_groups", "n_groups"), plus(10, F.concat(F.lit("희망 수출국 일치: "), shown(F.array_intersect("p_groups", "n_groups"))), c("title")))
        .when(F.size("n_groups") == 0, plus(5, F.lit("국가 제한 없음")))
        .otherwise(zero(F.concat(F.lit("공고 대상 국가: "), shown(c("n_groups")))))
    )
    special = F.when(F.arrays_overlap("p_groups", "special_groups"), plus(5, F.concat(F.lit("희망국("), shown(F.array_intersect("p_groups", "special_groups")), F.lit(") 특례 한도 적용 가능")), F.try_element_at(c("amount.evidence"), F.lit(1))))
    preferred = F.transform(F.filter("prefers", lambda x: F.arrays_overlap(tx.country_groups(x["rule"]), c("p_groups"))), lambda x: plus(5, F.concat(F.lit("우선지원 대상: "), x["rule"]), x["evidence"]))
    d = c("d_day")
    due = F.when(d >= 7, plus(10, F.concat(F.lit("신청 가능 (D-"), d, F.lit(")")))).when(d >= 0, plus(6, F.concat(F.lit("마감 임박 (D-"), d, F.lit(") — 서둘러 신청"))))
    usd = c("export_usd")
    rate = F.when(usd >= 50000, 100).when(usd >= 30000, 50).otherwise(30)
    beginner = tx.text(c("export_stage")).startswith("수출 준비") & _beginners("all_text")
    stage = (
        F.when((F.size("tiers") > 0) & usd.isNotNull(), plus(F.when(rate == 100, 10).otherwise(6), F.concat(F.lit("수출실적 "), F.format_number(F.rint(usd), 0), F.lit("달러 → 지원비율 약 "), rate, F.lit("% 구간")), F.try_element_at("tiers", F.lit(1))["evidence"]))
        .when(beginner, plus(10, F.lit("수출초보·소량수출 기업 적합")))
        .otherwise(plus(7, F.lit("수출단계 제한 없음")))
    )
    return F.concat(F.array_compact(F.array(need, industry, region, country, special)), preferred, F.array_compact(F.array(due, stage)))


def distributor_only() -> Column:
    return F.array_contains("types", lex.DISTRIBUTOR) & ~F.coalesce(F.col("is_overseas_distributor"), F.lit(False))


def warnings() -> Column:
    warn = lambda when, text, evidence=F.lit(""): F.when(when, F.struct(text.alias("text"), evidence.alias("evidence")))
    return F.array_compact(F.array(
        warn(distributor_only(), F.lit("직접 신청 대상은 '해외 유통매장 운영사' — 국내 수출기업은 컨소시엄(입점기업)으로 참여 검토"), F.col("first_text")),
        warn(F.col("d_day").between(0, 6), F.concat(F.lit("마감 임박: D-"), F.col("d_day"))),
        warn(F.coalesce(F.col("early_close").cast("int"), F.lit(0)) > 0, F.lit("예산 소진 시 조기 마감 — 조기 신청 권장")),
    ))


def grade(df: DataFrame) -> DataFrame:
    """Score and grade from reasons and fails: at most 100, 45 for distributors' notices, 0 when not eligible."""
    points = F.aggregate("reasons", F.lit(0), lambda a, r: a + r["points"])
    score = F.least(points, F.when(distributor_only(), 45).otherwise(100))
    df = df.withColumn("eligible", F.size("fails") == 0).withColumn("score", F.when(F.col("eligible"), score).otherwise(0))
    return df.withColumn("grade", F.when(~F.col("eligible"), "부적합").when(F.col("score") >= 80, "적극 추천").when(F.col("score") >= 60, "추천").when(F.col("score") >= 40, "검토").otherwise("낮음"))


def _graded(pairs: DataFrame) -> DataFrame:
    return grade(pairs.withColumn("fails", hard_fails()).withColumn("reasons", reasons()).withColumn("warnings", warnings()))


def match(profiles: DataFrame, notices: DataFrame, today: str, include_ineligible: bool = True, lexicon: Lexicon = KOREAN) -> DataFrame:
    """Every profile with every representative notice, scored; without the ineligible, the two meet on region and
    industry.

    A notice without regions (industries) has the key "", a profile's keys are its own and "", and a profile without
    any meets a key that all notices have: so each pair that fits on both meets once for each industry they share, and
    the first of those is kept."""
    p, n = prepare_profiles(profiles, lexicon), prepare_notices(notices, today, lexicon)
    p = p.withColumnsRenamed({c: f"{c}_of_profile" for c in p.columns if c in n.columns})
    if include_ineligible:
        x = n.crossJoin(p)  # every pair is a row of the result
    else:
        n = n.where(tx.text(F.col("status")).contains(lex.OPEN) & (F.coalesce("d_day", F.lit(0)) >= 0))
        own = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit("")))
        asked = lambda c: F.explode(F.when(F.size(c) > 0, F.array_distinct(F.concat(c, F.array(F.lit(""))))).otherwise(F.array(F.lit(_ANY))))
        n = n.withColumn("__region", F.explode(F.array_distinct(F.concat(own("n_regions"), F.array(F.lit(_ANY)))))).withColumn("__industry", F.explode(F.array_distinct(F.concat(own("n_industries"), F.array(F.lit(_ANY))))))
        region = tx.text(F.col("region"))
        p = p.withColumn("__regions", F.when(region != "", F.array(region)).otherwise(_none())).withColumn("__region", asked("__regions")).withColumn("__wanted", F.when(F.size("p_industries") > 0, F.col("p_compat")).otherwise(_none())).withColumn("__industry", asked("__wanted"))
        first = F.try_element_at(F.filter("n_industries", lambda i: F.array_contains("__wanted", i)), F.lit(1))
        x = n.join(p, ["__region", "__industry"]).where(F.col("__industry").isin("", _ANY) | (F.col("__industry") == first)).drop("__region", "__regions", "__industry", "__wanted")
    x = _graded(x)
    return x if include_ineligible else x.where("eligible")


#: Needs that no field of a notice meets, and a profile without needs, as keys of posting lists.
_NO_HIT, _NO_NEEDS = "", "*"
#: Points of a level of posting lists, and the highest score.
_LEVEL, _MOST = 5, 100


def _beginners(text: str) -> Column:
    return tx.has(F.col(text), r"소량|초보|첫\s*수출|내수")


def classes(prepared: DataFrame, k: int) -> DataFrame:
    """The first ``k`` notices (by deadline and id) of each class: prepared notices with ``class``, the id of its first,
    and ``place`` in it.

    The notices of a class have the same of everything that eligibility and score read, so they tie for every profile
    and none beyond its first k is among any profile's k best."""
    rule = lambda name, word: F.exists(name, lambda x: x["rule"].contains(word))
    alike = [
        "n_regions", "n_industries", "n_groups", "special_groups", F.transform("fields", lambda f: f["field"]), F.transform("prefers", lambda x: tx.country_groups(x["rule"])),
        F.when(F.col("d_day") >= 7, 2).when(F.col("d_day") >= 0, 1), F.size("tiers") > 0, _beginners("all_text"), F.array_contains("types", lex.DISTRIBUTOR), F.array_contains("types", lex.SME), rule("excludes", "상장"), rule("requires", "직수출"),
    ]
    w = Window.partitionBy(*alike).orderBy(F.coalesce("d_day", F.lit(9999)), "project_no")
    return prepared.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("class", F.first("project_no").over(w))


def postings(firsts: DataFrame) -> DataFrame:
    """Posting lists of classes by need and region: ``__need``, ``__region``, and ``__bound``, the most points that any
    profile of that list can have."""
    has = lambda c, yes, no: F.when(F.size(c) > 0, yes).otherwise(no)
    due = F.when(F.col("d_day") >= 7, 10).when(F.col("d_day") >= 0, 6).otherwise(0)
    rest = has("n_industries", 20, 12) + has("n_regions", 10, 6) + has("n_groups", 10, 5) + has("special_groups", 5, 0) + 5 * F.size("prefers") + due + F.when((F.size("tiers") > 0) | _beginners("all_text"), 10).otherwise(7)
    names = F.transform("fields", lambda f: f["field"])
    named = F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("need"), F.when(n == F.try_element_at(names, F.lit(1)), 40).otherwise(28).alias("points")))
    always = [F.struct(F.lit(key).alias("need"), F.lit(points).alias("points")) for key, points in ((_NO_HIT, 0), (_NO_NEEDS, 20))]
    regions = F.concat(has("n_regions", F.array_distinct("n_regions"), F.array(F.lit(""))), F.array(F.lit(_ANY)))
    x = firsts.withColumn("__list", F.explode(F.concat(F.filter(named, lambda n: ~n["need"].isin(_NO_HIT, _NO_NEEDS)), F.array(*always)))).withColumn("__region", F.explode(regions))
    bound = rest + F.col("__list.points")
    return x.withColumn("__need", F.col("__list.need")).withColumn("__bound", bound).withColumn("__level", F.floor(F.least(bound, F.lit(_MOST)) / _LEVEL).cast("int")).drop("__list")


def _meet(asks: DataFrame, lists: DataFrame, on: list[str]) -> DataFrame:
    """Profiles with the classes of their lists, each pair in the list of the first field that the profile needs."""
    hit = F.try_element_at(F.filter(F.transform("fields", lambda f: f["field"]), lambda n: F.array_contains(F.col("__needs"), n)), F.lit(1))
    mine = F.when(F.size("__needs") == 0, _NO_NEEDS).otherwise(F.coalesce(hit, F.lit(_NO_HIT)))
    other = (F.size("n_industries") > 0) & (F.size("p_industries") > 0) & ~F.arrays_overlap("p_compat", "n_industries")
    return lists.join(asks, on).where((F.col("__need") == mine) & ~F.coalesce(other, F.lit(False)))


def _misses() -> Column:
    """What a bound counts of its list that this profile does not have."""
    off = lambda c, points, hit: F.when((F.size(c) > 0) & ~F.coalesce(hit, F.lit(True)), points).otherwise(0)
    return (
        off("n_groups", 10, F.arrays_overlap("p_groups", "n_groups"))
        + off("special_groups", 5, F.arrays_overlap("p_groups", "special_groups"))
        + off("n_regions", 10, tx.text(F.col("region")) != "")
        + off("n_industries", 20, F.size("p_industries") > 0)
    )


def candidate_classes(profiles: DataFrame, firsts: DataFrame, k: int) -> DataFrame:
    """Pairs of prepared profiles and first notices of classes that may be among a profile's k best.

    The k classes of the highest bounds of each of its lists are scored first; the k-th best score of those is what others
    have to reach. Lists are split by level of their bounds, and a profile meets only the levels that reach it."""
    lists = stage(postings(firsts))
    region = tx.text(F.col("region"))
    needs = F.filter(F.coalesce("needs", _none()), lambda n: n.isNotNull() & ~n.isin(_NO_HIT, _NO_NEEDS))
    asks = profiles.withColumn("__needs", needs).withColumn("__need", F.explode(F.when(F.size("__needs") > 0, F.array_distinct(F.concat("__needs", F.array(F.lit(_NO_HIT))))).otherwise(F.array(F.lit(_NO_NEEDS)))))
    asks = asks.withColumn("__region", F.explode(F.when(region != "", F.array(region, F.lit(""))).otherwise(F.array(F.lit(_ANY)))))
    best = Window.partitionBy("__need", "__region").orderBy(F.col("__bound").desc(), "class")
    top = lists.withColumn("__at", F.row_number().over(best)).where(F.col("__at") <= k)
    scores = _graded(_meet(asks, top, ["__need", "__region"])).where("eligible").select("profile_id", "score")
    nth = Window.partitionBy("profile_id").orderBy(F.col("score").desc())
    floor = scores.withColumn("__at", F.row_number().over(nth)).where(F.col("__at") <= k).where(F.col("__at") == k).select(F.col("profile_id").alias("__id"), F.col("score").alias("__floor"))
    asks = asks.join(floor, F.col("profile_id") == F.col("__id"), "left").withColumn("__floor", F.coalesce("__floor", F.lit(0)))
    asks = asks.withColumn("__level", F.explode(F.sequence(F.floor(F.col("__floor") / _LEVEL).cast("int"), F.lit(_MOST // _LEVEL))))
    return _meet(asks, lists, ["__need", "__region", "__level"]).where(F.col("__bound") - _misses() >= F.col("__floor"))


def best_matches(profiles: DataFrame, notices: DataFrame, today: str, k: int = 20, lexicon: Lexicon = KOREAN) -> DataFrame:
    """The ``k`` best eligible matches of each profile with ``rank``, as ranking all rows of ``match`` would give them.

    Only pairs of a profile with the first notice of a class that can reach its k-th best score are built and scored; of
    the k best classes the first k notices are ranked, and only the result gets its reasons. Profiles and notices have
    an id each; without notices (profiles) there are no rows."""
    p, n = prepare_profiles(profiles, lexicon), prepare_notices(notices, today, lexicon)
    p = stage(p.withColumnsRenamed({c: f"{c}_of_profile" for c in p.columns if c in n.columns}))
    n = n.where(tx.text(F.col("status")).contains(lex.OPEN) & (F.coalesce("d_day", F.lit(0)) >= 0))
    members = stage(classes(n, k).withColumn("all_text", F.when(_beginners("all_text"), "초보").otherwise("")))
    pairs = _graded(candidate_classes(p, members.where("place = 1"), k)).where("eligible")
    order = lambda: Window.partitionBy("profile_id").orderBy(F.col("score").desc(), F.coalesce("d_day", F.lit(9999)), "project_no")
    won = pairs.select("profile_id", "class", "score", "d_day", "project_no").withColumn("__at", F.row_number().over(order())).where(F.col("__at") <= k)
    won = won.select("profile_id", "class", "score").join(members.select("class", "d_day", "project_no"), "class")
    won = stage(won.withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= k).select("profile_id", "project_no", "rank"))
    n = prepare_notices(notices.join(won.select("project_no"), "project_no", "left_semi"), today, lexicon)  # these only
    return _graded(n.join(won, "project_no").join(p, "profile_id"))


def alerts(matches: DataFrame, today: str) -> DataFrame:
    """Eligible matches of the alert score that are new in a week or due in two."""
    new = tx.text(F.col("first_seen")) >= F.date_sub(F.to_date(F.lit(today)), 7).cast("string")
    due = F.coalesce(F.col("d_day") <= 14, F.lit(False))
    kind = F.concat(F.when(new, "신규·").otherwise(""), F.when(due, "마감임박").otherwise("추천"))
    return matches.where(F.col("eligible") & (F.col("score") >= lex.ALERT_MIN) & (new | due)).withColumn("kind", kind)


def digest(subscribers: DataFrame, notices: DataFrame, sent: DataFrame, state: DataFrame, today: str, max_items: int = 15) -> DataFrame:
    """Per subscriber the new matches that meet its conditions: first items, how many more, and whether it is the first.

    subscribers: sub_key and cleaned conditions as columns of a profile."""
    x = match(subscribers.withColumn("id", F.col("sub_key")), tables.filter_status(notices, lex.OPEN), today, include_ineligible=False)
    x = x.withColumn("section_text", F.col("all_text")).withColumn("field_objects", F.col("fields")).withColumn("fields", F.transform("fields", lambda f: f["field"]))
    x = tables.new_items(tables.subscriber_filter(x), sent)
    x = x.join(state.select("sub_key", F.lit(True).alias("known")), "sub_key", "left").withColumn("first", F.col("known").isNull()).drop("known")
    return tables.digest_items(x, max_items)


