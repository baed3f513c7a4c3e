"""Notice metadata from free text: sections, chunks, fields, target, amount, application, whole records.

Row-local expressions over arrays of lines; only packing lines into chunks is a vectorized helper."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom import lexicon as lex
from noticeloom.functions import text as tx
from noticeloom.lexicon import KOREAN, Lexicon
from noticeloom.operators import tables
from noticeloom.operators.lines import _by_line
from noticeloom.sources.staging import dealt

# --- fixed values: patterns ----------------------------------------------------------------------------------------

TOP_HEAD = r"^\s*(?:(\d{1,2})\s*[.)]\s*(?=\S)|([ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ])\s*\.?\s*|([󰊱-󰊹])\s*|□\s*)(.{1,40})$"
APPENDIX = r"^\s*(【\s*(붙임|별첨|서식)|\[\s*(붙임|별첨|서식)|<\s*(붙임|별첨|서식)|(붙임|별첨)\s*\d|서식\s*\d)"
CHUNK_HEAD = r"^\s*(\d{1,2}\.|[가-하]\.|【|[󰊱-󰊹]|[ⅠⅡⅢⅣⅤ]\.)"
AMOUNT, RATE = r"(\d[\d,\.]*)\s*(억|천만|백만|만)\s*원", r"(\d{1,3})\s*%\s*(?:이내|이하|지원|까지)?"
SUPPORT = r"(지원\s*(내용|금액|한도|기준|규모|비율)|사\s*업\s*량|모집\s*규모|지원한도)"
APPLY = r"(신청\s*방법|접수|제출|이메일|온라인|문서24)"
INTRO, OTHER, SEE_NOTICE = "공고 안내", "기타", "공고문 참조"

RULES = "array<struct<rule:string,evidence:string>>"


def _rules(*pairs) -> Column:
    """Array of the (rule, evidence) whose evidence is not null."""
    told = lambda r: lambda e: F.when(e.isNotNull(), F.struct((r if isinstance(r, Column) else F.lit(r)).alias("rule"), F.substring(e, 1, 160).alias("evidence")))
    return F.array_compact(F.array(*(tx.once(e, told(r)) for r, e in pairs)))


def _first(lines: Column, pattern: str) -> Column:
    return F.try_element_at(F.filter(lines, lambda x: tx.has(x, pattern)), F.lit(1))


def _distinct_by(structs: Column, name: str) -> Column:
    """The first struct for each value of a field."""
    first = lambda s, keys: F.filter(s, lambda x, i: F.array_position(keys, x[name]) == i + 1)
    return tx.once(structs, lambda s: tx.once(F.transform(s, lambda x: x[name]), lambda keys: first(s, keys)))


# --- documents -----------------------------------------------------------------------------------------------------


def doc_sections(lines: DataFrame, max_chars: int = 1500, lexicon: Lexicon = KOREAN) -> DataFrame:
    """(doc_id, sections: array of (seq, name, text)): text under top headings, by category in canonical order; what
    follows the first appendix mark is left out."""
    x = lines.withColumn("text", tx.strip(F.col("text"))).where("text <> ''")
    w = _by_line()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__stop", F.max(tx.has(F.col("text"), APPENDIX).cast("int")).over(upto)).where("__stop = 0")
    head = tx.has(F.col("text"), TOP_HEAD) & (F.length("text") <= 45) & ~tx.has(F.col("text"), r"[:：]\s*\S")
    x = x.withColumn("__head", head).withColumn("__block", F.sum(F.col("__head").cast("int")).over(upto))
    title = F.max(F.when(F.col("__head"), tx.clean(F.regexp_extract("text", tx.rx(TOP_HEAD), 4))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("__head"), F.struct("line_no", "text")))), lambda p: p["text"]), "\n")
    b = x.groupBy("doc_id", "__block").agg(title.alias("head"), body.alias("body")).where("body <> ''")
    category = F.lit(OTHER)
    for name, pattern in reversed(lexicon.doc_categories):
        category = F.when(tx.has(F.col("head"), pattern), name).otherwise(category)
    headless = tx.text(F.col("head")) == ""
    b = b.withColumn("name", F.when(headless, INTRO).otherwise(category)).withColumn("part", F.when(headless, F.col("body")).otherwise(F.concat(F.lit("["), F.col("head"), F.lit("]\n"), F.col("body"))))
    order = [INTRO, *(n for n, _ in lexicon.doc_categories), OTHER]
    seq = F.array_position(F.array(*map(F.lit, order)), F.col("name")).cast("int")
    joined = F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__block", "part"))), lambda p: p["part"]), "\n"), 1, max_chars)
    b = b.groupBy("doc_id", seq.alias("seq"), "name").agg(joined.alias("text"))
    return b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "text"))).alias("sections"))


def section(sections: Column, name: str) -> Column:
    """A section's text, '' without one."""
    return F.coalesce(F.try_element_at(F.filter(sections, lambda s: s["name"] == name), F.lit(1))["text"], F.lit(""))


def _pack(lines: list[str], most: int) -> list[str]:
    """Lines joined greedily up to ``most`` characters; what is longer than twice that is cut."""
    out, now = [], ""
    for line in lines:
        if now and len(now) + 1 + len(line) > most:
            out.append(now)
            now = ""
        now = f"{now}\n{line}" if now else line
        while len(now) > 2 * most:
            out.append(now[:most])
            now = now[most:]
    return [*out, now] if now else out


def make_chunks(sections: DataFrame, docs: DataFrame, max_len: int = 500) -> DataFrame:
    """(project_no, source, seq, heading, text): page sections (project_no, seq, name, text) first, then each document
    (project_no, doc_seq, file_name, text) by heading. One notice's numbering is a window; packing is per block."""
    page = sections.select("project_no", F.lit(-1).alias("doc_seq"), F.lit("상세페이지").alias("source"), F.col("seq").alias("block"), F.col("name").alias("heading"), F.filter(tx.raw_lines(F.col("text")), lambda x: tx.strip(x) != "").alias("rows"))
    line = docs.select("project_no", "doc_seq", F.col("file_name").alias("source"), F.posexplode(F.transform(tx.raw_lines(F.col("text")), lambda x: F.regexp_replace(x, tx.rx(r"\s+$"), ""))).alias("line_no", "text")).where("text <> ''")
    head = tx.has(F.col("text"), CHUNK_HEAD) & (F.length("text") < 60)
    w = Window.partitionBy("project_no", "doc_seq").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("head", head).withColumn("block", F.sum(F.col("head").cast("int")).over(w).cast("int"))
    doc = line.groupBy("project_no", "doc_seq", "source", "block").agg(F.coalesce(F.max(F.when(F.col("head"), tx.clean(F.col("text")))), F.lit("")).alias("heading"), F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "text")))), lambda p: p["text"]).alias("rows"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["parts"] = [_pack(list(r), max_len) for r in b["rows"]]
            yield b.drop(columns="rows")

    x = page.unionByName(doc).mapInPandas(packed, "project_no string, doc_seq int, source string, block int, heading string, parts array<string>")
    x = x.select("project_no", "doc_seq", "source", "block", "heading", F.posexplode("parts").alias("part", "text"))
    n = F.row_number().over(Window.partitionBy("project_no").orderBy("doc_seq", "block", "part"))
    return x.select("project_no", "source", (n - 1).cast("int").alias("seq"), "heading", "text")


# --- metadata ------------------------------------------------------------------------------------------------------


def extract_fields(title: Column, page: Column, doc: Column, lexicon: Lexicon = KOREAN) -> Column:
    """Array of (field, score, evidence): keyword counts weighted by where they stand; the best ones."""
    bound = F.struct(tx.text(title).alias("title"), tx.text(page).alias("page"), tx.text(doc).alias("doc"), tx.lines(page).alias("lines"))
    return tx.once(tx.once(bound, lambda b: _fields(b["title"], b["page"], b["doc"], b["lines"], lexicon)), lambda every: tables.top_fields(every))


def _word_table(lexicon: Lexicon) -> Column:
    """Array of (field, words: array of (word, weight)): one constant, so the plan does not grow with the word lists."""
    put = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    words = lambda of: ", ".join(f"struct({put(w)} AS word, CAST({weight} AS DOUBLE) AS weight)" for w, weight in of.items())
    return F.expr("array(" + ", ".join(f"struct({put(name)} AS field, array({words(of)}) AS words)" for name, of in lexicon.fields.items() if of) + ")")


def _fields(title: Column, page: Column, doc: Column, page_lines: Column, lexicon: Lexicon) -> Column:
    """Every field with its score, those that reach 6."""
    n = lambda c, w: ((F.octet_length(c) - F.octet_length(F.replace(c, w, F.lit("")))) / F.octet_length(w)).cast("int")  # noqa: E731  bytes need no scan

    def seen(w: Column) -> Column:
        line = F.try_element_at(F.filter(page_lines, lambda x: x.contains(w["word"])), F.lit(1))
        return F.substring(F.when(title.contains(w["word"]), title).when(page.contains(w["word"]), line), 1, 160)

    def kept(of: Column, score: Column) -> Column:
        evidence = F.slice(F.array_distinct(F.array_compact(F.transform(of["words"], seen))), 1, 2)
        return F.when(score >= 6, F.struct(of["field"].alias("field"), F.round(score, 1).alias("score"), evidence.alias("evidence")))

    def scored(of: Column) -> Column:
        more = lambda w: w["weight"] * (4.0 * n(title, w["word"]) + 2.0 * n(page, w["word"]) + 0.5 * F.least(n(doc, w["word"]), F.lit(10)))
        return tx.once(F.aggregate(of["words"], F.lit(0.0), lambda total, w: total + more(w)), lambda score: kept(of, score))

    return F.array_compact(F.transform(_word_table(lexicon), scored))


def extract_target(title: Column, target: Column, page: Column, doc: Column, doc_target: Column, lexicon: Lexicon = KOREAN) -> Column:
    """struct of whom a notice is for: industries, company types, regions, exclusions, requirements, preferences,
    tiers, countries, first lines and the basis of industries and regions."""
    given = F.struct(tx.text(target).alias("page"), tx.text(doc_target).alias("doc"))
    aim = tx.once(given, lambda g: F.when((F.length(tx.clean(g["page"])) < 20) & (g["doc"] != ""), tx.strip(F.concat(g["page"], F.lit("\n"), g["doc"]))).otherwise(g["page"]))
    told = F.filter(F.concat(tx.lines(page), tx.lines(doc)), lambda x: tx.has(x, "제외|제한|불가"))
    bound = F.struct(tx.text(title).alias("title"), aim.alias("target"), F.slice(told, 1, 15).alias("hard"))
    return tx.once(tx.once(bound, lambda b: _read(b, lexicon)), lambda b: _target(b, lexicon))


def _read(b: Column, lexicon: Lexicon) -> Column:
    """What several parts of a target are worked out from."""
    title, target = b["title"], b["target"]
    return F.struct(
        title.alias("title"), F.concat(title, F.lit("\n"), target).alias("both"), tx.lines(target).alias("lines"), b["hard"].alias("hard"),
        tx.title_region(title, lexicon).alias("region"), tx.title_industries(title, lexicon).alias("industries"),
    )


def _target(b: Column, lexicon: Lexicon) -> Column:
    title, both, t_lines, region, from_title = (b[c] for c in ("title", "both", "lines", "region", "industries"))
    basis = lambda where, line: F.struct(where.alias("from"), F.substring(line, 1, 160).alias("evidence"))
    plain = F.filter(t_lines, lambda x: ~tx.has(x, "제외|불가|제한|우대|가점"))
    hits = F.transform(plain, lambda x: F.struct(tx.rule_industries(x, True, lexicon).alias("i"), x.alias("l")))
    hits = F.when(F.size(from_title) == 0, F.filter(hits, lambda h: F.size(h["i"]) > 0))

    def aimed(h: Column) -> Column:
        line = F.try_element_at(h, F.lit(1))["l"]
        return F.struct(
            F.when(F.size(from_title) > 0, from_title).otherwise(tx.in_order(F.flatten(F.transform(h, lambda x: x["i"])), lexicon.industries)).alias("names"),
            F.when(F.size(from_title) > 0, basis(F.lit("제목"), title)).when(line.isNotNull(), basis(F.lit("지원대상"), line)).alias("basis"),
        )

    types = F.array_compact(F.array(F.when(tx.has(both, r"해외\s*유통매장\s*운영사|현지\s*벤더|수입업체"), lex.DISTRIBUTOR), F.when(both.contains("중소"), lex.SME)))
    types = tx.once(types, lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.lit("수출기업"))))
    home = F.when(both.contains("전남광주") | both.contains("통합특별시"), F.array(F.lit("전남"), F.lit("광주"))).otherwise(
        F.array_compact(F.array(F.when(tx.any_contains(both, ("전남", "전라남도", "도내")), "전남"), F.when(both.contains("광주"), "광주")))
    )
    regions = F.when(region.isNotNull() & ~region.isin("전남", "광주"), F.array(region)).otherwise(home)
    region_line = F.when(region.isNotNull(), title).otherwise(F.coalesce(_first(t_lines, "전남|광주|도내"), F.lit("")))
    region_basis = lambda r: F.when(F.size(r) > 0, basis(F.when(region.isNotNull(), "제목").otherwise("지원대상"), region_line))

    limits = lambda told: _rules(("상장기업 제외", _first(told, "코스피|코스닥|상장")), ("타시도 제품만 유통하는 기업 제외", _first(told, r"타시도\s*제품만\s*유통")), ("휴·폐업/금융불량 기업 제외", _first(told, r"휴\S*폐업|불량거래")))
    excludes = tx.once(F.concat(t_lines, b["hard"]), limits)
    site = F.when(tx.has(both, r"본사\s*(또는|·|및)\s*공장"), F.coalesce(_first(t_lines, "본사"), F.lit("")))
    requires = _rules(("직수출 기업", _first(t_lines, r"직접\s*수출|직수출")), ("관내 본사 또는 공장 소재", site))

    def preferred(x: Column) -> Column:
        one, two = tx.clean(F.regexp_extract(x, tx.rx(r"\(\s*우선\s*지원\s*\)\s*([^※(]+)"), 1)), tx.clean(F.regexp_extract(x, tx.rx(r"([^\s,:※]+(?:\s[^\s,:※]+){0,3})\s*우선\s*(?:지원|선정)"), 1))
        rule = tx.once(one, lambda o: F.when(o != "", o).otherwise(two))
        rule = F.regexp_replace(F.regexp_replace(rule, tx.rx(r"^[-※·\s]*(경합\s*시\s*)?"), ""), "^[ -]+|[ -]+$", "")
        return F.struct(F.substring(rule, 1, 60).alias("rule"), F.substring(x, 1, 160).alias("evidence"))

    prefers = _distinct_by(F.filter(F.transform(F.filter(t_lines, lambda x: x.contains("우선")), preferred), lambda p: p["rule"] != ""), "rule")
    tiers = F.transform(F.filter(t_lines, lambda x: tx.has(x, r"(\d+)\s*만\s*불\s*이상") & x.contains("%")), lambda x: F.struct(F.lit("수출실적별 차등지원").alias("rule"), F.substring(x, 1, 160).alias("evidence")))
    open_lines = F.array_join(F.filter(t_lines, lambda x: ~tx.has(x, r"만\s*원|최대|초청\s*시")), "\n")
    countries = tx.once(open_lines, lambda o: F.array_sort(F.array_compact(F.array(*(F.when(title.contains(c) | o.contains(c), c) for c in lexicon.countries)))))

    def shown(x: Column) -> Column:
        return F.struct(
            x["of"]["names"].alias("industries"), types.alias("company_types"), x["regions"].alias("regions"), excludes.alias("excludes"), requires.alias("requires"),
            prefers.alias("prefers"), tiers.alias("tiers"), countries.alias("countries"), F.slice(t_lines, 1, 8).alias("text"),
            F.map_filter(F.create_map(F.lit("industries"), x["of"]["basis"], F.lit("regions"), region_basis(x["regions"])), lambda k, v: v.isNotNull()).alias("basis"),
        )

    return tx.once(F.struct(tx.once(hits, aimed).alias("of"), regions.alias("regions")), shown)


def _candidates(text: Column) -> Column:
    """Array of (v, line): amounts within bounds on lines that speak of support."""
    on = F.filter(tx.lines(text), lambda x: tx.has(x, "한도|최대|지원금액|지원기준|지원규모|이내"))
    number, unit = lambda m: F.regexp_extract(m, tx.rx(AMOUNT), 1), lambda m: F.regexp_extract(m, tx.rx(AMOUNT), 2)
    found = F.flatten(F.transform(on, lambda x: F.transform(tx.extract_all(x, AMOUNT), lambda m: F.struct(tx.to_manwon(number(m), unit(m)).alias("v"), F.substring(x, 1, 160).alias("line")))))
    return F.filter(found, lambda c: c["v"].between(10, 100000))


def extract_amount(page: Column, doc: Column, lexicon: Lexicon = KOREAN) -> Column:
    """struct(max_manwon, special_max_manwon, special_countries, rate, evidence)."""
    found = tx.once(_candidates(page), lambda on_page: F.when(F.size(on_page) > 0, on_page).otherwise(_candidates(F.substring(tx.text(doc), 1, 20000))))
    return tx.once(found, lambda c: _amount(c, page, doc, lexicon))


def _amount(c: Column, page: Column, doc: Column, lexicon: Lexicon) -> Column:
    top = lambda a: F.array_max(F.transform(a, lambda x: x["v"]))
    company = F.filter(c, lambda x: tx.has(x["line"], "기업당|개소당|운영사"))
    best = tx.once(company, lambda own: top(F.when(F.size(own) > 0, own).otherwise(c)))
    by_value = F.array_sort(F.transform(c, lambda x, i: F.struct((-x["v"]).alias("o"), i.alias("i"), x["line"].alias("line"))))
    on = F.filter(F.concat(tx.lines(page), tx.lines(F.substring(tx.text(doc), 1, 8000))), lambda x: ~tx.has(x, r"만\s*불|차등|할인") & tx.has(x, "지원|이내|보조"))
    rates = F.filter(F.flatten(F.transform(on, lambda x: F.transform(tx.extract_all(x, RATE, 1), lambda r: r.cast("int")))), lambda r: r.between(10, 100))
    counted = lambda all_: F.transform(F.array_distinct(all_), lambda r: F.struct((-F.size(F.filter(all_, lambda q: q == r))).alias("n"), r.alias("r")))
    special = lambda b: F.filter(c, lambda x: (x["v"] > b) & tx.has(x["line"], "단,|※|중동|미주"))
    named = lambda lines: F.array_sort(F.array_compact(F.array(*(F.when(lines.contains(w), w) for w in lexicon.countries))))

    def shown(x: Column) -> Column:
        return F.struct(
            x["best"].alias("max_manwon"), top(x["special"]).alias("special_max_manwon"), tx.once(F.array_join(F.transform(x["special"], lambda y: y["line"]), "\n"), named).alias("special_countries"),
            tx.once(rates, lambda r: F.array_min(counted(r))["r"]).alias("rate"), F.slice(F.array_distinct(F.transform(by_value, lambda y: y["line"])), 1, 3).alias("evidence"),
        )

    return tx.once(tx.once(best, lambda b: F.struct(b.alias("best"), special(b).alias("special"))), shown)


def _or_see(methods: Column) -> Column:
    return tx.once(methods, lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(F.lit(SEE_NOTICE))))


def extract_apply(method: Column, detail: Column, doc: Column, online: str) -> Column:
    """struct(methods, emails, phones, contact, lines): how to apply. ``detail``: map of the page's contact values."""
    method, doc = tx.text(method), tx.text(doc)
    get = lambda k: tx.text(F.try_element_at(detail, F.lit(k)))
    methods = F.array_compact(F.array(
        F.when(tx.has(method, "온라인|로그인|지원사업신청|홈페이지"), online or "온라인 신청"), F.when(tx.has(method, "이메일|E-?mail|메일", True), "이메일 제출"),
        F.when(F.concat(method, F.lit("\n"), F.substring(doc, 1, 15000)).contains("문서24"), "문서24"), F.when(tx.has(method, "우편|방문"), "우편/방문"),
    ))
    own = tx.emails(F.concat(method, F.lit(" "), get("이메일")))
    return F.struct(
        _or_see(methods).alias("methods"), tx.once(own, lambda o: F.when(F.size(o) > 0, o).otherwise(F.slice(tx.emails(doc), 1, 3))).alias("emails"),
        F.slice(tx.phones(F.concat_ws(" ", method, get("전화번호"), F.substring(doc, 1, 20000))), 1, 4).alias("phones"),
        F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("k"), get(k).alias("v")) for k in ("소속", "이름", "직위", "전화번호", "이메일")))).alias("contact"),
        F.slice(tx.lines(method), 1, 8).alias("lines"),
    )


def enrich_apply(apply: Column, sections: Column, doc: Column) -> Column:
    """``apply`` with what the documents' sections on applying add, and their key lines as doc_lines."""
    parts = [section(sections, k) for k in ("신청방법·접수", "제출서류", "문의처")]
    said = F.array_join(F.filter(F.slice(tx.raw_lines(doc), 1, 400), lambda x: tx.has(x, "신청|접수|제출|이메일|홈페이지|문의")), "\n")
    src = tx.once(F.array_join(F.array(*parts), "\n"), lambda s: F.when(tx.squash(s) != "", s).otherwise(said))
    return tx.once(F.struct(apply.alias("apply"), src.alias("src"), parts[0].alias("how")), lambda b: _enriched(b["apply"], b["src"], b["how"]))


def _enriched(apply: Column, src: Column, how: Column) -> Column:
    more = F.array_compact(F.array(
        F.when(tx.has(src, r"(수출e음|수출정보망|jexport)[^\n]{0,40}(신청|로그인)|지원사업신청"), "수출e음 온라인 신청"), F.when(tx.has(src, "exportvoucher|수출바우처"), "수출바우처 홈페이지 신청"),
        F.when(tx.has(src, r"KOTRA\s*홈페이지|www\.kotra\.or\.kr", True), "KOTRA 홈페이지 신청"), F.when(tx.has(src, r"이메일|E-?mail|메일\s*(접수|제출)|@", True), "이메일 제출"),
        F.when(src.contains("문서24"), "문서24"), F.when(tx.has(src, r"우편|방문\s*(접수|제출)"), "우편/방문"),
    ))
    methods = F.array_distinct(F.concat(F.filter(apply["methods"], lambda m: m != SEE_NOTICE), more))
    key = F.filter(F.transform(tx.raw_lines(how), tx.strip), lambda x: tx.has(x, "접수|신청|제출|기간|이메일|홈페이지|@") & ~x.startswith("[") & (tx.count_literal(x, "|") < 2))
    return F.struct(
        _or_see(methods).alias("methods"),
        tx.ordered_union(apply["emails"], tx.emails(src), 4).alias("emails"), tx.ordered_union(apply["phones"], tx.phones(src), 4).alias("phones"),
        apply["contact"].alias("contact"), apply["lines"].alias("lines"), F.transform(F.slice(key, 1, 10), lambda x: F.substring(tx.clean(x), 1, 200)).alias("doc_lines"),
    )


def apply_region(title: Column, agency: Column, target_text: Column, source: Column, page: Column) -> Column:
    """struct(region, regions, basis): by title or agency, by the target text, by a regional site's own words; else
    the whole country."""
    local = tx.extract(page, r"[^\n]{0,40}(도내|전북\s*(?:특별자치도)?\s*(?:내\s*)?소재|전라북도\s*소재)[^\n]{0,40}")
    jb = source == "jbexport"
    found = lambda r, where, line: F.struct(r.alias("region"), F.lit(where).alias("from"), line.alias("evidence"))

    def said(b: Column) -> Column:
        return (
            F.when(b["t"].isNotNull(), found(b["t"], "제목", title))
            .when(b["a"]["region"].isNotNull(), found(b["a"]["region"], "지원대상", b["a"]["evidence"]))
            .when(jb & tx.has(title, "전북|전라북도"), found(F.lit("전북"), "제목", title))
            .when(jb & b["l"].isNotNull(), found(F.lit("전북"), "지원대상", F.substring(tx.strip(b["l"]), 1, 160)))
        )

    def shown(x: Column) -> Column:
        r = x["region"]
        regions = F.when(r.isNull(), F.array().cast("array<string>")).when(r.isin("전남", "광주"), F.array(F.lit("전남"), F.lit("광주"))).otherwise(F.array(r))
        return F.struct(F.coalesce(r, F.lit(lex.NATIONWIDE)).alias("region"), regions.alias("regions"), F.when(r.isNotNull(), F.struct(x["from"].alias("from"), x["evidence"].alias("evidence"))).alias("basis"))

    bound = F.struct(tx.notice_region(title, agency).alias("t"), tx.target_region(target_text).alias("a"), local.alias("l"))
    return tx.once(tx.once(bound, said), shown)


def _gathered(notices: DataFrame, docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Notices with their page, the text and sections of their documents and what these say of whom they are for."""
    whole = tables.notice_text(docs).withColumnRenamed("text", "doc")
    x = dealt(notices, "project_no").join(whole, "project_no", "left").join(sections.select(F.col("doc_id").alias("project_no"), F.col("sections").alias("doc_sections")), "project_no", "left")
    none = F.array().cast("array<struct<seq:int,name:string,text:string>>")
    x = x.withColumns({"sections": F.coalesce("sections", none), "doc_sections": F.coalesce("doc_sections", none), "doc": tx.text(F.col("doc"))})
    return x.withColumns({"page": F.array_join(F.transform("sections", lambda s: s["text"]), "\n"), "__doc_aim": section(F.col("doc_sections"), "신청자격·지원대상"), "__own": section(F.col("sections"), lex.SECTION_TARGET)})


def _aims(lexicon: Lexicon) -> dict[str, Column]:
    title, page, doc_aim = F.col("title"), F.col("page"), F.col("__doc_aim")
    aim = F.concat("__own", F.lit("\n"), section(F.col("sections"), lex.SECTION_OVERVIEW))
    where = apply_region(title, F.split(tx.text(F.col("subtitle")), " · ")[0], F.concat("__own", F.lit("\n"), doc_aim), F.col("source"), F.concat(page, F.lit("\n"), doc_aim))
    return {"target": extract_target(title, aim, page, F.col("doc"), doc_aim, lexicon), "__where": where}


def _placed() -> dict[str, Column]:
    """Region and target of a notice; those of the regional source are as extracted."""
    local = F.col("source") != lex.SOURCE_ORDER[0]
    return {"region": F.when(local, F.col("__where.region")), "target": F.when(local, F.col("target").withField("regions", F.col("__where.regions"))).otherwise(F.col("target"))}


def build_records(notices: DataFrame, docs: DataFrame, sections: DataFrame, online: str = "온라인 신청", lexicon: Lexicon = KOREAN) -> DataFrame:
    """Standard records of notices (project_no, source, title, subtitle, status, period, contact, sections) with their
    documents (project_no, doc_seq, file_name, text) and document sections (doc_id = project_no, sections).

    Texts are gathered once per notice; everything after that is row-local."""
    method = F.coalesce(F.try_element_at(F.filter("sections", lambda s: tx.has(s["name"], "지원방법|제출서류")), F.lit(1))["text"], F.lit(""))
    x = _gathered(notices, docs, sections).withColumns({"__method": method, "__period": tx.parse_period(F.col("period"))})
    page, doc, aims = F.col("page"), F.col("doc"), _aims(lexicon)
    x = x.withColumns({
        "fields": extract_fields(F.col("title"), page, doc, lexicon), "target": aims["target"], "amount": extract_amount(page, doc, lexicon),
        "apply": enrich_apply(extract_apply(F.col("__method"), F.col("contact"), doc, online), F.col("doc_sections"), doc), "__where": aims["__where"],
    })
    x = x.withColumns(_placed() | {"receipt_start": F.col("__period.start").cast("string"), "receipt_end": F.col("__period.end").cast("string"), "early_close": tx.early_close(page, doc).cast("int")})
    x = x.withColumn("summary", tx.make_summary(F.col("fields"), F.col("amount"), F.col("target.industries"), F.col("receipt_end")))
    return x.drop("__where", "page", "doc", "__method", "__doc_aim", "__own", "__period")


def reanalyze(notices: DataFrame, docs: DataFrame, sections: DataFrame, lexicon: Lexicon = KOREAN) -> DataFrame:
    """Stored notices with target, region and summary rebuilt from stored text; other values stay."""
    x = _gathered(notices.select("project_no", "source", "title", "subtitle", "sections"), docs, sections).withColumns(_aims(lexicon)).withColumns(_placed())
    new = x.select("project_no", F.col("target").alias("__target"), F.col("region").alias("__region"))
    x = notices.join(new, "project_no").withColumns({"target": F.col("__target"), "region": F.coalesce("__region", "region")})
    return x.withColumn("summary", tx.make_summary(F.col("fields"), F.col("amount"), F.col("target.industries"), F.col("receipt_end"))).drop("__target", "__region")


def summarize_notice(records: DataFrame, schedule: DataFrame, reqs: DataFrame, docs: DataFrame) -> DataFrame:
    """Records with days left, contacts over page and documents, next deadline and requirements (doc_id = project_no)."""
    page = records.select("project_no", F.array_join(F.transform("sections", lambda s: s["text"]), "\n").alias("text"))
    people = tables.contacts(page.unionByName(docs.select("project_no", "text"))).withColumnsRenamed({"emails": "all_emails", "phones": "all_phones"})
    due = tables.next_deadline(schedule).withColumnRenamed("doc_id", "project_no").withColumnRenamed("next", "next_deadline")
    lists = reqs.groupBy(F.col("doc_id").alias("project_no")).agg(F.array_sort(F.collect_list(F.struct("line_no", "title", "items"))).alias("requirements"))
    return records.join(people, "project_no", "left").join(due, "project_no", "left").join(lists, "project_no", "left")
