"""Scalar functions over text columns: built-in expressions only, null in, null out unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom import lexicon as lex
from noticeloom.lexicon import KOREAN, Lexicon

#: A word character and the edge of a word, in Java's regular expressions as in Unicode ones.
WORD = r"[\p{L}\p{N}_]"


def rx(pattern: str) -> str:
    """A pattern with Unicode classes, in Java's spelling."""
    edge = rf"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not inside:
            out.append(edge)
        elif two == r"\w":
            out.append(r"\p{L}\p{N}_" if inside else WORD)
        elif two == r"\d":
            out.append("0-9" if inside else "[0-9]")
        elif two == r"\s":
            out.append(r"\s 　" if inside else r"[\s 　]")
        elif pattern[i] == "\\":
            out.append(two)
        else:
            inside = pattern[i] == "[" or (inside and pattern[i] != "]")
            out.append(pattern[i])
            i -= 1
        i += 2
    return "".join(out)


def has(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return c.rlike(("(?iu)" if ignore_case else "") + rx(pattern))


def extract(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, rx(pattern), group), F.lit(""))


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(rx(pattern)), F.lit(group))


def replace(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, rx(pattern), by.replace("\\", "\\\\").replace("$", "\\$"))


def text(c: Column) -> Column:
    """Null as empty."""
    return F.coalesce(c, F.lit(""))


def clean(c: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(replace(text(c), r"\s+", " "))


def squash(c: Column) -> Column:
    """Without white space."""
    return replace(text(c), r"\s+", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rx(r"^\s+|\s+$"), "")


def lines(c: Column) -> Column:
    """Array of the non-empty cleaned lines."""
    return F.filter(F.transform(F.split(text(c), r"\R"), clean), lambda x: x != "")


def raw_lines(c: Column) -> Column:
    """Array of all lines as they stand."""
    return F.split(text(c), r"\R")


def mask(c: Column) -> Column:
    """Registration, resident and mobile numbers and e-mail addresses replaced, in that order."""
    out = text(c)
    for pattern, by in lex.MASKS:
        out = replace(out, pattern, by)
    return out


def sub_key(c: Column) -> Column:
    """A subscriber's key: 16 hex digits of the hash of the address."""
    return F.substring(F.sha2(F.lower(strip(c)), 256), 1, 16)


def emails(c: Column) -> Column:
    """Distinct e-mail addresses in order of appearance."""
    return F.array_distinct(extract_all(text(c), lex.EMAIL))


def phones(c: Column) -> Column:
    return F.array_distinct(extract_all(text(c), lex.PHONE))


def ordered_union(a: Column, b: Column, k: int) -> Column:
    """The first k distinct elements of a, then b."""
    return F.slice(F.array_distinct(F.concat(a, b)), 1, k)


def dice(a: Column, b: Column) -> Column:
    """2 n(a & b) / (n(a) + n(b)) of arrays of distinct elements; 0 when either is empty."""
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return once(F.size(F.array_intersect(a, b)), lambda shared: F.coalesce(F.try_divide(1.0 * shared, both - shared), F.lit(0.0)))


def _date(c: Column) -> Column:
    return F.try_to_date(c, "y-M-d")


def parse_period(c: Column) -> Column:
    """struct(start, end): the first date, and the last if there are two or more; impossible dates are dropped."""
    long = extract_all(text(c), r"20\d{2}[-.]\d{1,2}[-.]\d{1,2}")
    short = F.transform(extract_all(text(c), r"\d{2}\.\d{2}\.\d{2}"), lambda x: F.concat(F.lit("20"), x))
    found = F.when(F.size(long) > 0, long).otherwise(short)
    dates = F.filter(F.transform(found, lambda x: _date(F.translate(x, ".", "-"))), lambda x: x.isNotNull())
    return F.struct(F.try_element_at(dates, F.lit(1)).alias("start"), F.when(F.size(dates) > 1, F.element_at(dates, -1)).alias("end"))


def d_day(c: Column, today: str) -> Column:
    """Days from ``today`` to the date at the start of ``c``; null if there is none."""
    return F.datediff(F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"), F.to_date(F.lit(today)))


def dday_label(d: Column) -> Column:
    return F.when(d.isNull(), "-").when(d == 0, "D-Day").when(d > 0, F.concat(F.lit("D-"), d)).otherwise(F.concat(F.lit("D+"), -d))


def once(c: Column, f) -> Column:
    """``f`` of ``c`` with ``c`` worked out once: inside a lambda an expression is worked out for every element."""
    return F.element_at(F.transform(F.array(c), f), 1)


def char_ngrams(c: Column, n: int) -> Column:
    """Distinct character n-grams; empty when the text is shorter than n."""
    grams = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substr(x, i, F.lit(n))))
    return once(c, lambda x: F.when(F.length(x) >= n, grams(x)).otherwise(F.array().cast("array<string>")))


def bigrams(c: Column) -> Column:
    """Search tokens with repeats: of each lower-cased word its bigrams, or itself if it is one character."""
    words = F.filter(F.split(F.lower(text(c)), rf"[^\p{{L}}\p{{N}}_]+"), lambda w: w != "")
    pairs = lambda w: F.when(F.length(w) == 1, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(2))))
    return F.flatten(F.transform(words, pairs))


def count_literal(c: Column, word: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.octet_length(text(c)) - F.octet_length(F.replace(text(c), F.lit(word), F.lit("")))) / len(word.encode())).cast("int")  # bytes need no scan


def strip_bullet(c: Column) -> Column:
    """Without leading bullets; the trimmed text if nothing else is left."""
    bare = strip(F.regexp_replace(c, rx(r"^\s*(?:[-‐⁃○◦❍•·▪o]\s+|[-‐⁃○◦❍•·▪](?=\S))+"), ""))
    return F.coalesce(F.nullif(bare, F.lit("")), strip(c))


def any_contains(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


# --- titles, files, sources ----------------------------------------------------------------------------------------


def norm_title(c: Column) -> Column:
    """A title's key: without tags, years and boilerplate, Hangul, letters and digits in lower case."""
    t = replace(text(c), r"\[[^\]]*\]|<[^>]*>|20\d{2}\s*년?도?", " ")
    t = replace(t, lex.TITLE_NOISE, " ")
    return F.regexp_replace(F.lower(F.regexp_replace(t, "[^가-힣A-Za-z0-9]", "")), "(지원)+$", "")


def file_stem(c: Column) -> Column:
    """A file name's key, empty if shorter than 6 characters."""
    s = replace(replace(text(c), r"\.\w{2,5}$", ""), r"20\d{2}\s*년?", "")
    s = F.lower(F.regexp_replace(s, "[^가-힣A-Za-z0-9]", ""))
    return F.when(F.length(s) >= 6, s).otherwise("")


def source_of(project_no: Column) -> Column:
    out = F.lit(lex.SOURCE_ORDER[0])
    for prefix, source in reversed(lex.SOURCE_PREFIX.items()):
        out = F.when(project_no.startswith(prefix), source).otherwise(out)
    return out


def normalize_status(c: Column, source: str) -> Column:
    """Open, upcoming or closed, by what each source writes."""
    c = text(c)
    if source == "kotra":
        return F.when(c.contains("신청가능"), lex.OPEN).when(c.contains("예정"), lex.UPCOMING).when(has(F.replace(c, F.lit("오늘마감"), F.lit("")), "마감|종료"), lex.CLOSED).otherwise(lex.OPEN)
    if source == "jbexport":
        return F.when(c.contains(lex.OPEN), lex.OPEN).when(c.contains("공고"), lex.UPCOMING).otherwise(lex.CLOSED)
    return F.when(c.contains("진행"), lex.OPEN).when(c.contains("예정"), lex.UPCOMING).otherwise(lex.CLOSED)


# --- industries, regions, countries --------------------------------------------------------------------------------


def _strings(values) -> Column:
    """An array of constants, as one expression however many there are."""
    return F.split(F.lit("\x01".join(values)), "\x01") if values else F.array().cast("array<string>")


def _literal_map(table: dict[str, str]) -> Column:
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in table.items())), F.lit("\x01"), F.lit("\x02"))


def in_order(found: Column, order) -> Column:
    """The elements of ``order`` that are in ``found``."""
    return once(found, lambda f: F.filter(_strings(order), lambda x: F.array_contains(f, x)))


def normalize_industries(c: Column, lexicon: Lexicon = KOREAN) -> Column:
    """Array of industry names, today's or earlier ones, as today's in canonical order."""
    table = F.create_map(*(x for k, v in lexicon.old_industry.items() for x in (F.lit(k), _strings(v))))
    none = F.array().cast("array<string>")
    names = F.filter(F.transform(F.coalesce(c, none), strip), lambda v: v != "")

    def one(v: Column) -> Column:
        return F.when(F.array_contains(_strings(lexicon.industries), v), F.array(v)).otherwise(F.coalesce(F.try_element_at(table, F.replace(v, F.lit(" "), F.lit(""))), F.try_element_at(table, v), none))

    return in_order(F.flatten(F.transform(names, one)), lexicon.industries)


def split_industries(c: Column) -> Column:
    return F.split(text(c), "[,/·]")


def rule_hits(c: Column, body: bool = False, lexicon: Lexicon = KOREAN) -> Column:
    """struct(industries, evidence): of the rules that the text meets, in canonical order, and the first match."""
    rules = [r for r in lexicon.industry_rules if r[2] or not body]
    first = lambda t: F.coalesce(*(F.nullif(F.regexp_extract(t, "(?iu)" + rx(p), 0), F.lit("")) for p, _, _ in rules), F.lit(""))
    return once(_rule_text(c), lambda t: F.struct(_met(t, body, lexicon).alias("industries"), first(t).alias("evidence")))


def rule_industries(c: Column, body: bool = False, lexicon: Lexicon = KOREAN) -> Column:
    """The industries of ``rule_hits``, without looking for the first match."""
    return once(_rule_text(c), lambda t: _met(t, body, lexicon))


def _rule_text(c: Column) -> Column:
    return replace(replace(text(c), r"식품\s*소비재", "식품"), r"(?:생성형\s*)?AI\s*(?:활용|무역지원센터|기반|마케팅)", " ")


def _met(t: Column, body: bool, lexicon: Lexicon) -> Column:
    none = F.array().cast("array<string>")
    met = F.flatten(F.array(*(F.when(has(t, p, True), _strings(names)).otherwise(none) for p, names, on_body in lexicon.industry_rules if on_body or not body)))
    return in_order(met, lexicon.industries)


def title_industries(c: Column, lexicon: Lexicon = KOREAN) -> Column:
    return rule_industries(replace(text(c), r"^\s*\[(?:1무1유|지방특화|지역특화|변경공고|재공고|연장)\]\s*", ""), False, lexicon)


def sido_of(c: Column, lexicon: Lexicon = KOREAN) -> Column:
    """The province that a text begins with, by its name or a city's; null if none."""

    def of(t: Column) -> Column:
        city = F.try_element_at(_literal_map(lexicon.city_province), extract(t, "^([가-힣]{1,3})(시|군)", 1))
        named = F.try_element_at(_literal_map(lexicon.sido), extract(t, f"^({'|'.join(map(re.escape, lexicon.sido))})", 1))
        return F.when(t.contains("전남광주") | t.contains("통합특별시"), "전남").otherwise(F.coalesce(named, city))

    return once(F.replace(text(c), F.lit(" "), F.lit("")), of)


def _names(lexicon: Lexicon, *more: str) -> str:
    return "|".join(sorted([*lexicon.sido, *lexicon.city_province, *more], key=len, reverse=True))


def title_region(c: Column, lexicon: Lexicon = KOREAN) -> Column:
    """The province that a title limits its notice to; where an event takes place is no limit.

    In order: a leading bracket, a trailing one, a city or county, "companies of ...", a province first of all."""
    cities = _literal_map(lexicon.city_province)
    # fixed values: patterns
    town = r"([가-힣]{1,3})(시|군)(?=\s|$|[^가-힣])(\s*(?:센터|지사|지원본부))?"
    whose = rf"({_names(lexicon, '전남광주')})(?:특별자치도|특별자치시|광역시|특별시|도|시|군)?\s*(?:지역|소재|관내|도내)\s*(?:의\s*)?(?:중소|수출|유망|청년|농식품|창업|강소|제조|기업|업체)"
    begins = rf"^\s*({_names(lexicon, '전남광주')})(?:특별자치도|특별자치시|광역시|특별시|도)?(?:형)?\s"

    def in_front(lead: Column) -> Column:
        named = F.filter(F.split(lead, r"[·ㆍ,/\s]+"), lambda x: F.array_contains(_strings(list(lexicon.city_province)), x))
        return F.when(lead.isNotNull(), F.coalesce(sido_of(lead, lexicon), F.try_element_at(cities, F.try_element_at(named, F.lit(1)))))

    def inside(body: Column) -> Column:
        city = F.when(extract(body, town, 3).isNull(), F.try_element_at(cities, extract(body, town, 1)))
        first = F.coalesce(extract(body, whose, 1), F.when(~has(body, lex.EVENTS), extract(body, begins, 1)))
        return F.coalesce(city, once(first, lambda name: F.when(name.isNotNull(), sido_of(name, lexicon))))

    def of(t: Column) -> Column:
        body = F.regexp_replace(t, rx(r"^\s*(?:[\[(【<][^\])】>]*[\])】>]\s*)*(?:20\d{2}\s*년?(?:도)?\s*)?(?:(?:상|하)반기\s*)?"), "")
        behind = once(extract(t, r"[\[(]\s*([^\])]{2,8})\s*[\])]\s*$", 1), lambda tail: F.when(F.length(F.regexp_replace(tail, "[^가-힣]", "")) <= 6, sido_of(tail, lexicon)))
        # the first rule asks for a bracket at the very start of the title
        return F.coalesce(once(extract(t, r"^\s*[\[(【<]\s*([^\])】>]+)[\])】>]", 1), in_front), behind, once(body, inside))

    return once(text(c), of)


def target_region(c: Column, lexicon: Lexicon = KOREAN) -> Column:
    """struct(region, evidence): of the first of 40 lines that says where a company must be, unless it is a venue."""
    # fixed values: patterns
    where = rf"({_names(lexicon)})(?:특별자치도|특별자치시|광역시|특별시|도|시|군)?\s*(?:내\s*)?(?:에\s*)?(?:소재|본사|주사무소|사업장|관내|지역\s*(?:중소|수출)?기업)"
    near = lambda l: F.regexp_extract(l, rx(f".{{0,10}}?{where}.{{0,10}}"), 0)
    place = ("소재", "본사", "주사무소", "사업장", "관내", "지역")  # what each match ends with, but for the company
    fits = F.filter(F.slice(lines(c), 1, 40), lambda l: any_contains(l, place) & once(near(l), lambda n: (n != "") & ~has(n, "개최|장소|위치|센터|행사장")))
    return once(F.try_element_at(fits, F.lit(1)), lambda line: F.struct(sido_of(extract(line, where, 1), lexicon).alias("region"), F.substring(line, 1, 160).alias("evidence")))


def notice_region(title: Column, agency: Column, lexicon: Lexicon = KOREAN) -> Column:
    """By the title, else by the agency if it is a local government."""
    a = strip(text(agency))
    local = has(a, "(특별시|광역시|특별자치시|특별자치도|도|시|군)$") & ~has(a, "부$|청$|처$|원$|공사$|공단$")
    return F.coalesce(title_region(title, lexicon), F.when(local, sido_of(a, lexicon)))


def country_groups(c: Column, lexicon: Lexicon = KOREAN) -> Column:
    """Array of the country groups that a text names."""
    return F.array_compact(F.array(*(F.when(any_contains(text(c), words), name) for name, words in lexicon.country_groups.items())))


def to_manwon(number: Column, unit: Column) -> Column:
    """An amount in units of 10,000."""
    scale = _literal_map({"억": "10000", "천만": "1000", "백만": "100", "만": "1"})
    return F.replace(number, F.lit(","), F.lit("")).try_cast("double") * F.try_element_at(scale, unit).cast("double")


def amount_text(amount: Column) -> Column:
    """A support amount for people: struct(max_manwon, special_max_manwon, rate, ...)."""
    money = lambda x: F.when(x >= 1000, F.concat(F.format_number(F.rint(x / 100), 0), F.lit("백만원"))).otherwise(F.concat(F.format_number(F.rint(x), 0), F.lit("만원")))
    top, special, rate = amount["max_manwon"], amount["special_max_manwon"], amount["rate"]
    shown = F.concat(
        F.lit("최대 "), money(top),
        F.when(special > 0, F.concat(F.lit(" (특례 "), money(special), F.lit(")"))).otherwise(""),
        F.when(rate > 0, F.concat(F.lit(" · "), rate, F.lit("% 이내"))).otherwise(""),
    )
    return F.when(top > 0, shown).otherwise("공고문 참조")


def early_close(page: Column, doc: Column) -> Column:
    """Whether the page, or the first 5,000 characters of the documents, say that the budget may run out."""
    return has(F.concat(text(page), F.substring(text(doc), 1, 5000)), r"예산\s*소진")


def make_summary(fields: Column, amount: Column, industries: Column, end: Column) -> Column:
    """Two fields, top amount, rate, industries and end in one line."""
    top = amount["max_manwon"]
    money = F.when(top >= 1000, F.concat(F.lit("최대 "), F.format_string("%.0f", F.rint(top / 100)), F.lit("백만원"))).when(top > 0, F.concat(F.lit("최대 "), F.format_string("%.0f", F.rint(top)), F.lit("만원")))
    names = F.slice(F.transform(fields, lambda f: f["field"]), 1, 2)
    return F.concat_ws(
        " | ",
        F.when(F.size(names) > 0, F.array_join(names, "/")),
        money,
        F.when(amount["rate"] > 0, F.concat(amount["rate"], F.lit("% 이내"))),
        F.when(F.size(industries) > 0, F.concat(F.lit("대상:"), F.array_join(industries, "·"))),
        F.when(text(end) != "", F.concat(F.lit("~"), end)),
    )


def fact_line(title: Column, start: Column, end: Column, amount: Column, fields: Column, methods: Column, url: Column) -> Column:
    """A notice in one line."""
    return F.concat(
        title, F.lit(" | 접수 "), text(start), F.lit("~"), F.coalesce(F.nullif(end, F.lit("")), F.lit("상시")), F.lit(" | 지원 "), amount_text(amount),
        F.lit(" | 분야 "), F.array_join(F.transform(fields, lambda f: f["field"]), "·"), F.lit(" | 신청 "), F.array_join(methods, ", "), F.lit(" | "), text(url),
    )


def profile_brief(p: Column, lexicon: Lexicon = KOREAN) -> Column:
    """A company in one line without what identifies it."""
    return mask(
        F.concat_ws(
            " / ",
            F.concat(F.lit("소재지 "), text(p["region"])), F.concat(F.lit("규모 "), text(p["size"])),
            F.concat(F.lit("업종 "), F.array_join(normalize_industries(p["industries"], lexicon), "·")), F.concat(F.lit("품목 "), text(p["items"])),
            F.concat(F.lit("희망국가 "), text(p["target_countries"])), F.concat(F.lit("수출단계 "), text(p["export_stage"])),
            F.concat(F.lit("전년 수출실적 "), F.format_number(F.rint(F.coalesce(p["export_usd"], F.lit(0.0))), 0), F.lit("달러")),
            F.concat(F.lit("직수출 "), F.when(p["direct_export"], "예").otherwise("아니오")), F.concat(F.lit("필요분야 "), F.array_join(F.coalesce(p["needs"], F.array().cast("array<string>")), ", ")),
        )
    )
