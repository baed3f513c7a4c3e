"""Line-level extraction: documents as lines (doc_id, line_no, text) in, structured rows out.

Every window is per document and ordered by line, so one shuffle by doc_id serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.functions import text as tx
from noticeloom.lexicon import KOREAN, Lexicon

# --- fixed values: patterns ----------------------------------------------------------------------------------------

BULLET = "[○◦❍∘•●▪■□◆◇※\\-‐⁃·]"
KEY_VALUE = rf"^\s*{BULLET}?\s*([가-힣A-Za-z()·‧ ]{{2,20}}?)\s*[:：]\s*(.+)$"
HEADINGS = ((1, r"^\s*(\d{1,2})\.\s+(\S.*)$"), (1, r"^\s*([󰊱-󰊹])\s*(\S.*)$"), (1, r"^\s*【\s*(붙임\s*\d+)\s*】\s*(.*)$"), (2, r"^\s*([가-하])\.\s+(\S.*)$"))
MONEY = r"(\d[\d,\.]*)\s*(백만\s*원|백만원|천원|만원|억\s*원|억원|원|만\s*달러|달러|불|USD)"
PERCENT, AREA = r"(\d{1,3}(?:\.\d+)?)\s*%", r"(\d+)\s*㎡"
_Y, _W = r"(20\d{2}|'\d{2})", r"(?:\s*\([월화수목금토일]\))?"
RANGE = rf"{_Y}\s*[.\-]\s*(\d{{1,2}})\s*[.\-]\s*(\d{{1,2}})\.?{_W}\s*~\s*(?:{_Y}\s*[.\-]\s*)?(\d{{1,2}})\s*[.\-]\s*(\d{{1,2}})\.?{_W}(?:\s*(\d{{1,2}}:\d{{2}}))?"
MONTHS = rf"{_Y}\s*\.\s*(\d{{1,2}})\.?\s*~\s*(?:{_Y}\s*\.\s*)?(\d{{1,2}})\.?"
FORM = r"\[?【?\s*붙임\s*(\d+)\s*】?\]?\s*[「]?([^」\n]*?)[」]?\s*(\d+부)?\s*$"
CHECKLIST = r"(지원조건|자격요건|지원대상\s*:.*다음)"
TEMPLATE_CELL = r"(□|:\s*$|:\s*\)|\(\s*\)|월\s*$|㎡|USD|천원)"


def _by_line() -> Window:
    return Window.partitionBy("doc_id").orderBy("line_no")


def find_headings(lines: DataFrame) -> DataFrame:
    """Lines with level (1, 2 or null): the first pattern that a line of fewer than 60 characters meets."""
    level = F.lit(None).cast("int")
    for lv, p in reversed(HEADINGS):
        level = F.when(tx.has(F.col("text"), p), lv).otherwise(level)
    return lines.withColumn("level", F.when(F.length("text") < 60, level))


def section_of(lines: DataFrame) -> DataFrame:
    """Lines with the last level-1 heading and the last level-2 heading under it ('' before any)."""
    x, title = find_headings(lines), tx.clean(F.col("text"))
    w = _by_line().rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("level") == 1, title), ignorenulls=True).over(w)
    sub = F.last(F.when(F.col("level") == 1, F.lit("")).when(F.col("level") == 2, title), ignorenulls=True).over(w)
    return x.withColumn("section", F.coalesce(top, F.lit(""))).withColumn("subsection", F.coalesce(sub, F.lit("")))


def _label() -> Column:
    return tx.squash(F.regexp_extract("text", tx.rx(KEY_VALUE), 1))


def key_values(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, section, subsection, key, value, items): key lines with the run of sub-items directly below."""
    t = tx.strip(F.col("text"))
    is_kv, dash = tx.has(F.col("text"), KEY_VALUE), tx.has(t, r"^[-‐⁃]\s*")
    item = F.when(dash & ~is_kv, F.regexp_replace(t, tx.rx(r"^[-‐⁃]\s*"), "")).when(~dash & t.startswith("※"), t)
    x = section_of(lines).withColumn("item", item)
    x = x.withColumn("run", F.sum(F.when(F.col("item").isNull(), 1).otherwise(0)).over(_by_line()))
    items = F.collect_list(F.when(F.col("item").isNotNull(), F.col("item"))).over(Window.partitionBy("doc_id", "run").orderBy("line_no").rowsBetween(1, 14))
    x = x.withColumn("items", items).withColumn("key", _label()).withColumn("value", tx.clean(F.regexp_extract("text", tx.rx(KEY_VALUE), 2)))
    # a key that is itself an item (a note) has the items that follow it in the same run
    return x.where(is_kv & (F.col("value") != "") & (F.length("key") <= 12)).select("doc_id", "line_no", "section", "subsection", "key", "value", "items")


def topics(kv: DataFrame, lexicon: Lexicon = KOREAN) -> DataFrame:
    """Key values with the topic that their key names (one row per topic)."""
    named = F.array_compact(F.array(*(F.when(F.col("key").isin(*{"".join(k.split()) for k in keys}), topic) for topic, keys in lexicon.topics.items())))
    return kv.withColumn("topic", F.explode(named))


def _year(c: Column) -> Column:
    return F.when(c.startswith("'"), F.concat(F.lit("20"), F.substring(c, 2, 2))).otherwise(c)


def _matches(x: DataFrame, pattern: str, groups: int) -> DataFrame:
    """A row per match with columns g1..gn."""
    found = F.posexplode(tx.extract_all(F.col("text"), pattern)).alias("at", "m")
    x = x.select("*", found)
    return x.select("*", *(F.regexp_extract("m", tx.rx(pattern), g).alias(f"g{g}") for g in range(1, groups + 1)))


def schedule(lines: DataFrame, today: str) -> DataFrame:
    """Date ranges with days left and status; without a second year an end before the start is in the next."""
    x = _matches(section_of(lines), RANGE, 7)
    y1 = _year(F.col("g1"))
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "y-M-d")
    x = x.withColumn("start", day(y1, F.col("g2"), F.col("g3"))).withColumn("end", day(F.when(F.col("g4") != "", _year(F.col("g4"))).otherwise(y1), F.col("g5"), F.col("g6")))
    x = x.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    x = x.withColumn("end", F.when((F.col("end") < F.col("start")) & (F.col("g4") == ""), F.add_months("end", 12)).otherwise(F.col("end"))).withColumn("key", _label())
    one = Window.partitionBy("doc_id", "start", "end", "key", "subsection").orderBy("line_no", "at")
    x = x.withColumn("__n", F.row_number().over(one)).where("__n = 1")
    d = F.datediff("end", F.to_date(F.lit(today)))
    status = F.when(d < 0, "마감").when(F.col("start") <= F.to_date(F.lit(today)), "진행중").otherwise("예정")
    label = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("key", "subsection", "section")), F.lit(""))
    return x.select("doc_id", "line_no", "section", "subsection", label.alias("label"), F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), F.col("g7").alias("time"), d.alias("d_day"), status.alias("status"), tx.clean(F.col("text")).alias("line"))


def month_ranges(lines: DataFrame) -> DataFrame:
    """Ranges of months, on lines without a range of days."""
    x = _matches(section_of(lines).where(~tx.has(F.col("text"), RANGE)), MONTHS, 4)
    y1 = _year(F.col("g1"))
    month = lambda y, m: F.concat(y, F.lit("-"), F.lpad(m, 2, "0"))
    label = F.coalesce(*(F.nullif(c, F.lit("")) for c in (_label(), F.col("subsection"), F.col("section"))), F.lit(""))
    return x.select("doc_id", "line_no", "section", "subsection", label.alias("label"), month(y1, F.col("g2")).alias("start"), month(F.when(F.col("g3") != "", _year(F.col("g3"))).otherwise(y1), F.col("g4")).alias("end"), F.lit("월단위").alias("status"), tx.clean(F.col("text")).alias("line"))


def requirements(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, title, items): the items listed after a checklist's title; notes join the item above, the
    first other line after an item ends the list."""
    t = tx.strip(F.col("text"))
    title = tx.has(t, CHECKLIST)
    item = ~title & tx.has(t, r"^([-‐⁃]|\d\))\s*") & (F.length(t) < 150)
    note = ~title & ~item & t.startswith("※")
    x = lines.withColumn("__list", F.sum(title.cast("int")).over(_by_line())).where("__list > 0")
    w = Window.partitionBy("doc_id", "__list").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__item", item.cast("int")).withColumn("__title", title).withColumn("__note", note).withColumn("__items", F.sum("__item").over(w))
    ends = ~F.col("__title") & (F.col("__item") == 0) & ~F.col("__note") & (F.col("__items") > 0)
    x = x.withColumn("__over", F.max(ends.cast("int")).over(w)).where("__over = 0 AND (__title OR __items > 0)")
    part = F.when(F.col("__title"), tx.clean(F.col("text"))).when(F.col("__item") == 1, F.regexp_replace(t, tx.rx(r"^([-‐⁃]|\d\))\s*"), "")).otherwise(F.concat(F.lit("  ("), t, F.lit(")")))
    x = x.groupBy("doc_id", "__list", "__items").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", part.alias("p")))), lambda p: p["p"]), "").alias("text"))
    x = x.groupBy("doc_id", "__list").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("__items", "text"))).alias("parts"))
    return x.where(F.size("parts") > 1).select("doc_id", "line_no", F.element_at("parts", 1)["text"].alias("title"), F.transform(F.slice("parts", 2, 1 << 20), lambda p: p["text"]).alias("items"))


def numbers(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, value, unit, context): money, percent and area mentions."""
    out = None
    for kind, pattern, groups in (("money", MONEY, 2), ("percent", PERCENT, 1), ("area", AREA, 1)):
        x = _matches(lines, pattern, groups)
        unit = tx.squash(F.col("g2")) if groups > 1 else F.lit("%" if kind == "percent" else "㎡")
        x = x.select("doc_id", "line_no", F.lit(kind).alias("kind"), F.col("g1").alias("value"), unit.alias("unit"), F.substring(tx.clean(F.col("text")), 1, 120).alias("context"))
        out = x if out is None else out.unionByName(x)
    return out


def forms(lines: DataFrame) -> DataFrame:
    """(doc_id, no, title): the attachments that a document lists."""
    title = tx.clean(F.regexp_replace(F.regexp_extract("text", tx.rx(FORM), 2), "^[ \\-「」]+|[ \\-「」]+$", ""))
    x = lines.where(tx.has(F.col("text"), FORM) & (F.length("text") < 120) & (tx.strip(F.regexp_extract("text", tx.rx(FORM), 2)) != ""))
    return x.select("doc_id", F.regexp_extract("text", tx.rx(FORM), 1).try_cast("int").alias("no"), title.alias("title")).distinct()


def pick_lines(lines: DataFrame, pattern: str, limit: int = 6, most: int = 160) -> DataFrame:
    """(doc_id, lines): lines that meet the pattern with up to two detail lines below each, distinct but for spaces.

    After the line that brings the number to ``limit`` no further one is looked at."""
    x = lines.withColumn("text", tx.strip(F.col("text"))).where("text <> ''")
    w = _by_line()
    hit, detail = tx.has(F.col("text"), pattern), tx.has(F.col("text"), r"^[-‐⁃※*]")
    x = x.withColumn("__hit", hit).withColumn("__detail", detail)
    one, two = F.lag("__hit", 1, False).over(w), F.lag("__hit", 2, False).over(w)
    x = x.withColumn("__below1", one & F.col("__detail")).withColumn("__below2", two & F.lag("__detail", 1, False).over(w) & F.col("__detail"))
    shown = tx.clean(F.col("text"))
    put = F.array_compact(F.array(F.when(F.col("__below2"), F.struct((F.col("line_no") * 4 + 1).alias("o"), F.concat(F.lit("  "), F.substring(shown, 1, most)).alias("l"))), F.when(F.col("__below1"), F.struct((F.col("line_no") * 4 + 2).alias("o"), F.concat(F.lit("  "), F.substring(shown, 1, most)).alias("l"))), F.when(F.col("__hit"), F.struct((F.col("line_no") * 4 + 3).alias("o"), F.substring(shown, 1, most).alias("l")))))
    x = x.withColumn("__put", put).withColumn("__block", F.sum(F.col("__hit").cast("int")).over(w))
    x = x.withColumn("__before", F.coalesce(F.sum(F.size("__put")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.max(F.when(F.col("__hit"), F.col("__before"))).over(Window.partitionBy("doc_id", "__block"))
    x = x.withColumn("__start", start).where((F.col("__block") > 0) & (F.size("__put") > 0) & (F.col("__start") < limit)).select("doc_id", F.explode("__put").alias("p")).select("doc_id", "p.o", "p.l")
    key = Window.partitionBy("doc_id", tx.squash(F.col("l"))).orderBy("o")
    x = x.withColumn("__n", F.row_number().over(key)).where("__n = 1")
    return x.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda p: p["l"]).alias("lines"))


# --- tables in documents -------------------------------------------------------------------------------------------


def expand_cells(cells: DataFrame) -> DataFrame:
    """(doc_id, table_no, row, col, text): merged cells fill their span; of cells in one place the later wins."""
    x = cells.withColumn("row", F.explode(F.sequence("row", F.col("row") + F.greatest(F.col("row_span"), F.lit(1)) - 1)))
    x = x.withColumn("col", F.explode(F.sequence("col", F.col("col") + F.greatest(F.col("col_span"), F.lit(1)) - 1)))
    return x.groupBy("doc_id", "table_no", "row", "col").agg(F.max_by("text", "cell_order").alias("text"))


def table_rows(grid: DataFrame) -> DataFrame:
    """(doc_id, table_no, row, cells): a row's cells in order, equal neighbours once."""
    x = grid.groupBy("doc_id", "table_no", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", tx.text(F.col("text")).alias("text")))), lambda c: c["text"]).alias("cells"))
    return x.withColumn("cells", F.filter("cells", lambda c, i: (i == 0) | (c != F.coalesce(F.try_element_at("cells", i), F.lit("\x00")))))


def inline_tables(lines: DataFrame, grid: DataFrame) -> DataFrame:
    """(doc_id, text): lines joined, with each table's text at its placeholder (its first occurrence)."""
    rows = table_rows(grid).where(F.exists("cells", lambda c: c != ""))
    row = F.array_join(F.transform("cells", lambda c: F.replace(c, F.lit("\n"), F.lit(" "))), " | ")
    tables = rows.groupBy("doc_id", "table_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", row.alias("t")))), lambda r: r["t"]), "\n").alias("table_text"))
    x = lines.withColumn("table_no", F.regexp_extract("text", r"\[표 ([0-9]+)\]", 1).try_cast("int"))
    x = x.withColumn("__n", F.when(F.col("table_no").isNotNull(), F.row_number().over(Window.partitionBy("doc_id", "table_no").orderBy("line_no"))))
    x = x.join(tables, ["doc_id", "table_no"], "left")
    text = F.when((F.col("__n") == 1) & F.col("table_text").isNotNull(), F.concat(F.regexp_extract("text", r"(?s)^(.*?)\[표 [0-9]+\]", 1), F.col("table_text"), F.regexp_extract("text", r"(?s)^.*?\[표 [0-9]+\](.*)$", 1))).otherwise(F.col("text"))
    return x.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))), lambda p: p["t"]), "\n").alias("text"))


def blank_fields(grid: DataFrame) -> DataFrame:
    """(doc_id, table_no, fields): what a form asks for, in tables of three rows and three such fields at least."""
    x = table_rows(grid).withColumn("rows", F.count("*").over(Window.partitionBy("doc_id", "table_no")))
    label = F.try_element_at(F.filter("cells", lambda c: c != ""), F.lit(1))
    blank = F.exists(F.slice("cells", 2, 1 << 20), lambda c: (c == "") | tx.has(c, TEMPLATE_CELL))
    shown = F.array_join(F.filter(F.slice("cells", 1, 2), lambda c: c != ""), " / ")
    x = x.where((F.col("rows") >= 3) & label.isNotNull() & blank & (F.length(label) < 40))
    x = x.groupBy("doc_id", "table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", shown.alias("f")))), lambda p: p["f"]).alias("fields"))
    return x.where(F.size("fields") >= 3)


