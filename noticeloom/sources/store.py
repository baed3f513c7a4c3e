"""Reading, writing and updating the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.functions import text as tx
from noticeloom.operators import tables

RULES = "array<struct<rule:string,evidence:string>>"
#: JSON columns of stored notices and their types.
NESTED = {
    "fields": "array<struct<field:string,score:double,evidence:array<string>>>",
    "target": f"struct<industries:array<string>,company_types:array<string>,regions:array<string>,excludes:{RULES},requires:{RULES},prefers:{RULES},tiers:{RULES},countries:array<string>,text:array<string>,basis:map<string,struct<from:string,evidence:string>>>",
    "amount": "struct<max_manwon:double,special_max_manwon:double,special_countries:array<string>,rate:int,evidence:array<string>>",
    "apply": "struct<methods:array<string>,emails:array<string>,phones:array<string>,lines:array<string>,doc_lines:array<string>,contact:map<string,string>>",
    "sections": "map<string,string>",
    "attachments": "array<struct<name:string,files:array<string>>>",
}
LISTING = "struct<data:array<struct<SP_SEQ:string,js_title:string,STS_TXT:string,SGI:string,GI:string,start_dt:string,end_dt:string,CODE_KR:string,CATEGORY_NAME:string,contents:string>>>"


def read_notices(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored notices, decoded."""
    return decode_notices(spark.read.format(fmt).load(path))


def decode_notices(df: DataFrame) -> DataFrame:
    """Columns ``x_json`` decoded to ``x``; null stays null."""
    for name, kind in NESTED.items():
        if f"{name}_json" in df.columns:
            df = df.withColumn(name, F.from_json(f"{name}_json", kind)).drop(f"{name}_json")
    return df


def unescape_html(c):
    """The named and decimal character references that listings hold."""
    for ref, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(ref), F.lit(ch))
    return c


def read_listing_json(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Rows of listing payloads {"data": [...]}; those without id or title are dropped."""
    x = df.select(F.explode(F.from_json(payload_col, LISTING)["data"]).alias("r")).select("r.*")
    x = x.withColumn("id", tx.strip(tx.text(F.col("SP_SEQ")))).withColumn("title", tx.clean(unescape_html(tx.text(F.col("js_title")))))
    period = F.coalesce(F.nullif(tx.strip(tx.text(F.col("SGI"))), F.lit("")), F.concat(tx.text(F.col("start_dt")), F.lit(" ~ "), tx.text(F.col("end_dt"))))
    return x.where("id <> '' AND title <> ''").withColumn("period", period)


def import_profiles(df: DataFrame) -> DataFrame:
    """Profiles from a wide table of strings with the form's headers; rows without a name are skipped."""
    heads = {h.strip(): h for h in df.columns}
    get = lambda h, default="": F.coalesce(F.col(f"`{heads[h]}`").cast("string"), F.lit(default)) if h in heads else F.lit(default)
    yes = lambda c: tx.strip(c).isin("Y", "y", "예", "O", "o", "1", "True", "true", "상장")
    industry = next((h for h in heads if h.replace(" ", "").startswith("업종")), "업종")
    region = F.coalesce(F.nullif(tx.strip(get("소재지(시·도)")), F.lit("")), tx.strip(get("소재지(전남/광주/기타)", "전남")))
    out = df.select(
        tx.strip(get("기업명")).alias("name"), tx.strip(get("사업자번호")).alias("biz_no"), region.alias("region"), tx.strip(get("기업규모", "중소기업")).alias("size"),
        yes(get("상장여부(Y/N)", "N")).alias("listed"), tx.normalize_industries(F.split(get(industry), ",")).alias("industries"), get("주요 수출품목").alias("items"),
        get("HS코드").alias("hs_codes"), get("희망 수출국").alias("target_countries"), get("수출단계", "수출 초보").alias("export_stage"),
        F.coalesce(get("전년도 수출실적(USD)", "0").try_cast("double"), F.lit(0.0)).alias("export_usd"), yes(get("직수출(Y/N)", "Y")).alias("direct_export"),
        yes(get("해외유통매장운영사(Y/N)", "N")).alias("is_overseas_distributor"),
        F.filter(F.transform(F.split(get("필요 지원분야(쉼표구분)"), ","), tx.strip), lambda v: v != "").alias("needs"),
    )
    return out.where("name <> ''")


def upsert_notices(old: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Old notices with the new ones' values by project_no; first_seen stays, is_new marks those not known before."""
    keep = [c for c in old.columns if c not in ("project_no", "first_seen", "last_seen")]
    n = new.select("project_no", F.lit(True).alias("__new"), *(F.col(c).alias(f"__{c}") for c in keep if c in new.columns))
    x = old.withColumn("__old", F.lit(True)).join(n, "project_no", "full_outer")
    pick = lambda c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in new.columns else F.col(c)
    return x.select(
        "project_no", *(pick(c) for c in keep), F.coalesce("first_seen", F.lit(now)).alias("first_seen"),
        F.when(F.col("__new"), F.lit(now)).otherwise(F.col("last_seen")).alias("last_seen"), (F.col("__new").isNotNull() & F.col("__old").isNull()).alias("is_new"),
    )


def replace_children(existing: DataFrame, changed_keys: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Child rows with those of the changed notices replaced."""
    return existing.join(changed_keys.select("project_no").distinct(), "project_no", "left_anti").unionByName(new_rows)


KEEP = ("project_no", "source", "title", "subtitle", "region", "status", "receipt_start", "receipt_end", "detail_url", "summary", "fields", "target", "amount", "apply", "also", "dup_of")


def published(notices: DataFrame, documents: DataFrame, chunks: DataFrame, today: str, sections: DataFrame, days: int = 60) -> dict[str, DataFrame]:
    """The public tables: notices with their documents' figures and sections (doc_id = project_no), their chunks, counts."""
    shown = tables.publishable(notices, today, days)
    stats = tables.document_stats(documents).groupBy("project_no").agg(F.array_sort(F.collect_list(F.struct("file_name", "chars", "n_tables"))).alias("documents"))
    parts = sections.select(F.col("doc_id").alias("project_no"), F.col("sections").alias("doc_sections"))
    return {
        "notices": shown.select(*(c for c in KEEP if c in shown.columns)).join(stats, "project_no", "left").join(parts, "project_no", "left"),
        "chunks": tables.semi_chunks(chunks, shown),
        "metrics": tables.publish_metrics(notices),
    }


def publish(notices: DataFrame, documents: DataFrame, chunks: DataFrame, today: str, sections: DataFrame, out: str, days: int = 60) -> dict[str, DataFrame]:
    """Writes the public tables and returns them."""
    made = published(notices, documents, chunks, today, sections, days)
    for name, df in made.items():
        df.write.mode("overwrite").json(f"{out}/{name}")
    return made


def match_report(matches: DataFrame) -> DataFrame:
    """Ranked matches as flat columns."""
    plus = F.filter("reasons", lambda r: r["type"] == "+")
    return tables.rank_matches(matches).select(
        "name", "rank", "project_no", "title", "score", "grade", "receipt_end", "d_day", tx.amount_text(F.col("amount")).alias("amount"),
        F.array_join(F.transform("fields", lambda f: f["field"]), ", ").alias("fields"),
        F.array_join(F.transform(plus, lambda r: F.concat(F.lit("(+"), r["points"], F.lit(") "), r["text"])), "\n").alias("reasons"),
        F.array_join(F.transform(F.concat("fails", "warnings"), lambda r: r["text"]), "\n").alias("notes"), "detail_url",
    )


def notice_report(notices: DataFrame) -> DataFrame:
    rules = lambda c: F.array_join(F.transform(c, lambda r: r["rule"]), "\n")
    return notices.select(
        "project_no", "title", "status", "receipt_start", "receipt_end", F.when(F.col("early_close") > 0, "예").otherwise("").alias("early_close"),
        F.array_join(F.transform("fields", lambda f: f["field"]), ", ").alias("fields"), *(F.array_join(f"target.{c}", "·").alias(c) for c in ("industries", "company_types", "regions")),
        tx.amount_text(F.col("amount")).alias("amount"), rules("target.excludes").alias("excludes"), rules("target.requires").alias("requires"),
        F.array_join("apply.methods", ", ").alias("methods"), F.array_join("apply.emails", ", ").alias("emails"), "summary", "detail_url",
    )


def alert_report(alerts: DataFrame) -> DataFrame:
    return tables.order_alerts(alerts).select("name", "kind", "title", "score", "d_day", "detail_url")


def append_run(spark: SparkSession, path: str, record: dict) -> None:
    spark.createDataFrame([record], "id int, started_at string, finished_at string, n_list int, n_new int, n_analyzed int, log string").write.mode("append").parquet(path)


def last_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(1)


def analysis_tables(lines: DataFrame, today: str) -> dict[str, DataFrame]:
    """Topics, schedule, requirements, key values and numbers of documents, a table each."""
    from noticeloom.operators import lines as ln

    kv = ln.key_values(lines)
    return {"key_values": kv, "topics": ln.topics(kv), "schedule": ln.schedule(lines, today), "months": ln.month_ranges(lines), "requirements": ln.requirements(lines), "numbers": ln.numbers(lines), "forms": ln.forms(lines)}


def write_tables(made: dict[str, DataFrame], out: str, fmt: str = "parquet") -> None:
    for name, df in made.items():
        df.write.mode("overwrite").format(fmt).save(f"{out}/{name}")


