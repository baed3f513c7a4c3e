"""Filters, joins, aggregates, ranks and set operations over the notice tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom import lexicon as lex
from noticeloom.functions import text as tx



# --- filters -------------------------------------------------------------------------------------------------------


def filter_status(df: DataFrame, status: str | None) -> DataFrame:
    """Rows whose status contains ``status``; everything for None, "all" or "전체"."""
    return df if status in (None, "", "all", "전체") else df.where(F.col("status").contains(status))


def representatives(df: DataFrame) -> DataFrame:
    return df.where(F.col("dup_of").isNull())


def publishable(df: DataFrame, today: str, days: int = 60) -> DataFrame:
    """Open notices, and those that ended at most ``days`` ago."""
    return df.where(tx.text(F.col("status")).contains(lex.OPEN) | (tx.text(F.col("receipt_end")) >= F.date_sub(F.to_date(F.lit(today)), days).cast("string")))


def filter_keyword(df: DataFrame, keyword: str, column: str = "title") -> DataFrame:
    """Rows whose title holds the keyword, white space aside on both sides."""
    return df.where(F.contains(tx.squash(F.col(column)), tx.squash(F.lit(keyword))))


def search_catalog(df: DataFrame, q: str) -> DataFrame:
    return df.where(F.concat(tx.text(F.col("title")), F.coalesce(F.to_json("fields"), F.lit(""))).contains(q))


def subscriber_filter(pairs: DataFrame) -> DataFrame:
    """Pairs that meet a subscriber's own conditions (columns score, min_score, source, sources, keywords, title,
    summary, fields, section_text)."""
    hay = F.lower(F.concat_ws(" ", tx.text(F.col("title")), tx.text(F.col("summary")), F.array_join("fields", " "), F.substring(tx.text(F.col("section_text")), 1, 3000)))
    some = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    return pairs.where(
        (F.col("score") >= F.greatest(F.lit(lex.ALERT_MIN), F.coalesce("min_score", F.lit(lex.ALERT_MIN))))
        & (~some("sources") | F.array_contains(F.coalesce("sources", F.array().cast("array<string>")), F.col("source")))
        & (~some("keywords") | F.exists("keywords", lambda k: F.contains(hay, F.lower(k))))
    )


def body_documents(docs: DataFrame, suffixes: tuple[str, ...] = (".xlsx", ".xlsm", ".xls")) -> DataFrame:
    """Documents but spreadsheets."""
    name = F.lower(tx.text(F.col("file_name")))
    keep = F.lit(True)
    for s in suffixes:
        keep = keep & ~name.endswith(s)
    return docs.where(keep)


def clean_conditions(df: DataFrame) -> DataFrame:
    """A subscriber's conditions with defaults: scores from 70 to 100, comma lists as arrays, today's industries."""
    listed = lambda c: F.filter(F.transform(F.split(tx.text(F.col(c)), ","), tx.strip), lambda x: x != "")
    return df.select(
        *(c for c in df.columns if c not in ("min_score", "industries", "needs", "keywords", "sources", "export_usd", "direct_export", "listed")),
        F.greatest(F.lit(lex.ALERT_MIN), F.least(F.lit(100), F.coalesce(F.col("min_score").try_cast("int"), F.lit(lex.ALERT_MIN)))).alias("min_score"),
        tx.normalize_industries(listed("industries")).alias("industries"),
        *(listed(c).alias(c) for c in ("needs", "keywords", "sources")),
        F.coalesce(F.col("export_usd").try_cast("double"), F.lit(0.0)).alias("export_usd"),
        F.coalesce(F.col("direct_export").try_cast("boolean"), F.lit(True)).alias("direct_export"),
        F.coalesce(F.col("listed").try_cast("boolean"), F.lit(False)).alias("listed"),
    )


def active_subscribers(df: DataFrame) -> DataFrame:
    """Active subscribers with a valid address; conditions that wait for confirmation replace the current ones."""
    good = F.col("email").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$") & (F.col("status") == "active")
    return df.where(good).withColumn("conditions", F.coalesce(F.nullif("pending", F.lit("")), F.col("conditions"))).withColumn("pending", F.lit(None).cast("string"))


def standardize_listing(df: DataFrame, source: str, id_prefix: str, columns: dict[str, str], detail_url: str = "") -> DataFrame:
    """A source's rows as common notices. ``columns`` names the source's columns: id, title, period, status, and the
    parts of the subtitle (subtitle1, subtitle2), agency, phone, email."""
    get = lambda k: tx.clean(F.col(columns[k])) if k in columns else F.lit("")
    period = tx.parse_period(get("period"))
    subtitle = F.array_join(F.filter(F.array(get("subtitle1"), get("subtitle2")), lambda x: x != ""), " · ")
    out = df.select(
        F.concat(F.lit(id_prefix), get("id")).alias("project_no"), F.lit(source).alias("source"), get("title").alias("title"), subtitle.alias("subtitle"),
        get("period").alias("period"), period["start"].cast("string").alias("receipt_start"), period["end"].cast("string").alias("receipt_end"),
        tx.normalize_status(get("status"), source).alias("status"), F.concat(F.lit(detail_url), get("id")).alias("detail_url"),
        F.create_map(F.lit("소속"), get("agency"), F.lit("전화번호"), get("phone"), F.lit("이메일"), get("email")).alias("contact"),
    )
    return out.where((get_id := F.col("project_no")).isNotNull() & (F.length(get_id) > len(id_prefix)) & (F.col("title") != ""))


# --- joins ---------------------------------------------------------------------------------------------------------


def attach_also(notices: DataFrame) -> DataFrame:
    """Representatives with the array of their duplicates, in order of id."""
    also = notices.where(F.col("dup_of").isNotNull()).groupBy(F.col("dup_of").alias("__of")).agg(F.array_sort(F.collect_list(F.struct("project_no", "source", "title"))).alias("also"))
    none = F.array().cast(also.schema["also"].dataType)
    return representatives(notices).join(also, F.col("project_no") == F.col("__of"), "left").drop("__of").withColumn("also", F.coalesce("also", none))


def new_items(matches: DataFrame, sent: DataFrame) -> DataFrame:
    """Matches not sent yet."""
    return matches.join(sent, ["sub_key", "project_no"], "left_anti")


def snapshot_diff(known: DataFrame, listing: DataFrame, ok_sources: DataFrame, force: bool = False) -> DataFrame:
    """(project_no, source, action): close, reopen, skip, analyze or none.

    known: project_no, source, status, attachment_names; listing: open notices with project_no, source,
    attachment_names; ok_sources: sources whose listing came through. Names in another order count as changed."""
    k = known.select("project_no", F.col("source").alias("known_source"), F.col("status").alias("known_status"), F.col("attachment_names").alias("known_names"))
    x = listing.join(k, "project_no", "full_outer").withColumn("src", F.coalesce("source", "known_source"))
    x = x.join(ok_sources.select(F.col("source").alias("src"), F.lit(True).alias("ok")), "src", "left")
    was_open = tx.text(F.col("known_status")).contains(lex.OPEN)
    gone, new = F.col("source").isNull(), F.col("known_source").isNull()
    same = F.coalesce("known_names", F.array().cast("array<string>")) == F.coalesce("attachment_names", F.array().cast("array<string>"))
    action = (
        F.when(F.col("ok").isNull(), "none").when(gone, F.when(was_open, "close").otherwise("none"))
        .when(new | ~same | F.lit(force), "analyze").when(was_open, "skip").otherwise("reopen")
    )
    return x.select("project_no", F.col("src").alias("source"), action.alias("action"))


def semi_chunks(chunks: DataFrame, notices: DataFrame) -> DataFrame:
    return chunks.join(notices.select("project_no"), "project_no", "left_semi")


def resolve_hits(hits: DataFrame, notices: DataFrame) -> DataFrame:
    """Hits with the notice that stands for theirs: its representative if that exists, else itself."""
    own = notices.select("project_no", "dup_of")
    reps = notices.select(F.col("project_no").alias("__rep"))
    x = hits.join(own, "project_no", "left").join(reps, F.col("dup_of") == F.col("__rep"), "left")
    return x.withColumn("notice_no", F.coalesce("__rep", "project_no")).drop("dup_of", "__rep")


def eligible_messages(messages: DataFrame, subscribers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages to active subscribers, and the others."""
    m = messages.withColumn("__to", F.lower(tx.strip(F.col("to"))))
    s = active_subscribers(subscribers).select(F.lower(tx.strip(F.col("email"))).alias("__to")).distinct()
    return m.join(s, "__to", "left_semi").drop("__to"), m.join(s, "__to", "left_anti").drop("__to")


# --- aggregates ----------------------------------------------------------------------------------------------------


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"))


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("n"))


def publish_metrics(df: DataFrame) -> DataFrame:
    is_open = tx.text(F.col("status")).contains(lex.OPEN)
    return df.agg(F.count_if(is_open & F.col("dup_of").isNull()).alias("count_open"), F.count_if(F.col("dup_of").isNotNull()).alias("count_dups"), F.count("*").alias("count_total"))


def dashboard(notices: DataFrame, profiles: DataFrame, today: str, k: int = 5) -> dict[str, DataFrame]:
    """Counts of open and soon due notices and of profiles; the k fields with most open notices."""
    open_ = representatives(filter_status(notices, lex.OPEN))
    d = tx.d_day(F.col("receipt_end"), today)
    counts = open_.agg(F.count("*").alias("n_open"), F.count_if(d.between(0, 14)).alias("n_due")).crossJoin(profiles.agg(F.count("*").alias("n_profiles")))  # one row each
    fields = open_.select(F.explode("fields.field").alias("field")).groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field").limit(k)
    return {"counts": counts, "fields": fields}


def top_notice(hits: DataFrame, n: int = 4) -> DataFrame:
    """(query_id, project_no): the notice with the largest sum of rounded scores among a query's first hits."""
    x = hits.where(F.col("rank") <= n).groupBy("query_id", "project_no").agg(F.round(F.sum(F.round("score", 2)), 6).alias("total"), F.min("rank").alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("total"), "first")
    return x.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("query_id", "project_no", "total")


def notice_text(docs: DataFrame) -> DataFrame:
    """(project_no, text): a notice's documents in order, a line break between."""
    parts = F.array_sort(F.collect_list(F.struct("doc_seq", tx.text(F.col("text")).alias("text"))))
    return docs.groupBy("project_no").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def document_stats(docs: DataFrame) -> DataFrame:
    return docs.select("project_no", "file_name", F.length(tx.text(F.col("text"))).alias("chars"), "n_tables", F.size(tx.lines(F.col("text"))).alias("paragraphs"))


def contacts(docs: DataFrame) -> DataFrame:
    """(project_no, emails, phones): distinct and sorted over a notice's texts.

    Values are made distinct before they meet by notice, so no text's array is carried twice."""
    found = lambda kind, f: docs.select("project_no", F.lit(kind).alias("kind"), F.explode(f(F.col("text"))).alias("value"))
    values = found("emails", tx.emails).unionAll(found("phones", tx.phones)).distinct()
    gather = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))).alias(kind)
    every = docs.select("project_no").distinct().withColumn("kind", F.lit("")).withColumn("value", F.lit(None).cast("string"))
    return values.unionByName(every).groupBy("project_no").agg(gather("emails"), gather("phones"))


def update_sent_state(sent: DataFrame, delivered: DataFrame, open_ids: DataFrame) -> DataFrame:
    """What has been sent to each subscriber: of the past what is still open, and what has just been delivered."""
    past = sent.join(open_ids, "project_no", "left_semi").select("sub_key", "project_no")
    kept = past.join(delivered.select("sub_key").distinct(), "sub_key", "left_semi").unionByName(sent.join(delivered.select("sub_key").distinct(), "sub_key", "left_anti").select("sub_key", "project_no"))
    return kept.unionByName(delivered.select("sub_key", "project_no")).distinct()


def update_sub_state(state: DataFrame, delivered: DataFrame, subscribers: DataFrame, today: str) -> DataFrame:
    """(sub_key, since, last): a record for every subscriber from the first contact on."""
    keys = state.select("sub_key").unionByName(subscribers.select("sub_key")).distinct()
    got = delivered.select("sub_key", F.lit(today).alias("now")).distinct()
    return keys.join(state, "sub_key", "left").join(got, "sub_key", "left").select("sub_key", F.coalesce("since", F.lit(today)).alias("since"), F.coalesce("now", "last").alias("last"))


def next_deadline(schedule: DataFrame, key: str = "doc_id") -> DataFrame:
    return schedule.where("d_day >= 0").groupBy(key).agg(F.min(F.struct("d_day", "end", "label")).alias("next"))


def digest_totals(digest: DataFrame) -> DataFrame:
    return digest.agg(F.countDistinct("sub_key").alias("n_messages"), F.count("*").alias("n_items"))


# --- ranks ---------------------------------------------------------------------------------------------------------


def rank_matches(df: DataFrame, key: str = "profile_id") -> DataFrame:
    """Rank per profile: eligible first, then score, days left (none last) and id."""
    w = Window.partitionBy(key).orderBy(F.col("eligible").desc(), F.col("score").desc(), F.coalesce("d_day", F.lit(9999)), "project_no")
    return df.withColumn("rank", F.row_number().over(w))


def order_by_deadline(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("receipt_end").asc_nulls_last(), "project_no")


def due_soon(df: DataFrame, today: str, k: int = 8) -> DataFrame:
    d = tx.d_day(F.col("receipt_end"), today)
    return df.withColumn("d_day", d).where("d_day >= 0").orderBy("d_day", "project_no").limit(k)


def order_alerts(df: DataFrame) -> DataFrame:
    return df.orderBy(F.coalesce("d_day", F.lit(999)), F.col("score").desc(), "profile_id", "project_no")


def first_seen_dedupe(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def source_priority(source: Column) -> Column:
    table = F.create_map(*(F.lit(x) for i, s in enumerate(lex.SOURCE_ORDER) for x in (s, i)))
    return F.coalesce(F.try_element_at(table, source), F.lit(99))


def representative_rank(df: DataFrame) -> DataFrame:
    """``rank_key``, whose order is the order in which notices may stand for others."""
    return df.withColumn("rank_key", F.struct(source_priority(F.col("source")).alias("priority"), tx.text(F.col("first_seen")).alias("first_seen"), F.col("project_no")))


def top_fields(scored: Column, share: float = 0.25, k: int = 4) -> Column:
    """Of an array of (field, score, ...) in lexicon order those with at least a share of the top score; ties keep
    their order."""
    top = F.array_max(F.transform(scored, lambda f: f["score"]))
    near = F.filter(F.transform(scored, lambda f, i: F.struct((-f["score"]).alias("__s"), i.alias("__i"), f.alias("f"))), lambda x: x["f"]["score"] >= top * share)
    ordered = F.array_sort(near, lambda a, b: F.when(a["__s"] < b["__s"], -1).when(a["__s"] > b["__s"], 1).when(a["__i"] < b["__i"], -1).otherwise(1))
    return F.transform(F.slice(ordered, 1, k), lambda x: x["f"])


def digest_items(df: DataFrame, max_items: int = 15) -> DataFrame:
    """A subscriber's first items, and how many more there are."""
    w = Window.partitionBy("sub_key")
    x = df.withColumn("__n", F.row_number().over(w.orderBy(F.col("score").desc(), F.coalesce("d_day", F.lit(9999)), "project_no"))).withColumn("__all", F.count("*").over(w))
    return x.where(F.col("__n") <= max_items).withColumn("n_more", F.greatest(F.col("__all") - max_items, F.lit(0))).withColumnRenamed("__n", "item").drop("__all")


def delivery_batches(messages: DataFrame, size: int = 20, quota: int = 100) -> DataFrame:
    """The first ``quota`` messages in batches: a day's quota bounds the rows that the rank is taken over."""
    first = messages.orderBy("sub_key").limit(quota)
    return first.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("sub_key")) - 1) / size).cast("int"))


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Sources as one table; columns that one lacks are null."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
