"""Record linkage: the same notice published by several sources.

Candidates come from an exact prefix-filter join: grams are ordered by how many notices hold them, rarest first, and
two sets of the threshold's similarity share one of their first few. What passes is verified exactly, so no pair is
lost and frequent grams are hardly ever join keys. Notices of one source that the rules cannot tell apart are one kind:
kinds are compared, not their members, so a title that thousands of notices have makes no pairs of them."""

from __future__ import annotations

from collections import defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom import lexicon as lex
from noticeloom.functions import text as tx
from noticeloom.operators import tables
from noticeloom.sources.staging import stage


def fingerprints(notices: DataFrame, docs: DataFrame) -> DataFrame:
    """(project_no, source, end, title_grams, doc_grams, stems, regions, rank_key) of each notice."""
    body = tables.notice_text(tables.body_documents(docs)).select("project_no", F.substring(tx.squash(F.col("text")), 1, 4000).alias("body"))
    files = docs.groupBy("project_no").agg(F.collect_set(tx.file_stem(F.col("file_name"))).alias("file_stems"))
    none = F.array().cast("array<string>")
    names = F.transform(F.coalesce("attachments", F.array().cast("array<struct<name:string,files:array<string>>>")), lambda a: tx.file_stem(a["name"]))
    x = notices.join(body, "project_no", "left").join(files, "project_no", "left")
    x = tables.representative_rank(x.withColumn("source", tx.source_of(F.col("project_no"))))
    return x.select(
        "project_no", "source", F.substring(tx.text(F.col("receipt_end")), 1, 10).alias("end"),
        tx.char_ngrams(tx.norm_title(F.col("title")), 2).alias("title_grams"),
        F.when(F.length("body") >= 150, tx.char_ngrams(F.col("body"), 3)).otherwise(none).alias("doc_grams"),
        F.array_sort(F.filter(F.array_distinct(F.concat(names, F.coalesce("file_stems", none))), lambda s: s != "")).alias("stems"),
        F.coalesce("target.regions", none).alias("regions"), "rank_key",
    )


def _prefixes(fps: DataFrame, grams: str, keep) -> DataFrame:
    """(project_no, n, gram): each set's first ``keep(n)`` grams in ascending document frequency."""
    exploded = fps.select("project_no", F.size(grams).alias("n"), F.explode(grams).alias("gram"))
    df = exploded.groupBy("gram").agg(F.count("*").alias("df"))
    ordered = exploded.join(df, "gram").groupBy("project_no", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    return ordered.select("project_no", "n", F.explode(F.slice("g", F.lit(1), keep(F.col("n")))).alias("g")).select("project_no", "n", "g.gram")


def _meet(prefix: DataFrame, least_ratio: float) -> DataFrame:
    a, b = prefix.alias("a"), prefix.alias("b")
    sized = (F.col("a.n") >= least_ratio * F.col("b.n")) & (F.col("b.n") >= least_ratio * F.col("a.n"))
    return a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.project_no") != F.col("b.project_no")) & sized).select(F.col("a.project_no").alias("x"), F.col("b.project_no").alias("y"))


def candidate_pairs(fps: DataFrame) -> DataFrame:
    """(a, b): distinct pairs that may be the same notice, a ranking before b."""
    t, d = lex.TITLE_DOC_SIM[0], lex.DOC_SIM
    up = lambda c: F.ceil(c - 1e-9).cast("int")
    docs = _meet(_prefixes(fps, "doc_grams", lambda n: n - up(n * d) + 1), d)
    # a title alone must be nearly the same; one that is only similar counts beside a similar body
    same = lex.TITLE_SIM / (2 - lex.TITLE_SIM)
    titles = _meet(_prefixes(fps, "title_grams", lambda n: n - up(n * same) + 1), same)
    bodies = fps.where(F.size("doc_grams") > 0)
    titles = titles.unionAll(_meet(_prefixes(bodies, "title_grams", lambda n: n - up(n * (t / (2 - t))) + 1), t / (2 - t)))
    # a shared file name counts beside a title half the same: a stock name alone brings nobody together
    s = lex.STEM_TITLE_SIM / (2 - lex.STEM_TITLE_SIM)
    named = _prefixes(fps.where(F.size("stems") > 0), "title_grams", lambda n: n - up(n * s) + 1)
    stems = named.join(fps.select("project_no", F.explode("stems").alias("stem")), "project_no")
    shared = _meet(stems.select("project_no", "n", F.concat_ws("\x01", "stem", "gram").alias("gram")), s)
    pairs = docs.unionAll(titles).unionAll(shared).distinct()
    info = fps.select("project_no", "source", "end", "regions", "rank_key")
    p = pairs.join(info.select(*(F.col(c).alias(f"x_{c}") for c in info.columns)), F.col("x") == F.col("x_project_no"))
    p = p.join(info.select(*(F.col(c).alias(f"y_{c}") for c in info.columns)), F.col("y") == F.col("y_project_no"))
    apart = (F.col("x_source") == F.col("y_source")) | ((F.col("x_end") != "") & (F.col("y_end") != "") & (F.col("x_end") != F.col("y_end")))
    apart = apart | ((F.size("x_regions") > 0) & (F.size("y_regions") > 0) & ~F.arrays_overlap("x_regions", "y_regions"))
    return p.where(~apart & (F.col("x_rank_key") < F.col("y_rank_key"))).select(F.col("x").alias("a"), F.col("y").alias("b"))


def pair_rule(a, b, ds: Column, ts: Column) -> Column:
    """struct(score, reason) of two fingerprints given as name -> column, with the similarity of their bodies and of
    their titles; score 0 means different notices. The first rule that holds decides."""
    local = lambda x: F.size(x("regions")) > 0
    percent = lambda x: F.concat(F.format_string("%.0f", F.rint(x * 100)), F.lit("%"))
    give = lambda score, reason: F.struct(score.cast("double").alias("score"), reason.alias("reason"))
    no = give(F.lit(0.0), F.lit(""))
    return (
        F.when(a("source") == b("source"), no)
        .when((a("end") != "") & (b("end") != "") & (a("end") != b("end")), no)
        .when(local(a) & local(b) & ~F.arrays_overlap(a("regions"), b("regions")), no)
        .when(ds >= lex.DOC_SIM, give(0.5 + ds / 2, F.concat(F.lit("첨부 공고문 본문 일치("), percent(ds), F.lit(")"))))
        .when(F.arrays_overlap(a("stems"), b("stems")) & (ts >= lex.STEM_TITLE_SIM), give(0.7 + ts / 4, F.lit("첨부파일 이름 일치")))
        .when(local(a) != local(b), no)
        .when((ts >= lex.TITLE_SIM) & ((a("end") != "") | (b("end") != "")), give(0.4 + ts / 2, F.concat(F.lit("제목 일치("), percent(ts), F.lit(")"))))
        .when((ts >= lex.TITLE_DOC_SIM[0]) & (ds >= lex.TITLE_DOC_SIM[1]), give(0.3 + (ts + ds) / 4, F.concat(F.lit("제목·본문 유사("), percent(ts), F.lit("/"), percent(ds), F.lit(")"))))
        .otherwise(no)
    )


def pair_score(pairs: DataFrame, fps: DataFrame) -> DataFrame:
    """(a, b, b_source, rank_a, rank_b, score, reason) of the pairs that are the same notice."""
    side = lambda s: fps.select(*(F.col(c).alias(f"{s}_{c}") for c in fps.columns))
    x = pairs.join(side("l"), F.col("a") == F.col("l_project_no")).join(side("r"), F.col("b") == F.col("r_project_no"))
    x = x.withColumn("ds", tx.jaccard(F.col("l_doc_grams"), F.col("r_doc_grams"))).withColumn("ts", tx.dice(F.col("l_title_grams"), F.col("r_title_grams")))
    found = pair_rule(lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}"), F.col("ds"), F.col("ts"))
    x = x.withColumn("found", found).where("found.score > 0")
    return x.select("a", "b", F.col("r_source").alias("b_source"), F.col("l_rank_key").alias("rank_a"), F.col("r_rank_key").alias("rank_b"), F.round("found.score", 6).alias("score"), "found.reason")


def choose(kinds: list, sources: list, edges: list[tuple]) -> list[tuple[int, int, str]]:
    """(b, a, reason): the greedy choice among notices given by their kinds, in order of rank; edges are (score, kind of
    a, kind of b, source of b, reason).

    Best scores first, each b in order takes the first a that is no duplicate and has none of b's source. What a kind can
    still give to a source only shrinks, so its first one is a place that moves on: work is notices and kinds met, not pairs."""
    of = defaultdict(list)
    for i, kind in enumerate(kinds):
        of[kind].append(i)
    free = {k: np.array(v, np.int64) for k, v in of.items()}
    done, gone, took, place, out = np.zeros(len(kinds), bool), bytearray(len(kinds)), [0] * len(kinds), defaultdict(int), []
    bit = {s: 1 << i for i, s in enumerate(sorted(set(sources)))}

    def first(kind, mask: int) -> int | None:
        held, i = of[kind], place[kind, mask]
        while i < len(held) and (gone[held[i]] or took[held[i]] & mask):
            i += 1
        place[kind, mask] = i
        return held[i] if i < len(held) else None

    for _, level in groupby(sorted(edges, key=lambda e: -e[0]), key=lambda e: e[0]):
        near, mask = defaultdict(list), {}
        for _, x, y, source, reason in level:
            near[y].append((x, reason))
            mask[y] = bit[source]
        near = {y: xs for y, xs in near.items() if any(first(x, mask[y]) is not None for x, _ in xs)}
        for y in near:
            free[y] = free[y][~done[free[y]]]
        for b in np.sort(np.concatenate([free[y] for y in near])).tolist() if near else ():
            y = kinds[b]
            if took[b]:
                continue
            found = [(a, reason) for x, reason in near[y] if (a := first(x, mask[y])) is not None and a < b]
            if found:
                a, reason = min(found)
                gone[b], took[a] = 1, took[a] | mask[y]
                done[b] = done[a] = True
                out.append((b, a, reason))
    return out


def _components(edges: DataFrame) -> DataFrame:
    """(kind, component) of the kinds that edges (a, b) connect: the smallest one reachable."""
    near = stage(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    of = stage(near.select(F.col("a").alias("kind"), F.col("a").alias("component")).distinct())
    while True:
        least = near.join(of.withColumnRenamed("kind", "b"), "b").groupBy(F.col("a").alias("kind")).agg(F.min("component").alias("least"))
        new = stage(of.join(least, "kind").select("kind", F.least("component", "least").alias("component")))
        new = stage(new.join(new.select(F.col("kind").alias("component"), F.col("component").alias("next")), "component").select("kind", F.col("next").alias("component")))
        if new.join(of, ["kind", "component"], "left_anti").isEmpty():
            return new
        of = new


def assign_members(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_no, dup_of, dup_reason) of members (project_no, kind, rank: struct priority, first_seen, project_no) of
    kinds that edges (a, b, b_source, score, reason) name the same: greedy, the best score first, ties by the order of
    b, then of a. A notice is a duplicate once, or a representative, which takes one duplicate per source.

    The choice is one after the other within a component of kinds, so a component is a stream of two numbers a notice in
    one task; components are independent."""
    edges = stage(edges)
    of = _components(edges)
    order = [F.col("rank.priority"), F.col("rank.first_seen"), F.col("rank.project_no")]
    named = members.join(of, "kind").repartitionByRange(*order).sortWithinPartitions(*order)
    named = stage(named.select(F.monotonically_increasing_id().alias("at"), "project_no", "kind", "component"))

    def chosen(held: pa.Table, met: pa.Table) -> pa.Table:
        held = held.sort_by("at")
        at, e = held["at"].to_numpy(), met.to_pydict()
        out = choose(held["kind"].to_pylist(), e["b_source"], list(zip(e["score"], e["a"], e["b"], e["b_source"], e["reason"], strict=True)))
        b, a, reason = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"b": pa.array(at[list(b)], pa.int64()), "a": pa.array(at[list(a)], pa.int64()), "reason": pa.array(reason, pa.string())})

    met = edges.join(of.withColumnRenamed("kind", "a"), "a").select("component", "a", "b", "b_source", "score", "reason")
    out = named.select("component", "at", "kind").groupBy("component").cogroup(met.groupBy("component")).applyInArrow(chosen, "b long, a long, reason string")
    name = lambda at, as_: named.select(F.col("at").alias(at), F.col("project_no").alias(as_))
    return stage(out).join(name("b", "project_no"), "b").join(name("a", "dup_of"), "a").select("project_no", "dup_of", F.col("reason").alias("dup_reason"))


def assign_duplicates(scored: DataFrame) -> DataFrame:
    """``assign_members`` of scored pairs, each notice a kind of its own."""
    side = lambda c: scored.select(F.col(c).alias("project_no"), F.col(c).alias("kind"), F.col(f"rank_{c}").alias("rank"))
    return assign_members(side("a").unionAll(side("b")).distinct(), scored.select("a", "b", "b_source", "score", "reason"))


def kinds_of(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of kinds, with a number as project_no; members project_no, kind, rank). Sources have priorities of
    their own, so that of two kinds one ranks before the other with all its members."""
    same = ["source", "end", "title_grams", "doc_grams", "stems", "regions"]
    named = fps.withColumn("key", F.sha2(F.to_json(F.struct(*same)), 256))
    kinds = named.groupBy("key").agg(F.min("rank_key").alias("rank_key"), *(F.first(c).alias(c) for c in same))
    kinds = stage(kinds.withColumn("project_no", F.monotonically_increasing_id()))
    members = named.join(kinds.select("key", F.col("project_no").alias("kind")), "key").select("project_no", "kind", F.col("rank_key").alias("rank"))
    return kinds.drop("key"), members


def mark_duplicates(notices: DataFrame, docs: DataFrame) -> DataFrame:
    """Notices with fresh marks: old ones go, open notices are compared."""
    open_ = tables.filter_status(notices, lex.OPEN)
    fps = fingerprints(open_, docs.join(open_.select("project_no"), "project_no", "left_semi")).checkpoint()
    kinds, members = kinds_of(fps)
    marks = assign_members(members, pair_score(candidate_pairs(kinds), kinds))
    return notices.drop("dup_of", "dup_reason").join(marks, "project_no", "left")
