"""The search index against plain Python: results, bounds, updates."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noticeloom.operators import search_index as si

CHUNK = "project_no string, seq int, heading string, text string"


def _grams(text):
    out = []
    for w in re.sub(r"[^\w]+", " ", (text or "").lower()).split():
        out += [w] if len(w) == 1 else [w[i : i + 2] for i in range(len(w) - 1)]
    return out


def _search(chunks, queries, k=6):
    docs = [(p, s, Counter(_grams(f"{h or ''} {t or ''}"))) for p, s, h, t in chunks]
    n, avg = len(docs), sum(sum(d.values()) for *_, d in docs) / max(len(docs), 1)
    df = Counter(g for *_, d in docs for g in d)
    out = {}
    for q, question, only in queries:
        found = []
        for p, s, d in docs:
            if only in (None, p):
                score = sum(math.log1p((n - df[g] + 0.5) / (df[g] + 0.5)) * d[g] * 2.2 / (d[g] + 1.2 * (0.25 + 0.75 * sum(d.values()) / avg)) for g in set(_grams(question)) if d[g])
                if score > 0:
                    found.append((-round(score, 6), p, s))
        out[q] = [(p, s, -x) for x, p, s in sorted(found)[:k]]
    return out


def _corpus(n=400, seed=3):
    r = random.Random(seed)
    syllables = [chr(0xAC00 + 97 * i) for i in range(60)]
    word = lambda: "".join(r.choices(syllables, weights=[1 / (i + 1) for i in range(60)], k=r.randint(1, 4)))
    rows = [(f"P{i // 3:03d}", i % 3, r.choice(["", "지원 내용", None]), " ".join(word() for _ in range(r.randint(0, 60))) + r.choice(["", " Export-2024 _x", "\nKOTRA"])) for i in range(n)]
    for i in range(0, n, 50):
        rows[i] = (*rows[i][:3], rows[i][3] + f" 희귀{i}쌃쌄")
    rows += [("P900", 0, None, None), ("P901", 0, "", ""), ("P902", 0, "제목", rows[7][3]), ("P903", 0, "제목", rows[7][3]), ("P904", 0, "", "가" * 5000)]
    return rows


QUERIES = [("a", "수출 지원 Export 쌃쌄", None), ("b", "희귀100쌃쌄", None), ("c", "", None), ("d", None, None), ("e", "가가 각 KOTRA", None), ("f", "지원 내용", "P001"), ("g", "zzz", None), ("h", "지원", "nothing"), ("i", " ".join(chr(0xAC00 + 97 * i) * 2 for i in range(30)), None)]


def _got(spark, index, queries=QUERIES, k=6):
    rows = si.search(index, spark.createDataFrame(queries, "query_id string, question string, project_no string"), k).collect()
    out = {q: [] for q, *_ in queries}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["project_no"], r["seq"], r["score"]))
    return out


def _same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [x[:2] for x in got[q]] == [x[:2] for x in want[q]], q
        assert [x[2] for x in got[q]] == pytest.approx([x[2] for x in want[q]], abs=2e-6)


@pytest.mark.parametrize(("size", "k"), [(16, 6), (128, 1), (1, 3)])
def test_search_equals_scoring_every_chunk(spark, size, k):
    rows = _corpus()
    index = si.build_index(spark.createDataFrame(rows, CHUNK).repartition(3), size=size)
    _same(_got(spark, index, k=k), _search(rows, QUERIES, k))


def test_rare_grams_skip_segments(spark):
    """Bounds leave out more than half of the segments that hold any gram of the question."""
    rows = _corpus(1200)
    index = si.build_index(spark.createDataFrame(rows, CHUNK).coalesce(1), size=8)
    queries = [(f"q{i}", f"{rows[i][3][:12]} 희귀{i}쌃쌄", None) for i in range(0, 400, 50)]
    hunt = si.hunt(index, spark.createDataFrame(queries, "query_id string, question string, project_no string"), 2)
    found, opened = hunt.run()
    held, read = hunt.bounds.count(), opened.count()
    assert held > 8 * 100 and read < held / 2
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["project_no"], r["seq"])
    assert got == {q: {i + 1: x[:2] for i, x in enumerate(v)} for q, v in _search(rows, queries, 2).items()}


def _tables(index):
    terms = {r.gram: r.df for r in index.terms.collect()}
    return index.totals, terms, sorted((r.project_no, r.seq, r.len) for r in index.members.collect())


def test_updates_equal_a_fresh_index(spark):
    """Replaced, deleted and new notices, twice over, then compaction: statistics and results as of a fresh index."""
    rows = _corpus()
    index = si.build_index(spark.createDataFrame(rows, CHUNK).repartition(2), size=16)
    for turn in range(2):
        keys = {f"P{i:03d}" for i in range(turn, 130, 17)} | {"P901", f"N{turn}", "unknown"}
        new = [(p, s, "새", f"{t or ''} 개정{turn}") for p, s, h, t in rows if p in keys and p != "P901" and s < 2] + [(f"N{turn}", 0, None, "쌃쌄 새로운 공고")]
        rows = [x for x in rows if x[0] not in keys] + new
        index = si.update_index(index, spark.createDataFrame([(k,) for k in keys], "project_no string"), spark.createDataFrame(new, CHUNK), size=16)
        fresh = si.build_index(spark.createDataFrame(rows, CHUNK), size=16)
        assert _tables(index) == _tables(fresh)
        _same(_got(spark, index), _search(rows, QUERIES))
    packed = si.compact_index(index)
    assert _tables(packed) == _tables(fresh) and packed.deleted.count() == 0
    assert packed.blocks.select(F.sum(F.size("postings"))).first()[0] == fresh.blocks.select(F.sum(F.size("postings"))).first()[0] < index.blocks.select(F.sum(F.size("postings"))).first()[0]
    _same(_got(spark, packed), _search(rows, QUERIES))
    # nothing changed: only an empty generation comes
    again = si.update_index(packed, spark.createDataFrame([], "project_no string"), spark.createDataFrame([], CHUNK))
    assert _tables(again) == _tables(packed)


def test_empty_corpus(spark):
    index = si.build_index(spark.createDataFrame([], CHUNK))
    assert index.totals == (0, 0) and _got(spark, index) == {q: [] for q, *_ in QUERIES}
