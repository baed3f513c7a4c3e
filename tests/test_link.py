"""The greedy choice of duplicates against going through the pairs one by one."""

import random

import pytest

from noticeloom.operators import link

PAIR = "a string, b string, b_source string, rank_a struct<priority:int,first_seen:string,project_no:string>, rank_b struct<priority:int,first_seen:string,project_no:string>, score double, reason string"


def _graph(nodes, pairs, seed, scores=20):
    r = random.Random(seed)
    name = [f"n{i:06d}" for i in range(nodes)]
    source = {x: r.choice("pqrs") for x in name}
    rank = {x: ("pqrs".index(source[x]), f"d{r.randrange(5)}", x) for x in name}
    made = {}
    for _ in range(pairs):
        a, b = sorted(r.sample(name, 2), key=rank.get)
        if source[a] != source[b]:
            made[a, b] = (a, b, source[b], rank[a], rank[b], r.randrange(scores) / scores, f"{a}{b}")
    return list(made.values())


def _one_by_one(rows):
    of, took = {}, {}
    for a, b, source, _, _, _, reason in sorted(rows, key=lambda x: (-x[5], x[4], x[3])):
        if a not in of and b not in of and b not in took and source not in took.get(a, ()):
            of[b] = (a, reason)
            took.setdefault(a, set()).add(source)
    return of


@pytest.mark.parametrize(("nodes", "pairs", "seed"), [(9, 14, 0), (40, 120, 1), (300, 500, 2), (4000, 30_000, 3), (2, 0, 4)])
def test_rounds_equal_going_one_by_one(spark, nodes, pairs, seed):
    rows = _graph(nodes, pairs, seed)
    got = {r.project_no: (r.dup_of, r.dup_reason) for r in link.assign_duplicates(spark.createDataFrame(rows, PAIR)).collect()}
    assert got == _one_by_one(rows)


def test_a_hub_takes_one_of_each_source(spark):
    rows = [("hub", f"n{i}", "xyz"[i % 3], (0, "", "hub"), (1, "", f"n{i}"), 0.9, "r") for i in range(300)]
    got = {r.project_no: (r.dup_of, r.dup_reason) for r in link.assign_duplicates(spark.createDataFrame(rows, PAIR)).collect()}
    assert got == _one_by_one(rows) and len(got) == 3


def _brute(rows):
    """(a, b, ...) of all pairs of notices (source, title, end), as the rules for titles say."""
    made = []
    for a in rows:
        for b in rows:
            if a[3] < b[3] and a[1] == b[1] and a[0] != b[0] and (a[2] or b[2]) and (not a[2] or not b[2] or a[2] == b[2]):
                made.append((a[4], b[4], b[0], a[3], b[3], 0.9, "제목 일치(100%)"))
    return made


def test_equal_titles_are_compared_once_and_chosen_as_pair_by_pair(spark, monkeypatch):
    r, prefix = random.Random(5), {"jbexport": "JB-", "at": "AT-", "kotra": "KOTRA-", "bizinfo": "BIZ-"}
    rows = []
    for i in range(900):
        source, title, end = r.choice(list(prefix)), r.choice(["red bolt", "new anvil", "hot plate"]), r.choice(["", "2026-12-01"])
        name = f"{prefix[source]}{i:04d}"
        rows.append((source, title, end, (list(prefix).index(source), f"d{i % 7}", name), name))
    notices = spark.createDataFrame([(n, t, "접수중", e, rank[1], None, None, None, None) for _, t, e, rank, n in rows], "project_no string, title string, status string, receipt_end string, first_seen string, attachments array<struct<name:string,files:array<string>>>, target struct<regions:array<string>>, dup_of string, dup_reason string")
    docs = spark.createDataFrame([(x[4], 0, "x.txt", "text") for x in rows], "project_no string, doc_seq int, file_name string, text string")
    met, score = [], link.pair_score
    monkeypatch.setattr(link, "pair_score", lambda pairs, fps: (met.append(pairs.count()), score(pairs, fps))[1])
    got = {x.project_no: (x.dup_of, x.dup_reason) for x in link.mark_duplicates(notices, docs).where("dup_of IS NOT NULL").collect()}
    assert got == _one_by_one(_brute(rows)) and len(got) > 400
    assert met[0] <= 3 * 8 * 7 / 2  # 3 titles, each of 8 kinds
