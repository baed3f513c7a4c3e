"""Jaccard join, vectors, search, components and the pipeline against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from noticeloom.llm import common, mixing, topk_search, vector_dedup
from noticeloom.llm import jaccard_join as jj


def groups(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    w = (text or "").lower().split(" ") if text else []
    w = [x for x in w if x]
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def variants(r, n):
    """Texts of many sizes with near copies around the threshold."""
    words, out = [f"w{i}" for i in range(400)], []
    while len(out) < n:
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 8, 12, 30, 60, 200]))]
        for _ in range(r.choice([1, 1, 3, 8])):
            t = list(base)
            for _ in range(r.randrange(0, 1 + len(t) // 20 + 1)):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t[: len(t) - r.choice([0, 0, 1])]))
    return out[:n]


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_components(spark, monkeypatch, small):
    if small:  # many chunks and bands, so that blocks of work meet across tasks
        monkeypatch.setattr(jj, "UNIT", 400)
        monkeypatch.setattr(jj, "SETS", 6)
    texts = [None, "", " \n", "one", "ONE", "one two", *variants(random.Random(8 + small), 240)]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (0, None, 1), (None, "one", 1)], "doc_id long, text string, key int")
    sets = {i: shingles(t if t is None else t.replace("\n", " ")) for i, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = jj.jaccard_components(df).collect()
    assert len(got) == len(rows) + 2 and sum(r.component_id is None for r in got) == 1
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    assert len(set(want.values())) < len(want) - 30


@pytest.mark.parametrize("t", [70, 80, 90])
def test_signatures_never_miss(t):
    r, sign, near = np.random.default_rng(1), jj.Signer(t), 0
    for n in (2, 3, 4, 5, 6, 9, 10, 14, 31, 33, 40, 63, 65, 150, 700):
        for _ in range(120):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            k = int(r.integers(0, n * (100 - t) // t + 2))
            keep = r.permutation(a)[: n - int(r.integers(0, min(k, n - 1) + 1))]
            b = np.unique(np.concatenate([keep, r.integers(0, 1 << 63, k).astype(np.uint64)]))
            s = len(np.intersect1d(a, b))
            if 100 * s >= t * (len(a) + len(b) - s) and not np.array_equal(a, b):
                near += 1
                assert set(sign(a).tolist()) & set(sign(b).tolist())
    assert near > 200


def test_token_group_matrix_prunes():
    r, sets, near = np.random.default_rng(2), [], []
    common_part = r.integers(0, 1 << 62, 40)
    for unit in range(40):
        base = r.integers(0, 1 << 62, 160)
        for _ in range(6):
            x = base.copy()
            x[r.permutation(160)[: r.integers(0, 14)]] = r.integers(0, 1 << 62)
            sets.append(np.unique(np.concatenate([x, common_part]).astype(np.uint64)))
            near.append(unit)
    n = len(sets)
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = groups(range(n), [(i, j) for i in range(n) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.9])
    for group in ([0] * n, near):
        opened = [0, 0]
        assert groups(range(n), jj.links_in(list(range(n)), sets, [0] * n, 90, group, opened)) == want
        assert 0 < opened[0] < 0.1 * opened[1]
    matrix = jj.TokenGroupMatrix(sets, list(range(n)), near)
    for q in (0, 77, 200):
        matrix.mask[matrix.of(q)] = 1
        assert matrix.bounds(q).tolist() == [len(np.intersect1d(sets[q], np.concatenate([sets[i] for i in g]))) for g in matrix.groups]
        matrix.mask[matrix.of(q)] = 0


def test_jaccard_one_id_with_other_texts(spark):
    a = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(1, "x y z"), (1, a), (2, a + " b"), (3, a), (4, "x y z")], "doc_id long, text string")
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in jj.jaccard_components(df).collect()) == [(1, 1, 1), (1, 58, 1), (2, 59, 1), (3, 58, 1), (4, 1, 1)]


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(80), r.randrange(80)) for _ in range(60)]
    want = groups({x for e in edges for x in e}, edges)
    got = {x.id: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_staged(spark):
    x = common.staged(spark.range(3))
    assert x.count() == 3
    other = spark.newSession()
    common.clear_staged(other)
    common.clear_staged(other)


VEC = "vec_id long, embedding array<float>, label int, n long"


def vectors(seed, n, dims=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims))
    x = centres[r.integers(0, 12, n)] + 0.25 * r.normal(size=(n, dims))
    rows = [(i, [float(v) for v in np.float32(x[i])], int(r.integers(0, 3)), 1) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(n, None, 1, 1), (n + 1, [0.0] * dims, 1, 1), (n + 2, [nan] * dims, 1, 1), (n + 3, [None] * dims, 1, 1), (n + 4, [inf] + [1.0] * (dims - 1), 1, 1), (n + 5, rows[0][1], None, 1), (n + 6, rows[0][1], rows[0][2], 1), (n + 7, [1.0], 1, 1), (n + 8, [3e38] * dims, 1, 1)]
    return rows


@pytest.mark.parametrize("chunk", [1024, 16])
def test_vector_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(vector_dedup, "CHUNK", chunk)
    rows = vectors(3, 400)
    x = {i: np.array(v, float) for i, v, label, _ in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab, _ in rows}
    cos = lambda a, b: float((a / np.abs(a).max()) @ (b / np.abs(b).max()) / np.linalg.norm(a / np.abs(a).max()) / np.linalg.norm(b / np.abs(b).max()))
    links = [(a, b) for a in x for b in x if a < b and label[a] == label[b] and len(x[a]) == len(x[b]) and cos(x[a], x[b]) >= 0.93]
    n = {i: sum(i in e for e in links) for i, *_ in rows}
    want = groups([i for i, *_ in rows], links)
    got = vector_dedup.vector_components(spark.createDataFrame([*rows, (None, rows[0][1], 1, 1)], VEC)).collect()
    assert len(got) == len(rows) + 1 and len(links) > 200
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert vector_dedup.vector_components(spark.createDataFrame([], VEC)).count() == 0


def test_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0], 1, 1), (1, [0.0, 1.0], 1, 1), (2, [1.0, 0.0], 1, 1), (3, [0.0, 0.1], 2, 1), (4, [1.0, 1 / 3], 1, 1)]
    got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in vector_dedup.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n long")).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 2, 1, False)]


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 120)
    monkeypatch.setattr(topk_search, "PROBE", 8)
    rows = [r for r in vectors(5, 300) if r[0] != 308]
    x = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v, _, _ in rows if v and None not in v and np.isfinite(v).all()}
    q = topk_search.quantised(spark.createDataFrame(rows, VEC))
    got = {}
    for r in topk_search.top_k(q, q.where("id % 25 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    dot = lambda a, b: int(a[: len(b)] @ b[: len(a)])
    for i in [k for k in x if k % 25 == 0]:
        best = sorted((-dot(x[i], x[j]), j) for j in x if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    two = topk_search.quantised(spark.createDataFrame(rows[:3], VEC))
    assert topk_search.top_k(two, two).count() == 6 and topk_search.top_k(two.limit(0), two.limit(0)).count() == 0


def test_top_k_reads_few_postings():
    """Equal to the whole product; fewer than half of the components are read, and with a floor or near copies far fewer."""
    table = pq.read_table("/root/testdata/check_s/embeddings.parquet").slice(0, topk_search.BLOCK).to_pydict()
    good = [(i, v) for i, v in zip(table["vec_id"], table["embedding"], strict=True) if v and all(c is not None and np.isfinite(c) for c in v)]
    ids, x = np.array([i for i, _ in good]), np.floor(256 * np.array([v for _, v in good], float))
    index = topk_search.ImpactIndex(ids, x)
    assert sum(a.nbytes for a in vars(index).values() if isinstance(a, np.ndarray)) < 2 * x.nbytes
    asked = [k for k in range(len(ids)) if ids[k] % 50 == 0][:60]
    whole = len(asked) * x.size

    def read(floor):
        index.read = 0
        got = index.top(x[asked], ids[asked].tolist(), 5, floor)
        for k, best in zip(asked, got, strict=True):
            want = sorted(((-int(s), int(i)) for s, i in zip(x @ x[k], ids, strict=True) if i != ids[k]))[:5]
            assert [(-s, i) for i, s in best] == want
        return index.read / whole

    none = read(np.full(len(asked), -np.inf))
    best = np.array([np.sort((x @ x[k])[ids != ids[k]])[-5] for k in asked])
    assert read(best) < none < 0.5
    assert index.top(x[asked[:1]], [-1], 5, np.array([np.inf])) == [[]]
    near = topk_search.ImpactIndex(np.arange(6000), np.floor(256 * np.repeat(x[:1000] / 256, 6, 0)) + np.arange(6000)[:, None] % 6)
    got = near.top(near.x[:6], list(range(6)), 5, np.full(6, -np.inf))
    assert near.read < 0.3 * 6 * near.x.size and {i for best in got for i, _ in best} <= set(range(6))


def test_top_k_repeated_query_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.5]), (3, [0.5, 0.25]), (4, None), (5, []), (6, [2.0])]
    q = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(z["rank"], z.vec_id, z.score) for z in topk_search.top_k(q, q.where("id = 1"), k=3).collect()]
    assert sorted(got) == [(1, 6, 2 * 65536), (2, 2, 65536), (3, 2, 32768)]


def test_top_k_of_wide_components(spark):
    r = random.Random(4)
    vectors = [(i, [r.choice([-1, 1]) * r.choice([0.0, 1.5, 10.0**e, 3.7 * 10.0**e]) for _ in range(3)]) for i, e in enumerate([1, 2, 6, 6, 8, 9, 12, 12, 7, 6, 5] * 5)]
    vectors += [(100, [2e6, 1.0, 0.0]), (101, [3e6, 0.0, 0.0]), (102, [1.5e6, 2.0, 0.0]), (103, [1e160, 0.0, 1.0]), (104, [9e159, 0.0, 1.0])]
    x = {i: [int(np.floor(256 * c)) for c in v] for i, v in vectors}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    for block in (4096, 9):
        q = topk_search.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
        got = {}
        for z in topk_search.top_k(q, q, block=block).collect():
            got.setdefault(z.query_id, []).append((z["rank"], z.vec_id, z.score))
        for i in x:
            best = sorted((-dot(x[i], x[j]), j) for j in x if j != i)[:5]
            assert sorted(got[i]) == [(k + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for k, (s, j) in enumerate(best)]


def test_pipeline_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (None, "A quiet line of words that stays. " * 9, "en", None, 5), (900001, "", "en", "src0", 0)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.limit(1))
    kept = None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, folder)
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if i == 1:
            c = {r.doc_id: r.component_id for r in jj.jaccard_components(before, 5, 80).collect()}
            assert sorted(x for x in ids if x is not None) == sorted({v for k, v in c.items() if k is not None})
            kept = set(ids)
        if i == 2:
            assert set(ids) == kept
    assert docs.count() > 100
    assert corpus_pipeline.near_duplicates(spark, before.limit(0), folder).count() == 0


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, copies long, component_id string"


def _line(seed, n=60):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def test_pipeline_tells_rows_of_an_id_apart(spark):
    one, near = _line(1), _line(1)
    near[30] = "other"
    rows = [(1, one), (5, near), (5, _line(5)), (6, _line(6)), (6, _line(6)), (None, _line(1)), (None, _line(8)), (None, _line(8)), (3, one), (7, []), (8, []), (9, _line(9, 60_000)), (10, None)]
    docs = spark.createDataFrame([(i, None if t is None else " ".join(t), "en", "s", 7, 1, "x") for i, t in rows], DOCUMENT)
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    want = [(1, one), (5, _line(5)), (6, _line(6)), (None, _line(8)), (7, []), (8, []), (9, _line(9, 60_000)), (10, None)]
    assert got == sorted((str(i), None if t is None else " ".join(t)) for i, t in want)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_pipeline_mixes_rows_of_an_id_apart(spark, monkeypatch, broadcast):
    """Whatever rows share an id, a source's words come near its target and no row is taken more than twice."""
    monkeypatch.setattr(jj, "BROADCAST", broadcast)
    r = random.Random(2)
    rows = [(r.choice([1, 1, 2, None, k]), " ".join(_line(k % 150, 1 + k % 17)), "en", r.choice(["a", "a", "b", None])) for k in range(300)]
    docs = spark.createDataFrame([(*x, 1, 3, "c") for x in rows], DOCUMENT)
    took = Counter((x.doc_id, x.text, x.source) for x in corpus_pipeline.mixture(spark, docs, "").collect())
    there = Counter((i, t, s) for i, t, _, s in rows)
    assert all(n <= 2 * there[k] for k, n in took.items())
    targets = {x.source: x.target for x in mixing.source_targets(mixing.sized(docs)).collect()}
    for s, target in targets.items():
        words = sum(n * len(t.split()) for (_, t, x), n in took.items() if x == s)
        assert abs(words - target) <= 17
    assert corpus_pipeline.mixture(spark, docs.limit(0), "").count() == 0


def test_pipeline_runs_to_the_end(spark):
    """Every kept token is packed once for each copy, over all stages."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).checkpoint()
    pieces = corpus_pipeline.run(spark, folder).groupBy("doc_id").agg({"length": "sum"}).collect()
    tokens = {x.doc_id: x["sum(doc_tokens)"] for x in corpus_pipeline.windows(spark, docs, folder).where("start = 0").groupBy("doc_id").agg({"doc_tokens": "sum"}).collect()}
    assert {x.doc_id: x["sum(length)"] for x in pieces} == tokens and {x.doc_id for x in docs.collect()} == set(tokens)


def test_pipeline_near_duplicates(spark):
    r = random.Random(9)
    word, texts = lambda: f"w{r.randrange(10**6)}", []
    for n in (100, 100, 120, 150, 200, 300) * 3:
        base = [word() for _ in range(n)]
        texts.append(base)
        for edits in (2, r.randrange(1, 6)):
            t = list(base)
            for k in range(edits):
                t[(2 * k + 1) * n // (2 * edits)] = word()
            texts.append(t)
    sets = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in enumerate(texts)}
    pairs = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert sum(0.8 <= x < 0.9 for x in pairs.values()) > 5 and sum(0.6 < x < 0.8 for x in pairs.values()) > 5
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == set(groups(sets, [p for p, x in pairs.items() if x >= 0.8]).values())
