"""op11, op12 and op13 against plain Python, on rows with every defined case."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from noticeloom.llm import best_fit, filter_audit, packing, shards, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard long, words string, starts int, mask string, digest string, n int, term string, task int, answer string"
WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _docs(n=160, seed=5):
    rng, made = random.Random(seed), []
    words = ["the", "The", "a", "hélas", "one-two", "x1y2z", "STOP!", "#tag", "ß", "é", "don't", "...", "__", "日本", "a b", "\x00q", "ÀB"] + [f"w{i}" for i in range(60)]
    for i in range(n):
        text = rng.choice(["", " ", "\n"]) + "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\x0b", "  "]) for _ in range(rng.choice([0, 1, 5, 40, 130, 400])))
        made.append([i, text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "a", "a", "b", None, "c"])])
    made[3][1], made[4][1], made[7][1] = None, "", made[9][1]
    made += [[None, made[9][1], "en", "a"], [None, "alone", None, None], [9, made[9][1], "en", "b"], [-5, made[20][1], "de", "a"], [20, "other text", "de", "a"], [500, "word " * 60_000, "en", "z"], [501, "...", "xx", "only"], [502, "...", "xx", "two"]]
    return [tuple([*r, 1, 7, "w", 2, "m", "d", 3, "t", 4, "s"]) for r in made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_docs(), SCHEMA).repartition(3)


@pytest.mark.parametrize("text", ["", " ", "a", " a  b\n", "  x", "a a b a"])
def test_split_words(text):
    words, at, sizes = shards.split_words(pa.array([text, "z z", ""]))
    got = [words[i].as_py() for i in at.tolist()]
    assert got == WORD.findall(text) + ["z", "z"] and sizes.tolist() == [len(WORD.findall(text)), 2, 0]


@pytest.mark.parametrize("step", [1, 7, 60, 1 << 20])
def test_split_words_in_stretches(monkeypatch, step):
    texts, seen, split = ["b a", "", None, "  x\n", "a " * 20, "", "c b a c"] * 3, [], shards.pc.ascii_split_whitespace
    monkeypatch.setattr(shards.pc, "ascii_split_whitespace", lambda x: seen.append(x) or split(x))
    words, at, sizes = shards.split_words(pa.array([t or "" for t in texts]), step)
    assert [words[i].as_py() for i in at.tolist()] == [w for t in texts for w in WORD.findall(t or "")]
    assert sizes.tolist() == [len(WORD.findall(t or "")) for t in texts] and len(set(words.to_pylist())) == len(words) == 4
    assert all(len(x) == 1 or sum(map(len, x.to_pylist())) <= step for x in seen)
    words, at, sizes = shards.split_words(pa.array([], pa.string()), step)
    assert len(words) == len(at) == len(sizes) == 0


def test_shards_hold_every_count_under_global_ids(spark, docs):
    made = shards.count_shards(docs, carried=("doc_id",), shard_bytes=20_000)
    ids = shards.dictionary_ids(made)
    name = {r.id: r.word for r in shards.dictionary(made, ids).collect()}
    assert len(set(name.values())) == len(name)
    got, n = Counter(), 0
    for r in shards.csr_shards(made, ids).collect():
        n += 1
        starts, columns, counts = shards.unsqueezed(r.starts, "<i8"), shards.unsqueezed(r.columns, "<i8"), shards.unsqueezed(r.counts, "<i4")
        for d, (x, y) in zip(r.doc_id, zip(starts[:-1], starts[1:]), strict=True):
            assert len(set(columns[x:y])) == y - x
            got.update({(d, name[c]): int(k) for c, k in zip(columns[x:y], counts[x:y], strict=True)})
    want = Counter()
    for d, text, *_ in _docs():
        want.update((d, w) for w in WORD.findall(text or ""))
    assert got == want and n > 5


def _labels():
    return [(i, i % 3 == 0, i % 5 == 0) for i in range(0, 160, 2)] + [(9, 0, 0), (9, 1, None), (None, 1, 1), (7, None, None)]


def _audit(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k]} for k in (0, 1))
    smallest, masks, lost = {}, [], defaultdict(lambda: [0, 0, 0])
    for d, t, *_ in rows:
        if d is not None:
            smallest[t or ""] = min(smallest.get(t or "", d), d)
    for d, t, lang, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        m = (len(w) < 100) + 2 * (100 * len(set(w)) < 80 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + 8 * bool(re.search(r"[#$%&*|]", t)) + 16 * (d is not None and d > smallest[t])
        masks.append((lang or "", m, d in good, d in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in itertools.permutations("ABCDE"):
            before = 0
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [m for m in own if not m[1] & before and m[1] & bit]
                out[part, "".join(order), step] = [sum(not m[1] & (before | bit) for m in own), len(gone), sum(bool(m[1] & before and m[1] & bit) for m in own), sum(m[1] == bit for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)]
                before |= bit
                lost[part, f][0] += len(gone)
    return {k: (*v, lost[k[0], k[1][k[2] - 1]][0]) for k, v in out.items()}


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_filters_in_all_orders(spark, docs, monkeypatch, broadcast):
    monkeypatch.setattr(filter_audit, "BROADCAST", broadcast)
    labels = spark.createDataFrame([(i, None if q is None else int(q), None if t is None else int(t), "x") for i, q, t in _labels()], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit_filters(docs, labels).collect()}
    assert got == _audit(_docs(), _labels())


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(none, labels).count() == 0
    assert best_fit.pack_best_fit(none, packing.default_tokenizer()).count() == 0
    assert source_divergence.divergence(none).count() == 0


def _divergence(rows, least=3):
    occurrences, holders, groups = defaultdict(Counter), defaultdict(set), set()
    for i, (_, t, lang, source, *_) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w in TERM.findall(t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            occurrences[lang, source][w] += 1
            holders[lang, w].add(i)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (x, w), d in holders.items() if x == lang and len(d) >= least)
        own = {s: [occurrences[lang, s][w] for w in kept] for x, s in groups if x == lang}
        share = lambda c: [1 + 10**9 * (n + 1) // (sum(c) + len(kept)) for n in c]
        p, q = {s: share(c) for s, c in own.items()}, share([sum(c) for c in zip(*own.values(), strict=True)])
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = sorted((-sum(map(f, p[s], p[o])), o.encode()) for o in own if o != s)
            terms = sorted((-f(a, b), w.encode()) for a, b, w, n in zip(p[s], q, kept, own[s], strict=True) if n and a > b)[:200]
            out |= {(lang, s, part, item.decode(), -v, rank) for part, found in (("pair", pairs), ("term", terms)) for rank, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize(("cells", "shard_bytes"), [(1 << 20, 32 << 20), (64, 9_000)])
def test_divergence(spark, docs, monkeypatch, cells, shard_bytes):
    monkeypatch.setattr(source_divergence, "CELLS", cells)
    found = source_divergence.divergence(docs, shard_bytes=shard_bytes).collect()
    got = {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in found}
    assert len(found) == len(got) and got == _divergence(_docs())


def test_divergence_beyond_64_bits():
    counts = np.array([[10**13, 1], [0, 3]])
    assert source_divergence.shares(counts, np.array([[10**13 + 3], [5]])).tolist() == [[1 + 10**9 * (10**13 + 1) // (10**13 + 3), 1], [1 + 10**9 // 5, 1 + 4 * 10**9 // 5]]
    assert source_divergence.exact_sums(np.array([[2**62, 2**62, 2**62], [1, 2, 3]])) == [3 * 2**62, 6]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 65, 400), rng.integers(20, 50, 300), np.full(100, 3), rng.integers(33, 65, 50), np.minimum(64, rng.lognormal(2.5, 0.9, 5000).astype(int) + 1), np.array([], int)][seed]
    counts = np.bincount(lengths, minlength=65)
    found = best_fit.plan(counts, 64)
    used = Counter()
    for filling, times in found:
        assert sum(filling) <= 64 and times >= 1
        for x in filling:
            used[x] += times
    assert used == Counter(lengths.tolist())
    room: list[int] = []  # best fit, the longest first
    for x in sorted(lengths.tolist(), reverse=True):
        i = min((i for i, r in enumerate(room) if r >= x), key=room.__getitem__, default=-1)
        room = [*room[:i], room[i] - x, *room[i + 1 :]] if i >= 0 else [*room, 64 - x]
    assert -(-int(lengths.sum()) // 64) <= sum(t for _, t in found) <= len(room) + len(room) // 50


def test_complements_are_exact():
    stock = best_fit.Complements(np.bincount([10, 10, 7, 4, 4, 30], minlength=65))
    assert stock.single(7) == (7,) and stock.single(8) == ()
    assert stock.pair(20) == (10, 10) and stock.pair(8) == (4, 4) and stock.pair(60) == () and stock.pair(14) == (10, 4)
    assert stock.triple(24) == (10, 10, 4) and stock.triple(30) == () and stock.triple(12) == () and stock.triple(15) == (7, 4, 4)
    assert stock.best(29) == (10,) and stock.best(3) == ()


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_best_fit_pieces(spark, docs, monkeypatch, broadcast):
    from tokenizers import Tokenizer

    monkeypatch.setattr(best_fit, "BROADCAST", broadcast)
    monkeypatch.setattr(best_fit, "_RUN_BYTES", 5_000)
    path = packing.default_tokenizer()
    rows = best_fit.pack_best_fit(docs, path, capacity=512).collect()
    tokenizer, want = Tokenizer.from_file(path), Counter()
    for d, t, *_ in _docs():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((d, i // 512, i, len(ids[i : i + 512]), zlib.crc32(ids[i : i + 512].tobytes())) for i in range(0, len(ids), 512))
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows) == want
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 512 and sorted(ends) == list(range(len(ends)))
    assert len(ends) <= -(-sum(r.length for r in rows) // 512) + 1
