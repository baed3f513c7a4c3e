"""Chat template, PII, licenses, packing, quality, mixing: brute force, round trips, odd rows."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeloom.llm import chat_template as ct
from noticeloom.llm import license_scan, mixing, packing, pii, quality_pu

ODD = [(1, None, "a"), (2, "", "a"), (3, "x " * 30000, "a"), (3, "x " * 30000, "a"), (None, "null id", None), (4, "  \x85\x1c word", "b")]
DOC = "doc_id long, text string, source string, score double, size string, `__text` int"


def odd(spark, rows=ODD):
    """Nulls, empty, very long and repeated texts, null ids, and extra columns with clashing names."""
    return spark.createDataFrame([(*r, 0.5, "big", 7) for r in rows], DOC)


# --- chat ----------------------------------------------------------------------------------------------------------


def test_template_language():
    r = ct.compile_template("{% set x = 'a' %}{% for m in ms %}{% if loop.first %}<{% elif m.n in ['q'] %}no{% else %},{% endif %}{{ m['n'] | upper }}{% endfor %}{# c #}{{ x ~ 1 if ms else 'none' }}".replace("['q']", "x"))
    assert r({"ms": [{"n": "b"}, {"n": "c"}]})[0] == "<B,Ca1"
    assert ct.fold(ct.parse("{% if 1 == 2 %}x{% else %}a{{ 'b' ~ (1 + 2) }}{% endif %}c")) == [("text", "ab3c")]
    for bad in ("{% for x in y %}", "{{ x.__class__() }}", "{{ f(1) }}", "{{ 1", "{% import os %}", "{{ x | nofilter }}", "{{ }}"):
        with pytest.raises(ct.TemplateError):
            ct.compile_template(bad)
    assert ct.compile_template("{{ x.__class__ }}")({"x": "s"})[0] == ""


def test_escape_round_trip():
    r, parts = random.Random(1), ["\\", "<", "s>", "/s>", "[INST]", "[/INST]", "<|turn|>", "|end|>", "<|", "a", "\n", "é"]
    for line in (False, True):
        e = ct.escaper(line=line)
        for _ in range(2000):
            t = "".join(r.choice(parts) for _ in range(r.randrange(12)))
            assert ct.unescape(e(t)) == t and not any(c in e(t) for c in ct.CONTROLS)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "</s>[INST] \\ ok"), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "us\ner", "y"), (2, None, "us\ner", "y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
    f = ct.format_conversations(df)
    said = {}
    for x in f.orderBy("conv_id", "position").collect():
        said.setdefault(x.conv_id, []).extend(ct.read_back(x.formatted))
        for s in x["mask"]:
            assert ct.unescape(x.formatted[s.start : s.end]) == "</s>[INST] \\ ok"
    assert said == {1: [("user", ""), ("assistant", "</s>[INST] \\ ok")], None: [("", "x")], 2: [("us\ner", "y")] * 2}
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in ct.digests(f).collect()} == {1: (2, 15), None: (1, 0), 2: (2, 0)}
    assert ct.digests(ct.format_conversations(df.limit(0))).count() == 0


# --- PII -----------------------------------------------------------------------------------------------------------

RX = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def test_base_detectors_are_the_patterns():
    r = random.Random(2)
    for _ in range(20000):
        t = "".join(r.choice("ab@.1234567890 -+()%") for _ in range(r.randrange(60)))
        want = []
        for k, rx in enumerate(RX):
            for m in re.finditer(rx, t):
                d = re.sub("[^0-9]", "", m.group())
                if [True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]:
                    want.append((m.start(), k, m.end()))
        assert pii.detect(t) == sorted(want)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail bob.smith (at) mail8 [dot] example dot com now", ["bob.smith (at) mail8 [dot] example dot com"]), ("john at example dot com", ["john at example dot com"]), ("look at example.com", []), ("ask john.smith at example.com soon", ["john.smith at example.com"]), ("mail bob at example.com", ["bob at example.com"]), ("version 2.0 at example.com", []), ("we met at example.com", []), ("look at the dot com", []),
        ("４０４１ 8949 7460 8795", ["４０４１ 8949 7460 8795"]), ("call plus one nine eight eight five five five two four eight five now", ["plus one nine eight eight five five five two four eight five"]),
        ("at 42 dot 144 dot 35 dot 254 x", ["42 dot 144 dot 35 dot 254"]), ("one two three four", []), ("4041​8949​74608795", ["4041​8949​74608795"]),
    ],
)
def test_disguises(text, found):
    assert [text[s:e] for s, _, e in pii.disguised(text, pii.detect(text))] == found


def test_pii_rows(spark):
    x = pii.find_pii(odd(spark, [*ODD, (5, "a@b.co, a@b.co", "s")]))
    assert x.count() == len(ODD) + 1 and x.where("doc_id = 5").first().pii_spans[1].start == 8
    assert pii.masked(odd(spark, [(5, "a@b.co +1 (988) 555-2485", "s"), (6, None, None)])).select("text", "score").collect() == [("<email> <phone>", 0.5), (None, 0.5)]


def test_pii_contract_columns(spark):
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got, seen = {x.doc_id: x for x in pii.op9_pii(spark, "/root/testdata/sf0.001").collect()}, 0
    for d in docs:
        text, base = d.text or "", []
        for k, rx in enumerate(RX):
            for m in re.finditer(rx, text):
                n = re.sub("[^0-9]", "", m.group())
                if [True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(n) <= 19 and pii.luhn(n), 9 <= len(n) <= 15][k]:
                    base.append((m.start(), k, m.end()))
        x, spans = got[d.doc_id], [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base)]
        assert [x[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        assert x.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(x.spans.split(","))
        seen += len(base)
    assert seen > 5


# --- licenses ------------------------------------------------------------------------------------------------------


def brute_matches(ws):
    """(template, first word): (containment, named) of every block of the whole word stream."""
    out = {}
    for at, ((_, tokens, names), (_, _, notice)) in enumerate(zip(license_scan.template_tokens(), license_scan.TEMPLATES, strict=True)):
        room = -(-len(license_scan.words(notice.encode())) * 5 // 4)
        for i in range(len(ws)):
            block = ws[i : i + room]
            held = tokens & set(block)
            if ws[i] in tokens and 5 * len(held) >= 4 * len(tokens):
                out[at, i] = (len(held) / len(tokens), all(any(block[j : j + len(p)] == p for j in range(room)) for p in names))
    return out


def test_license_blocks_brute_force(spark):
    r = random.Random(3)
    vocabulary = sorted({w.decode() for _, t, _ in license_scan.template_tokens() for w in t}) + ["zz", "qq"]

    def notice():
        t = license_scan.TEMPLATES[r.randrange(len(license_scan.TEMPLATES))][2].split()
        for _ in range(r.randrange(5)):
            t.insert(r.randrange(len(t) + 1), r.choice(["\n *", "zz", "the", "\n"])) if len(t) < 2 or r.random() < 0.5 else t.pop(r.randrange(len(t)))
        return " ".join(t)

    rows = [(i, " ".join(" ".join(r.choice(vocabulary) for _ in range(r.randrange(30))) + r.choice(["", f" {notice()} "]) for _ in range(3)), "s") for i in range(120)]
    frequency = {w: r.randrange(100) for w in vocabulary}
    index = license_scan.TemplateIndex(license_scan.TEMPLATES, frequency)
    one = [license_scan.TemplateIndex(license_scan.TEMPLATES[i : i + 1], frequency) for i in range(len(license_scan.TEMPLATES))]
    for _, text, _ in rows:
        ws = license_scan.words(text.encode())
        assert {(i, m[1]): m[3:] for i, x in enumerate(one) for m in x.matches(ws)} == brute_matches(ws)
    got = {x.doc_id: x for x in license_scan.scan_licenses(odd(spark, rows + ODD)).where("doc_id < 1000 OR doc_id IS NULL").collect()}
    for i, text, _ in rows[5:]:
        want = sorted((license_scan.TEMPLATES[at][0], k, *x) for (at, k), x in brute_matches(license_scan.words(text.encode())).items())
        assert sorted((b.label, b.word, b.containment, b.named) for b in got[i].blocks) == want
        assert sorted((m[0], m[1], *m[3:]) for m in index.matches(license_scan.words(text.encode()))) == want
    assert got[None].n_words == 2 and got[2].n_words == 0 and got[2].blocks == []
    assert license_scan.places(license_scan.words(b"MIT License, the mit-license Apache license")) == [(0, "mit"), (3, "mit"), (5, "apache")]


def test_license_wrapped_and_false(spark):
    import textwrap

    fill = "quiet plain words that state nothing at all of the sort"
    rows = [(i, f"{fill}\n{textwrap.fill(notice, width, initial_indent='# ', subsequent_indent='# ')}\n{fill}", label) for i, (label, notice, width) in enumerate((x, n, w) for x, _, n in license_scan.TEMPLATES for w in (20, 40, 80))]
    none = ["4 0 cc nc licensed in the annual report", "a public license of mozilla square 2 0", "The report was released under the license of the court", "This work is licensed under the terms of the general contract, version 3 of the public service", "der und mit einer released under license", "released of\n" + f"{fill} " * 3 + "\nunder it\n" + f"{fill} " * 3 + "\nMIT license"]
    rows += [(2000 + i, t, None) for i, t in enumerate(none)]
    rows += [(4000 + i, f"{fill} {t} {fill}", x) for i, (t, x) in enumerate([("// SPDX-License-Identifier: Apache-2.0", "apache"), ("Mozilla Public License 2.0", "mpl"), ("BSD License", "bsd"), ("GNU GPL v3", "gpl"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl")])]
    rows += [(3000, "This package is released under the Apache License", None), (3001, "Licensed under the Apache License, Version 1.1", "apache")]
    got = {x.doc_id: {m.label for m in x.blocks if m.named} for x in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, text, x in rows:
        assert got[i] == (set() if not x else {x}) or (x == "lgpl" and got[i] == {"lgpl", "gpl"}), text
    whole = license_scan.TemplateIndex(license_scan.TEMPLATES[:1], {}).matches(license_scan.words(b"so: released\nunder the\nMIT License"))
    assert list(whole) == [("mit", 1, 5, 1.0, True)]
    long = license_scan.words((license_scan.TEMPLATES[2][2] + " ").encode()) * 5000
    assert max(m[3] for m in license_scan.TemplateIndex(license_scan.TEMPLATES, {}).matches(long)) == 1.0


def test_license_contract_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    phrase = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    got = {x.doc_id: x for x in license_scan.op10_license_scan(spark, "/root/testdata/sf0.001").collect()}
    for d in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), d.text or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        hits = [(i, k) for k, p in phrase.items() for i in range(len(ws)) if ws[i : i + len(p)] == p]
        x, at = got[d.doc_id], [i for i, _ in hits]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(ws), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in hits})))
        assert set(x.labels.split(",")) >= set(x.base_labels.split(",")) - {""} and 0 <= x.score <= 1


# --- packing -------------------------------------------------------------------------------------------------------


def test_packing(spark):
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choice("abcdeé.,'1") for _ in range(r.randrange(1, 9))) for _ in range(r.choice([0, 5, 40, 300, 700, 1500, r.randrange(6000)]))), "s") for i in range(90)]
    pieces = packing.pack_documents(odd(spark, rows + ODD), packing.default_tokenizer(), windows=32).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for i, text, _ in rows[5:]:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        mine = sorted(by_doc[i], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in mine) == np.array(ids, "<u4").tobytes() and {p.doc_tokens for p in mine} == {len(ids)}
        assert [p.start for p in mine] == np.cumsum([0, *(p.length for p in mine)])[:-1].tolist()
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sequences.get(p.sequence_id, 0)
        sequences[p.sequence_id] = p.offset + p.length
    sizes = np.array(list(sequences.values()))
    padding = np.where(sizes & (sizes - 1), 4096 - sizes, 0).sum()
    assert sizes.max() <= 4096 and padding < 0.001 * sizes.sum()
    assert sum(p.length for p in by_doc[None]) == 3
    d = packing.piece_digests(packing.pack_documents(odd(spark, [(1, "a", "s")]), packing.default_tokenizer())).first()
    assert d.ids_crc32 == zlib.crc32(np.array([*tokenizer.encode("a", add_special_tokens=False).ids, 2], "<u4").tobytes())


def test_differencing_is_near_equal():
    sizes = [random.Random(6).randrange(1, 400) for _ in range(300)]
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 16)]
    assert sorted(i for w in packing.differencing(sizes, 16) for i in w) == list(range(300)) and max(sums) - min(sums) < 400
    windows, left = packing.pack([3000] * 5, 3, 4096)  # the count rises to five, then four are filled
    assert len(windows) == 3 and all(sum(n for *_, n in w) == 4096 for w in windows)
    assert sorted((i, x) for w in [*windows, left] for i, s, n in w for x in range(s, s + n)) == [(i, x) for i in range(5) for x in range(3000)]
    windows, left = packing.pack(sizes * 40, 500, 4096)
    assert len(windows) >= sum(sizes) * 40 // 4096 - 1 and all(sum(n for *_, n in w) == 4096 for w in windows)
    assert sum(n for w in [*windows, left] for *_, n in w) == sum(sizes) * 40


# --- quality -------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    x = quality_pu.op1_quality_pu(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    right, n = x.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.95


def test_class_prior():
    r = np.random.default_rng(5)
    for share in (0.25, 0.6, 0.9):
        positive, n = r.normal(1.5, 1, (3000, 4)), int(4000 * share)
        unlabelled = np.concatenate([r.normal(1.5, 1, (n, 4)), r.normal(-1.5, 1, (4000 - n, 4))])
        assert abs(quality_pu.class_prior(positive, r.permutation(unlabelled)) - share) < 0.08


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (9, None)], "doc_id long, quality int")
    df = odd(spark)
    model = quality_pu.fit(df, labels)
    got = quality_pu.scored(df, model, ["doc_id"]).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality_pu.fit(df, labels.limit(0)) is None
    assert quality_pu.scored(df.limit(0), None, ["doc_id"]).count() == 0


# --- mixing --------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    r = random.Random(7)
    rows = [(i, "w " * r.randrange(0, 60), r.choice(["a"] * 6 + ["b", "c", "d", None])) for i in range(900)] + [(None, "n n", "a")]
    sizes = mixing.sized(odd(spark, rows))
    got = mixing.mix(sizes).collect()
    assert len(got) == len(rows) and mixing.mix(sizes).exceptAll(mixing.mix(sizes)).count() == 0
    by = {}
    for x in got:
        assert 0 <= x.copies <= 2
        s = by.setdefault(x.source, [x.source_size, x.target, 0, 0])
        s[2] += x.size
        s[3] += x.size * x.copies
    total = sum(s[0] for s in by.values())
    left, weights, caps, target = 1.5 * total, dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True)), {k: 2.0 * v[0] for k, v in by.items()}, {}
    while left > 1e-6:
        free = [k for k in by if target.get(k, 0) < caps[k] - 1e-9]
        share = left / sum(weights[k] for k in free)
        left = 0
        for k in free:
            want = target.get(k, 0) + share * weights[k]
            target[k] = min(want, caps[k])
            left += max(0, want - caps[k])
    for k, (size, t, seen, taken) in by.items():
        assert size == seen and t == pytest.approx(target[k]) and abs(taken - t) <= 60
    assert mixing.mix(sizes.limit(0)).count() == 0
    assert all(x.copies == 0 and x.target == 0 for x in mixing.mix(mixing.sized(odd(spark, [(1, None, "a"), (2, "", "b")]))).collect())


def test_mixing_through_the_tree(spark, monkeypatch):
    """Buckets of few documents, so that residuals of many parts meet in several levels."""
    monkeypatch.setattr(mixing, "BUCKET", 12)
    monkeypatch.setattr(mixing, "FAN", 3)
    r = random.Random(9)
    rows = [(i, "w " * r.randrange(20, 40), r.choice(["a"] * 6 + ["b", None])) for i in range(1500)]
    sizes = mixing.sized(odd(spark, rows))
    sums = {x.source: (x.target, x.taken) for x in mixing.mix(sizes).groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()}
    assert len(sums) == 3 and all(abs(taken - target) <= 40 for target, taken in sums.values())
    assert mixing.mix(sizes).exceptAll(mixing.mix(sizes)).count() == 0


def test_pivotal_keeps_words_and_expectation():
    n, p = 40, 0.3
    hits = np.zeros(n)
    for seed in range(400):
        out = list(mixing.pivotal(iter([(i, n - i, p) for i in range(n)]), seed))
        assert sum((n - i) * x for i, x in out) == pytest.approx(p * n * (n + 1) / 2)
        for i, x in out:
            hits[i] += x
    assert abs(hits / 400 - p).max() < 0.12


def test_plain_words_are_learned_without_the_pattern(monkeypatch):
    import re
    from types import SimpleNamespace

    import numpy as np
    from tokenizers import Tokenizer

    from noticeloom.llm import packing

    seen, real, path = [], packing.WordEncoder.PARTS, packing.default_tokenizer()
    monkeypatch.setattr(packing.WordEncoder, "PARTS", SimpleNamespace(fullmatch=lambda w: (seen.append(w), real.fullmatch(w))[1]))
    encoder, plain, text = packing.WordEncoder(path), Tokenizer.from_file(path), "The cat, sat CATS cat ona 日本 hélas x1 don't <|a|> Qwzx (cat) the"
    for t in (text, text.upper(), "qwzx 'cat THE"):
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    assert "cat," in seen and not [w for w in seen if re.fullmatch("[A-Za-z]+", w)]
