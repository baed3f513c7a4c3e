"""PII: base detectors, and offset-preserving deobfuscation.

A text passes through small transducers that rewrite disguises and remember, for every character they write, the
source characters it stands for: homoglyphs and compatibility forms, spelled digits, at/dot disguises. The base
detectors run again over the normalised text; what they find there is mapped back to source characters and added,
unless a base span of its kind already covers it. Base spans always stay. A match counts as disguised only if it covers a
rewritten piece, so a text without disguises has its base spans and nothing else.

All detectors are linear in the length of the text. Row-local: no shuffle, one batch of texts in memory.
Defined results: a null text is empty and has no spans; repeated rows, null ids and ties give a row each; an empty
table gives no rows; other columns are ignored. Offsets are code points, ends exclusive."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import read_table

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TWICE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    return sum(_TWICE[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: each is the run of local characters before an @ that a domain follows."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", max(end, at + 1))


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base detectors, sorted."""
    found = [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- transducers: each takes and returns text with, per character, the start and end of its source -----------------

#: Letters of other scripts that look like ASCII ones (fixed values).
HOMOGLYPHS = dict(
    zip(
        "АВСЕНІЈКМОРЅТХУаcеһіјорѕхуԁԛԝѵΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυ",
        "ABCEHIJKMOPSTXYaceHijopsxydqwvABEZHIKMNOPTYXavopu",
        strict=True,
    )
)
#: Characters of compatibility forms, other digits and look-alike scripts; zero-width ones.
_ODD = re.compile("[Ͱ-ϿЀ-ԯ٠-٩۰-۹०-९​-‍‐-―⁠﹫！-～﻿\U0001d400-\U0001d7ff]")

DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT_WORD = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
#: At least four spelled digits in a row; "dot" and "plus" may stand with them.
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:plus[ -])?(?:{_DIGIT_WORD})(?:[ .,-]{{1,2}}(?:dot[ -])?(?:{_DIGIT_WORD})){{3,}}(?![A-Za-z])", re.I)
_SPELLED_PART = re.compile(rf"[ ,-]*(?:({_DIGIT_WORD})|(plus)|(?:(dot|\.))(?=[ -]?))[ ,-]*", re.I)

_AT = r"(?:[ ]*[\[({<][ ]*(?:at|@)[ ]*[\])}>][ ]*|[ ]+at[ ]+|[ ]*@[ ]*)"
_DOT = r"(?:[ ]*[\[({<][ ]*(?:dot|\.)[ ]*[\])}>][ ]*|[ ]+dot[ ]+|\.)"
#: A local part, a disguised or plain at, labels with disguised or plain dots between; the last label is letters.
_DISGUISED = re.compile(rf"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9_%+-]{{0,63}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,4}}(?P<at>{_AT})[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{0,5}}(?P<dot>{_DOT})[A-Za-z]{{2,24}}(?![A-Za-z0-9])", re.I)
#: A name with a dot or underscore; what stands before an address; the two with a plain at and dot.
_DOTTED, _ASKED = re.compile(r"[A-Za-z]+(?:[._][A-Za-z0-9]+)+"), re.compile(r"\b(?:e-?mail|mail|write to|contact|reach(?: me)?(?: at)?|address)[ :]*$", re.I)
_SAID_AT = re.compile(r"(?:[A-Za-z][._][A-Za-z0-9]+|\b(?:e-?mail|mail|write to|contact|reach|address)[ :][A-Za-z0-9 :._%+-]{1,40}) +at +[A-Za-z0-9-]+\.[A-Za-z]{2}", re.I)
_DOT_PART, _LABEL = re.compile(_DOT, re.I), re.compile(r"[A-Za-z0-9-]*")
_IP_DOT = re.compile(r"(?<=[0-9])(?:[ ]*[\[({][ ]*(?:dot|\.)[ ]*[\])}][ ]*|[ ]+dot[ ]+)(?=[0-9])", re.I)

_BRACKETED = re.compile(r"[\[({<] ?(?:at|@|dot|\.) ?[\])}>]")
#: What every spelled number or disguise holds, looked for in the lower-cased text before any transducer runs.
_HINTS = (" dot ", "@ ", " @", "zero", "two", "three", "four", "five", "six", "seven", "eight", "nine", "one one", "one-one", "oh oh", "oh-oh", "one oh", "one-oh", "oh one", "oh-one")
#: Words that stand before "dot" in prose, not in an address.
_PROSE = frozenset(("the", "a", "an", "this", "that", "each", "every", "one", "my", "your", "our", "his", "her", "their"))


def _suspicious(text: str) -> bool:
    if _ODD.search(text):
        return True
    low = text.lower()
    return any(x in low for x in _HINTS) and bool(" dot " in low or "@ " in low or " @" in low or _SPELLED.search(text)) or bool(_BRACKETED.search(low)) or (" at " in low and bool(_SAID_AT.search(text)))

Mapped = tuple[str, list[int], list[int]]


def _rewritten(x: Mapped, pieces: list[tuple[int, int, str]]) -> Mapped:
    """``pieces``: (start, end, what is written instead), in order; each written character stands for the whole piece."""
    if not pieces:
        return x
    text, starts, ends = x
    out, s, e, at = [], [], [], 0
    for a, b, new in pieces:
        out.append(text[at:a])
        s += starts[at:a]
        e += ends[at:a]
        out.append(new)
        s += [starts[a]] * len(new)
        e += [ends[b - 1]] * len(new)
        at = b
    out.append(text[at:])
    return "".join(out), s + starts[at:], e + ends[at:]


def _plain(ch: str) -> str:
    """The ASCII character that ``ch`` looks like, nothing for a zero-width one, else itself."""
    if ch in HOMOGLYPHS:
        return HOMOGLYPHS[ch]
    if unicodedata.category(ch) == "Cf":
        return ""
    if unicodedata.category(ch) == "Pd":
        return "-"
    if (d := unicodedata.digit(ch, None)) is not None:
        return str(d)
    return x if len(x := unicodedata.normalize("NFKC", ch)) == 1 and x.isascii() else ch


def homoglyphs(x: Mapped) -> Mapped:
    return _rewritten(x, [(m.start(), m.end(), new) for m in _ODD.finditer(x[0]) if (new := _plain(m.group())) != m.group()])


def spelled_digits(x: Mapped) -> Mapped:
    pieces = []
    for run in _SPELLED.finditer(x[0]):
        for m in _SPELLED_PART.finditer(x[0], run.start(), run.end()):
            pieces.append((m.start(), m.end(), DIGIT_WORDS[m[1].lower()] if m[1] else "+" if m[2] else "."))
    return _rewritten(x, pieces)


def at_dot(x: Mapped) -> Mapped:
    pieces = []
    for run in _DISGUISED.finditer(x[0]):
        at, text = run.span("at"), run.group()
        plain_at = run["at"] == "@"
        if run["at"].strip().lower() == "at" and run["dot"] == "." and not (_DOTTED.fullmatch(x[0], run.start(), at[0]) or _ASKED.search(x[0], max(0, run.start() - 20), run.start())):
            continue  # "look at example.com" is prose; "john.smith at example.com" is not, nor what "mail" stands before
        if _LABEL.match(x[0], at[1])[0].lower() in _PROSE:
            continue
        if plain_at and " dot " not in text.lower() and not re.search(r"[\[({<]", text):
            continue
        for a, b in ((run.start(), at[0]), (at[1], run.end())):
            pieces += [(m.start(), m.end(), ".") for m in _DOT_PART.finditer(x[0], a, b) if m.group() != "."]
        if not plain_at:
            pieces.append((*at, "@"))
    x = _rewritten(x, sorted(pieces))
    return _rewritten(x, [(m.start(), m.end(), ".") for m in _IP_DOT.finditer(x[0])])


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the detectors find only after the transducers, in source characters."""
    if not _suspicious(text):
        return []
    size = len(text)
    new, starts, ends = at_dot(spelled_digits(homoglyphs((text, list(range(size)), list(range(1, size + 1))))))
    if new == text:
        return []
    changed = [0]
    for ch, s, e in zip(new, starts, ends, strict=True):
        changed.append(changed[-1] + (e - s != 1 or text[s] != ch))
    taken = {k: [(s, e) for s, kind, e in base if kind == k] for k in range(len(KINDS))}
    out = []
    for s, kind, e in detect(new):
        a, b = starts[s], ends[e - 1]
        rewritten = changed[e] > changed[s] or b - a != e - s
        if rewritten and not any(x <= a and b <= y for x, y in taken[kind]):
            out.append((a, kind, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


SPANS = "array<struct<kind:string,start:long,end:long,disguised:boolean>>"


def find_pii(docs: DataFrame, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """``docs`` with a column of spans by start, then kind; its other columns stay (one of that name is replaced)."""
    kept = [c for c in docs.columns if c != spans_col]
    df = docs.select(*(docs[c] for c in kept), F.coalesce(docs[text_col], F.lit("")).alias("__pii_text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for text in b["__pii_text"].to_pylist():
                base = detect(text)
                more = disguised(text, base)
                every = sorted([(*x, False) for x in base] + [(*x, True) for x in more])
                spans.append([{"kind": KINDS[k], "start": s, "end": e, "disguised": d} for s, k, e, d in every])
            cols = [c for c, n in zip(b.columns, b.schema.names, strict=True) if n != "__pii_text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, kind)], [*kept, spans_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != spans_col), f"`{spans_col}` {SPANS}"])
    return df.mapInArrow(run, schema)


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in angle brackets; the columns stay as they are.

    Overlapping spans are replaced once, by the kind of the first."""
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index(text_col)
            out = []
            for text in b[text_col].to_pylist():
                spans = sorted((base := detect(text)) + disguised(text, base)) if text else []
                parts, end = [], 0
                for s, k, e in spans:
                    if s >= end:
                        parts += [text[end:s], f"<{KINDS[k]}>"]
                    end = max(end, e)
                out.append("".join(parts) + text[end:] if spans else text)
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document, base counts and a digest of the base spans."""
    found = find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    line = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    of = lambda kind: lambda x: x["kind"] == kind
    base = F.filter("pii_spans", lambda x: ~x["disguised"])
    return found.select(
        "doc_id",
        *(F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii_spans", line), ",").alias("spans"),
        F.size(F.filter("pii_spans", lambda x: x["disguised"])).cast("long").alias("n_disguised"),
    )

