"""License scans: an exact set-similarity join of text blocks with notice templates.

The blocks of a text are all runs of consecutive words as long as a template's room (``ROOM`` times its words) that
begin with one of its tokens, whatever lines or comment marks they cross. A block matches a template when it holds at
least ``THRESHOLD`` of the template's distinct tokens; stop words are no tokens. Tokens are ordered by their frequency over
all documents, rarest first, and a template's prefix is its first ``n - need + 1`` tokens: a block without any of them
cannot reach ``need`` (prefix filter; that its rarest token is at most the template's ``n - need``-th is the positional
filter, the same test for one set), so the scan goes from one prefix token to the next. A block with fewer than ``need``
occurrences of tokens cannot either (length filter). What is left is counted exactly by a sliding count, so the work on a
text is linear in its words for each template, and every matching block is given, those that overlap too. A block is
``named`` when it also holds the phrases that name the license: only such blocks give labels and a score, so that words
that merely stand near each other label nothing. Templates are a bounded table, so their index goes to every task with
the code; the documents are neither shuffled nor copied.

Base labels come from phrases of consecutive words; the named blocks of the join add their labels to them.
Defined results: a null text is empty: no words, no labels, score 0; repeated rows and null ids give a row each; an
empty table gives no rows; other columns are ignored; equal containments of two templates give both labels."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import read_table

#: (label, phrase) of the base scan (fixed values).
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Notices whose parts recur (fixed values).
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: (label, phrases that name the license, notice) of the join: how works state their license, short and whole (fixed values).
TEMPLATES = (
    ("mit", "mit license", "Released under the MIT License"),
    ("mit", "mit license", "Licensed under the MIT License"),
    ("mit", "permission, granted, charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "apache license", "Licensed under the Apache License, Version 2.0"),
    ("apache", "apache license", "Licensed under the Apache License"),
    ("apache", "apache, compliance", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    ("gpl", "gnu general public", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "gnu general public", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "lesser general public", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc", "cc by", "Licensed under CC BY-NC 4.0"),
    ("cc", "creative commons", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "redistribution, source, binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "endorse, promote", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission, purpose, fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "mozilla public", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mit", "permission, granted, charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "apache license", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "gnu general public", _GPL.format("", "")),
    ("lgpl", "gnu lesser general public", _GPL.format("Lesser ", "Lesser ")),
    ("agpl", "gnu affero general public", _GPL.format("Affero ", "Affero ")),
    ("agpl", "gnu affero general public", "licensed under the GNU Affero General Public License"),
    ("gpl", "gnu gpl", "GNU GPL v3"),
    ("gpl", "gnu gpl", "GNU GPL version 3"),
    ("bsd", "redistribution, source, binary", _BSD),
    ("bsd", "redistribution, endorse", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "bsd license", "BSD License"),
    ("bsd", "bsd 2 clause", "BSD 2-Clause License"),
    ("bsd", "bsd 3 clause", "BSD 3-Clause License"),
    ("isc", "permission, purpose, fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "mozilla public", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl", "mozilla public license", "Mozilla Public License 2.0"),
    ("unlicense", "public domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mit", "spdx license identifier mit", "SPDX-License-Identifier: MIT"),
    ("apache", "spdx license identifier apache", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "spdx license identifier gpl", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("gpl", "spdx license identifier gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "spdx license identifier lgpl", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("agpl", "spdx license identifier agpl", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("bsd", "spdx license identifier bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "spdx license identifier bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("isc", "spdx license identifier isc", "SPDX-License-Identifier: ISC"),
    ("mpl", "spdx license identifier mpl", "SPDX-License-Identifier: MPL-2.0"),
    ("cc", "spdx license identifier cc by", "SPDX-License-Identifier: CC-BY-4.0"),
)
#: Words that state nothing.
STOP = frozenset(b"a an and any are as at be by for in is it its may not of or that the this to with you".split())
THRESHOLD = (4, 5)  # of a template's tokens
ROOM = (5, 4)

#: Every ASCII byte that is not a letter or digit becomes a space; other bytes belong to words.
_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return text.lower().translate(_TABLE).split()


def template_tokens(templates=TEMPLATES) -> list[tuple[str, frozenset[bytes], list[list[bytes]]]]:
    """(label, tokens, words of the phrases that name the license)."""
    return [(label, frozenset(words(text.encode())) - STOP, [words(p.encode()) for p in must.split(",")]) for label, must, text in templates]


def phrase_places(ws: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where a phrase's words stand consecutively."""
    out, i = [], -1
    while True:
        try:
            i = ws.index(phrase[0], i + 1)
        except ValueError:
            return out
        if ws[i : i + len(phrase)] == phrase:
            out.append(i)


def token_frequencies(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> dict[str, int]:
    """How often each template token occurs in all documents; one row per template token reaches the driver."""
    vocabulary = frozenset().union(*(t for _, t, _ in template_tokens(templates)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in batches:
            for text in b[0].cast(pa.binary()).to_pylist():
                if text:
                    count.update(filter(vocabulary.__contains__, words(text)))
        yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in count], pa.string()), pa.array(count.values(), pa.int64())], ["token", "n"])

    counted = docs.select(text_col).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}


class TemplateIndex:
    """Prefixes of the templates in global token order."""

    def __init__(self, templates, frequency: dict[str, int], threshold=THRESHOLD):
        self.sets = []
        for (label, tokens, must), (_, _, text) in zip(template_tokens(templates), templates, strict=True):
            order = {t: i for i, t in enumerate(sorted(tokens, key=lambda t: (frequency.get(t.decode(), 0), t)))}
            need = -(-len(order) * threshold[0] // threshold[1])
            room = -(-len(words(text.encode())) * ROOM[0] // ROOM[1])
            self.sets.append((label, order, must, need, room))
        #: Prefix tokens: those of which every matching block has one.
        self.tokens = frozenset(t for _, order, _, need, _ in self.sets for t, i in order.items() if len(order) - i >= need)

    def matches(self, ws: list[bytes]) -> Iterator[tuple[str, int, int, float, bool]]:
        """(label, first word, words, containment, named) of every block that holds enough of a template."""
        if self.tokens.isdisjoint(ws):
            return
        held = frozenset(ws)
        for label, order, names, need, room in self.sets:
            n = len(order)
            if sum(t in held for t in order) < need:
                continue
            at = [i for i, w in enumerate(ws) if w in order]
            rank = [order[ws[i]] for i in at]
            anchors = [i for i, r in zip(at, rank, strict=True) if n - r >= need]
            named = [(len(p), phrase_places(ws, p)) for p in names]
            inside, distinct, k, lo, hi, a = [0] * n, 0, 0, 0, 0, 0
            while k < len(at):
                start = at[k]
                while a < len(anchors) and anchors[a] < start:
                    a += 1
                if a == len(anchors):
                    break
                if anchors[a] >= start + room:  # prefix filter: on to the first block that reaches the anchor
                    k = bisect_left(at, anchors[a] - room + 1)
                    continue
                for r in rank[lo : min(k, hi)]:
                    inside[r] -= 1
                    distinct -= not inside[r]
                lo = k
                hi = max(hi, k)
                while hi < len(at) and at[hi] < start + room:
                    distinct += not inside[rank[hi]]
                    inside[rank[hi]] += 1
                    hi += 1
                if hi - k >= need and distinct >= need:  # the length filter, then the count
                    whole = all((i := bisect_left(x, start)) < len(x) and x[i] + size <= start + room for size, x in named)
                    yield label, start, at[hi - 1] + 1 - start, distinct / n, whole
                k += 1


def places(ws: list[bytes], phrases=PHRASES) -> list[tuple[int, str]]:
    """(place, label) wherever a phrase's words stand consecutively."""
    return [(i, label) for label, phrase in phrases for i in phrase_places(ws, phrase.encode().split())]


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold=THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: words, phrase places, and the blocks that match a template: (label, first word, words, containment, named)."""
    index = TemplateIndex(templates, token_frequencies(docs, templates, text_col), threshold)
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    match = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64()), ("named", pa.bool_())]))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, base, found = [], [], []
            for text in b[1].cast(pa.binary()).to_pylist():
                ws = words(text or b"")
                n.append(len(ws))
                base.append([{"word": i, "label": x} for i, x in sorted(places(ws, phrases))])
                found.append([{"label": label, "word": at, "n_words": size, "containment": c, "named": named} for label, at, size, c, named in index.matches(ws)])
            yield pa.RecordBatch.from_arrays([b[0], pa.array(n, pa.int64()), pa.array(base, place), pa.array(found, match)], ["doc_id", "n_words", "places", "blocks"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, places array<struct<word:long,label:string>>, blocks array<struct<label:string,word:long,n_words:long,containment:double,named:boolean>>")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and labels of every document, with the labels and best containment of the join."""
    x = scan_licenses(read_table(spark, sf_dir, "documents")).withColumn("blocks", F.filter("blocks", lambda p: p["named"]))
    word, label = F.transform("places", lambda p: p["word"]), lambda c: F.transform(c, lambda p: p["label"])
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return x.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        listed(label("places")).alias("base_labels"),
        listed(F.concat(label("places"), label("blocks"))).alias("labels"),
        F.coalesce(F.array_max(F.transform("blocks", lambda p: p["containment"])), F.lit(0.0)).alias("score"),
    )
