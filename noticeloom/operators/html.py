"""HTML pages to lines, key-value pairs and links: one parse of each page, in batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.operators.tables import first_seen_dedupe

PARSED = "lines array<string>, pairs array<struct<key:string,value:string>>, links array<struct<href:string,onclick:string,text:string>>"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _clean(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


class _Page(HTMLParser):
    """Collects text nodes, table and list cells in order, and anchors."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts, self.cells, self.links, self.open, self.row, self.hidden = [], [], [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "tr":
            self.row += 1
        if tag in ("th", "td", "dt", "dd"):
            self.cells.append([tag, self.row, []])
            self.open.append((tag, self.cells[-1][2]))
        elif tag == "a":
            known = dict(attrs)
            self.links.append([known.get("href") or "", known.get("onclick") or "", []])
            self.open.append((tag, self.links[-1][2]))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if not self.hidden:
            self.texts.append(data)
            for _, parts in self.open:
                parts.append(data)


def _parse(html: str) -> tuple[list, list, list]:
    page = _Page()
    page.feed(html or "")
    page.close()
    lines = [x.strip() for t in page.texts for x in t.splitlines() if x.strip()]
    pairs: dict[str, str] = {}
    for (a, row, key), (b, next_row, value) in zip(page.cells, page.cells[1:], strict=False):
        if (a, b) == ("dt", "dd") or ((a, b) == ("th", "td") and row == next_row):
            pairs[_clean(key)] = _clean(value)  # the last wins
    return lines, list(pairs.items()), [(h, o, _clean(t)) for h, o, t in page.links]


def parse_html(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, lines, pairs, links); a null page has none of them."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_parse(h) for h in b["html"]]
            yield pd.DataFrame({
                key: b[key], "lines": [x[0] for x in found], "pairs": [[{"key": k, "value": v} for k, v in x[1]] for x in found],
                "links": [[{"href": h, "onclick": o, "text": t} for h, o, t in x[2]] for x in found],
            })

    return df.select(key, F.col(html).alias("html")).mapInPandas(run, f"{key} {kind}, {PARSED}")


def html_lines(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.select(key, F.posexplode("lines").alias("line_no", "text"))


def html_key_values(parsed: DataFrame, key: str, suffix: str = "") -> DataFrame:
    """(key, k, v), without ``suffix`` at the end of k."""
    k = F.regexp_replace("p.key", re.escape(suffix) + r"\s*$", "") if suffix else F.col("p.key")
    return parsed.select(key, F.explode("pairs").alias("p")).select(key, F.trim(k).alias("k"), F.col("p.value").alias("v"))


def html_links(parsed: DataFrame, key: str, pattern: str) -> DataFrame:
    """(key, file_id, text): the first link of each id that ``pattern``'s first group finds in href or onclick."""
    x = parsed.select(key, F.posexplode("links").alias("at", "a")).select(key, "at", "a.text", F.regexp_extract(F.concat("a.href", F.lit(" "), "a.onclick"), pattern, 1).alias("file_id"))
    x = x.where("file_id <> ''").withColumn("__id", F.struct(key, "file_id"))
    return first_seen_dedupe(x, "__id", "at").drop("__id", "at").select(key, "file_id", "text")
