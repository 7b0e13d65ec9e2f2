"""Web pages as a source: titles, dates and the article's paragraphs."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Meta names that date a page, in order of trust.
DATES = ["article:published_time", "date", "pubdate", "publishdate", "og:published_time"]


def raw_title(page: Column) -> Column:
    return F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)


def paragraph_count(page: Column) -> Column:
    return F.regexp_count(page, F.lit(r"(?i)<p[ >]"))


def language(page: Column) -> Column:
    return F.regexp_extract(page, r"(?i)<html[^>]*\slang=\"([^\"]*)\"", 1)


def canonical(page: Column) -> Column:
    return F.regexp_extract(page, r"(?i)<link[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']+)", 1)


def iso_time(text: Column) -> Column:
    """An ISO timestamp, or its date part; without a zone it is UTC."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))


def published(page: Column) -> Column:
    """The first of the dated metas, then of a time element; null without one."""
    meta = [F.regexp_extract(page, rf"(?i)<meta[^>]*(?:name|property)=[\"']{n}[\"'][^>]*content=[\"']([^\"']+)", 1) for n in DATES]
    meta.append(F.regexp_extract(page, r"(?i)<time[^>]*datetime=[\"']([^\"']+)", 1))
    return F.coalesce(*[iso_time(F.nullif(m, F.lit(""))) for m in meta])


class _Reader(HTMLParser):
    """Title and paragraphs, each with the containers that it stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.title, self.paragraphs, self.buffer = "", [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "main"):
            self.open.append(tag)
        elif tag == "div":
            self.open.append("content" if "content" in (dict(attrs).get("class") or "").split() else "div")
        elif tag in ("script", "style", "nav", "footer"):
            self.open.append("skip")
        elif tag == "p":
            self.close_paragraph()
            self.buffer = []
        elif tag == "title":
            self.open.append("title")
        elif tag == "br" and self.buffer is not None:
            self.buffer.append(" ")

    def handle_endtag(self, tag):
        if tag == "p":
            self.close_paragraph()
        name = {"script": "skip", "style": "skip", "nav": "skip", "footer": "skip"}.get(tag, tag)
        for want in (name, "content") if tag == "div" else (name,):
            if want in self.open:
                if tag in ("article", "main", "div"):
                    self.close_paragraph()
                del self.open[len(self.open) - 1 - self.open[::-1].index(want) :]
                break

    def close_paragraph(self):
        if self.buffer is not None:
            text = " ".join("".join(self.buffer).split())
            if text and "skip" not in self.open:
                self.paragraphs.append((set(self.open), text))
            self.buffer = None

    def handle_data(self, data):
        if self.open and self.open[-1] == "title":
            self.title += data
        elif self.buffer is not None and "skip" not in self.open:
            self.buffer.append(data)


def read_page(page: str | None) -> tuple[str, str]:
    """Title and text: paragraphs of the article, else of main, else of a content division, else all."""
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    reader.close_paragraph()
    for where in ("article", "main", "content", None):
        text = [t for inside, t in reader.paragraphs if where is None or where in inside]
        if text:
            return " ".join(reader.title.split()), "\n\n".join(text)
    return " ".join(reader.title.split()), ""


def articles(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    """key, title, text_chars, text_hash, failed: pages without title and text fail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [read_page(h) for h in b["page"]]
            yield pd.DataFrame({key: b[key], "title": [t for t, _ in got], "text": [x for _, x in got]})

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(key, F.col(page).alias("page")).mapInPandas(run, f"{key} {kind}, title string, text string")
    return out.select(key, "title", F.length("text").alias("text_chars"), F.sha2("text", 256).alias("text_hash"), ((F.col("title") == "") & (F.col("text") == "")).alias("failed"))
