"""HTML as rows: text, meta entries, links, infobox and tables. Two forms: regular expressions in the JVM, and a parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import squeeze

#: Elements whose content is no text of the page, and those that hold the page's own text.
DROPPED = ("script", "style", "nav", "footer", "header", "aside", "noscript", "template")
BODIES = ("main", "article", "body")
META_KEYS = ("description", "keywords", "og:title", "og:description", "og:url")
SCHEMA = "text string, meta map<string,string>, links array<struct<label:string,url:string>>, infobox map<string,string>, tables array<array<array<string>>>"


def text_by_regex(html: Column) -> Column:
    """The text of the page without dropped elements, comments and tags; white space squeezed."""
    body = html
    for tag in DROPPED:
        body = F.regexp_replace(body, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?s)<[^>]+>", " ")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(ch))
    return squeeze(body)


def title_by_regex(html: Column) -> Column:
    return squeeze(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links_by_regex(html: Column, base: Column) -> Column:
    """Distinct addresses of the page's links; relative ones get the scheme and host of base; fragments are dropped."""
    root = F.regexp_extract(base, r"^(\w+://[^/?#]*)", 1)
    raw = F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"'#]+)"), F.lit(1))
    whole = F.transform(raw, lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), F.concat(root, u)).otherwise(u))
    return F.array_distinct(F.filter(whole, lambda u: u.rlike(r"^https?://")))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.links: list[list[str]] = []
        self.tables: list[list[list[str]]] = []
        self.text = {b: [] for b in BODIES}
        self.open: list[str] = []
        self.row: list[str] | None = None
        self.cell: list[str] | None = None
        self.label: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "meta":
            key = (a.get("name") or a.get("property") or "").lower()
            if key in META_KEYS and a.get("content"):
                self.meta.setdefault(key, a["content"].strip())
            return
        if tag in ("br", "img", "link", "input", "hr"):
            return
        self.open.append(tag)
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []
        elif tag == "a" and a.get("href"):
            self.links.append(["", a["href"].strip()])
            self.label = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None and self.row is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            if self.row and self.tables:
                self.tables[-1].append(self.row)
            self.row = None
        elif tag == "a" and self.label is not None:
            self.links[-1][0] = " ".join("".join(self.label).split())
            self.label = None
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)
        if self.label is not None:
            self.label.append(data)
        if not any(t in DROPPED for t in self.open):
            for b in BODIES:
                if b in self.open:
                    self.text[b].append(data)


def parse(html: str | None, base: str | None) -> tuple:
    """(text, meta, links, infobox, tables) of one page; an empty or broken page gives what can be read."""
    page = _Page()
    page.feed(html or "")
    page.close()
    text = next((" ".join(" ".join(page.text[b]).split()) for b in BODIES if any(x.strip() for x in page.text[b])), "")
    if not text:
        text = " ".join(re.sub(r"<[^>]+>", " ", html or "").split())
    root = m[1] if (m := re.match(r"(\w+://[^/?#]*)", base or "")) else ""
    links = []
    for label, url in page.links:
        url = "https:" + url if url.startswith("//") else root + url if url.startswith("/") else url
        if url.startswith("http") and (label, url) not in links:
            links.append((label, url))
    for url in re.findall(r"https?://[^\s)>\]\"'<]+", text):
        if all(url != u for _, u in links):
            links.append(("", url))
    box = {row[0]: row[1] for t in page.tables for row in t if len(row) == 2 and 0 < len(row[0]) < 40 and row[1]}
    return text, page.meta, links, box, [t for t in page.tables if t]


def parse_pages(pages: DataFrame) -> DataFrame:
    """pages (url, html, other columns) with the columns text, meta, links, infobox and tables read by the parser."""
    fields = [f"`{n}` {t}" for n, t in pages.dtypes] + [SCHEMA]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [parse(h, u) for h, u in zip(b["html"], b["url"])]
            as_rows = lambda links: [{"label": a, "url": u} for a, u in links]
            yield b.assign(text=[d[0] for d in done], meta=[d[1] for d in done], links=[as_rows(d[2]) for d in done], infobox=[d[3] for d in done], tables=[d[4] for d in done])

    return pages.mapInPandas(read, ", ".join(fields))


def table_text(tables: Column) -> Column:
    """Cells joined by bars, rows by line breaks, tables by empty lines."""
    return F.array_join(F.transform(tables, lambda t: F.array_join(F.transform(t, lambda r: F.array_join(r, " | ")), "\n")), "\n\n")


def infobox_text(box: Column) -> Column:
    """One line `key: value` per entry, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(box)), lambda e: F.concat(e.key, F.lit(": "), e.value)), "\n")
