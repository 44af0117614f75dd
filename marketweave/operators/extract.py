"""Links of archive pages, and article fields from pages in layers: linked data, then meta tags, then paragraphs."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE_PATH = r"/(\d{4})/(\d{2})/(\d{2})/"
STRICT_PATH = r"/(\d{4})/(\d{2})/(\d{2})/[a-z0-9\-]+\.html"
# Kinds of linked data that describe an article, and where its text stands, most specific first.
ARTICLE_KINDS = ("NewsArticle", "Article", "ReportageNewsArticle")
BODY_PLACES = (("div", "class", "ArticleBody-articleBody"), ("div", "data-module", "ArticleBody"), ("div", "class", "group"), ("article", None, None))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_FIELDS = ("title", "published", "modified", "description", "body", "author", "section")


class _Page(HTMLParser):
    """Collects anchors, linked data, meta tags and paragraphs with the places that hold them, in one pass."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.anchors: list[tuple[str, list[str]]] = []
        self.linked: list[list[str]] = []
        self.meta: dict[tuple[str, str], str | None] = {}
        self.places: list[list[list[list[str]]]] = [[] for _ in BODY_PLACES]
        self._open: list[tuple[str, list]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        sinks: list = []
        if tag == "meta":
            for kind in ("property", "name"):
                if a.get(kind):
                    self.meta.setdefault((kind, a[kind]), a.get("content"))
            return
        if tag in _VOID:
            return
        if tag == "a" and a.get("href") is not None:
            self.anchors.append((a["href"], []))
            sinks.append(("text", self.anchors[-1][1]))
        if tag == "script" and a.get("type") == "application/ld+json":
            self.linked.append([])
            sinks.append(("script", self.linked[-1]))
        for place, (name, key, value) in enumerate(BODY_PLACES):
            held = (a.get(key) or "") if key else ""
            if tag == name and (key is None or (value in held.split() if key == "class" else value == held)):
                self.places[place].append([])
                sinks.append(("place", self.places[place][-1]))
        if tag == "p":
            while any(t == "p" for t, _ in self._open):  # a paragraph ends where the next begins
                self.handle_endtag("p")
            para: list[str] = []
            for _, kinds in self._open:
                for kind, sink in kinds:
                    if kind == "place":
                        sink.append(para)
            sinks.append(("text", para))
        self._open.append((tag, sinks))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                del self._open[i:]
                return

    def handle_data(self, data: str) -> None:
        inside_script = bool(self._open) and self._open[-1][0] in ("script", "style")
        for _, kinds in self._open:
            for kind, sink in kinds:
                if kind == "script" or (kind == "text" and not inside_script):
                    sink.append(data)


def _parse(html: str | None) -> _Page:
    page = _Page()
    if isinstance(html, str):
        page.feed(html)
        page.close()
    return page


def page_links(html: str | None) -> list[tuple[str, str]]:
    """Target and text of each anchor, in order; pieces of text are stripped and joined as they stand."""
    return [(href, "".join(x.strip() for x in text)) for href, text in _parse(html).anchors]


def _names(author: object) -> str | None:
    if isinstance(author, dict):
        return author.get("name")
    if isinstance(author, list):
        return ", ".join(a.get("name") or "" for a in author if isinstance(a, dict))
    return None


def page_fields(html: str | None) -> dict[str, str | None]:
    """Fields of an article page; each layer fills what those before it left empty."""
    page, out = _parse(html), dict.fromkeys(_FIELDS)
    for parts in page.linked:
        try:
            data = json.loads("".join(parts) or "{}")
        except ValueError:
            continue
        if isinstance(data, list):
            data = next((d for d in data if isinstance(d, dict)), {})
        kind = data.get("@type") if isinstance(data, dict) else None
        if isinstance(kind, str) and kind in ARTICLE_KINDS:
            names = {"title": "headline", "published": "datePublished", "modified": "dateModified", "description": "description", "body": "articleBody"}
            out.update({k: data.get(v) for k, v in names.items()}, author=_names(data.get("author")))
            break
    meta = lambda n: page.meta[("property", n)] if ("property", n) in page.meta else page.meta.get(("name", n))
    out["title"] = out["title"] or meta("og:title")
    out["description"] = out["description"] or meta("og:description")
    out["published"] = out["published"] or meta("article:published_time")
    out["section"] = meta("article:section") or meta("og:section")
    if not out["body"]:
        for found in page.places:
            paras = [" ".join(s for x in p if (s := x.strip())) for p in found[0]] if found else []
            if len(paras) >= 3:
                out["body"] = " ".join(paras)
                break
    return {k: v if v is None or isinstance(v, str) else str(v) for k, v in out.items()}


def links(html: Column) -> Column:
    @F.pandas_udf("array<struct<href:string,text:string>>")
    def batch(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: [{"href": a, "text": b} for a, b in page_links(h)])

    return batch(html)


def fields(html: Column) -> Column:
    @F.pandas_udf(", ".join(f"{f} string" for f in _FIELDS))
    def batch(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_fields(h) for h in pages], columns=list(_FIELDS), dtype=object)

    return batch(html)


def archive_links(pages: DataFrame, base: str, host: str, strict: bool = False, least_title: int = 15) -> DataFrame:
    """``page_id``, ``title``, ``url``, ``date`` of the article links of archive pages (``page_id``, ``date``, ``html``).

    Relative links get the base; of links to one url on a page the first with a long enough title counts. Strict: the path ends
    in a slug with .html and names the page's own date.
    """
    each = pages.select("page_id", "date", F.posexplode(links(F.col("html"))).alias("pos", "a"))
    url = F.when(F.startswith(F.col("a.href"), F.lit("/")), F.concat(F.lit(base), F.col("a.href"))).otherwise(F.col("a.href"))
    each = each.filter(F.col("a.href").rlike(STRICT_PATH if strict else DATE_PATH)).select("page_id", "date", "pos", url.alias("url"), F.col("a.text").alias("title"))
    each = each.filter(F.contains("url", F.lit(host)) & (F.length("title") >= least_title))
    if strict:
        each = each.filter(link_date(F.col("url")) == F.col("date"))
    return each.groupBy("page_id", "url").agg(F.min_by(F.struct("title", "date"), "pos").alias("x")).select("page_id", "x.title", "url", "x.date")


def link_date(url: Column) -> Column:
    """The date in a url's path, null without one."""
    part = lambda i: F.regexp_extract(url, DATE_PATH, i)
    return F.when(url.rlike(DATE_PATH), F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd"))


def articles_from_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("_f", fields(F.col("html"))).select("url", *(f"_f.{f}" for f in _FIELDS))
