"""HTML pages: text, metadata, links, by one streaming parser."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_LINKS, MAX_CHARS = 200, 4_000_000
_SKIP = frozenset("script style noscript template svg iframe form nav footer aside header button select".split())
_BREAK = frozenset("p div br li h1 h2 h3 h4 h5 h6 blockquote article section tr td th ul ol table".split())
_VOID = frozenset("br hr img input meta link source wbr area base col embed track".split())
_META = {
    "og:title": "title", "twitter:title": "title", "og:description": "description", "description": "description", "twitter:description": "description", "og:image": "image", "twitter:image": "image",
    "og:url": "canonical", "author": "author", "article:author": "author", "article:published_time": "published_at", "date": "published_at", "pubdate": "published_at", "article:section": "category", "og:site_name": "site_name",
}
_NO_LINK = ("#", "mailto:", "javascript:", "tel:", "data:")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.links: list[str] = []
        self.pieces: list[str] = []
        self.blocks: list[str] = []
        self.skipping: list[str] = []
        self.inside: str = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            field = _META.get((a.get("property") or a.get("name") or "").lower())
            if field and a.get("content", "").strip():
                self.meta.setdefault(field, a["content"].strip())
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.meta["canonical"] = a.get("href", "")
        elif tag == "html" and a.get("lang"):
            self.meta["language"] = a["lang"]
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"].strip())
        elif tag == "time" and a.get("datetime"):
            self.meta.setdefault("published_at", a["datetime"])
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.inside = "ld"
        elif tag in ("title", "h1"):
            self.inside = tag
        if tag in _SKIP and tag not in _VOID:
            self.skipping.append(tag)
        if tag in _BREAK:
            self._flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skipping:
            while self.skipping.pop() != tag:
                pass
        if tag in ("script", "title", "h1"):
            self.inside = ""
        if tag in _BREAK:
            self._flush()

    def handle_data(self, data: str) -> None:
        if self.inside == "ld":
            self._ld(data)
        elif self.inside in ("title", "h1"):
            self.meta.setdefault({"title": "page_title", "h1": "heading"}[self.inside], data.strip())
        if not self.skipping and self.inside != "title":
            self.pieces.append(data)

    def _ld(self, data: str) -> None:
        try:
            found = json.loads(data)
        except ValueError:
            return
        for block in _flatten(found, 4):
            kind = block.get("@type")
            if any("Article" in str(k) for k in (kind if isinstance(kind, list) else [kind])):
                for key, field in (("headline", "title"), ("description", "description"), ("articleBody", "content"), ("datePublished", "published_at"), ("dateModified", "updated_at"), ("articleSection", "category")):
                    if isinstance(block.get(key), str):
                        self.meta.setdefault(f"ld_{field}", block[key])
                author = block.get("author")
                author = author[0] if isinstance(author, list) and author else author
                name = author.get("name") if isinstance(author, dict) else author
                if isinstance(name, str):
                    self.meta.setdefault("ld_author", name)

    def _flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.pieces)).strip()
        self.pieces = []
        if text:
            self.blocks.append(text)


def _flatten(node: object, depth: int) -> Iterator[dict]:
    if depth and isinstance(node, list):
        for x in node:
            yield from _flatten(x, depth - 1)
    elif depth and isinstance(node, dict):
        yield node
        yield from _flatten(node.get("@graph"), depth - 1)


def parse_page(markup: str | None, url: str = "") -> dict:
    """Fields of an article page: structured data first, then metadata, then headings and text."""
    page = _Page()
    page.feed((markup or "")[:MAX_CHARS])
    page.close()
    page._flush()
    m = page.meta
    pick = lambda *names: next((m[n] for n in names if m.get(n)), None)
    image = pick("image")
    return {
        "title": pick("ld_title", "title", "heading", "page_title"),
        "description": pick("ld_description", "description"),
        "content": pick("ld_content") or "\n\n".join(page.blocks) or None,
        "author": pick("ld_author", "author"),
        "published_at": pick("ld_published_at", "published_at"),
        "category": pick("ld_category", "category"),
        "language": pick("language"),
        "image_url": urljoin(url, image) if image else None,
        "canonical": urljoin(url, m["canonical"]) if m.get("canonical") else None,
        "links": page_links(page.links, url),
    }


def page_links(hrefs: list[str], url: str, must_contain: tuple[str, ...] = ()) -> list[str]:
    """Absolute http(s) links in order, each once, at most ``MAX_LINKS``."""
    out: dict[str, None] = {}
    for href in hrefs:
        if not href or href.lower().startswith(_NO_LINK):
            continue
        try:
            link = urljoin(url, href)
        except ValueError:
            continue
        if link.startswith(("http://", "https://")) and (not must_contain or any(x in link for x in must_contain)):
            out.setdefault(link)
    return list(out)[:MAX_LINKS]


_FIELDS = ("title", "description", "content", "author", "published_at", "category", "language", "image_url", "canonical")


def _parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        pages = [parse_page(h, u or "") for h, u in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([p[f] for p in pages], pa.string()) for f in _FIELDS), pa.array([p["links"] for p in pages], pa.list_(pa.string()))], names=["id", *_FIELDS, "links"])


def parse_pages(pages: DataFrame) -> DataFrame:
    """Article fields and links of (id, url, html)."""
    return pages.select("id", "url", "html").mapInArrow(_parse, "id long, " + ", ".join(f"{f} string" for f in _FIELDS) + ", links array<string>")
