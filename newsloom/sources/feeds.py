"""Feed payloads (RSS 2.0, Atom, RDF) to item rows, one Arrow stage per batch of payloads."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES, MAX_ITEMS, MAX_CATEGORIES = 10_000_000, 500, 10
_DECLARED = re.compile(rb"<!(?:DOCTYPE|ENTITY)", re.I)
FIELDS = ("title", "link", "description", "content", "author", "published", "updated", "guid", "image")
ITEM = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ",categories:array<string>>"


class FeedError(ValueError):
    """A payload that is no usable feed."""


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""


def _text(e: ElementTree.Element | None) -> str:
    return "".join(e.itertext()).strip() if e is not None else ""


def _first(item: ElementTree.Element, *names: str) -> str:
    for name in names:
        for child in item:
            if _name(child) == name and (text := _text(child)):
                return text
    return ""


def _image(item: ElementTree.Element) -> str:
    for e in item.iter():
        name, kind = _name(e), (e.get("type") or e.get("medium") or "").lower()
        if name == "thumbnail" and e.get("url"):
            return e.get("url")
        if name in ("content", "enclosure") and e.get("url") and kind.startswith("image"):
            return e.get("url")
        if name == "image":
            for link in (_first(e, "url"), e.get("href")):
                if link:
                    return link
    return ""


def _link(item: ElementTree.Element) -> str:
    """Atom's alternate link, else the first that is not about the feed; RSS's text link, else a guid that is one."""
    links = [e for e in item if _name(e) == "link"]
    refs = [e for e in links if e.get("href")]
    for e in refs:
        if e.get("rel", "alternate") == "alternate":
            return e.get("href")
    for e in refs:
        if e.get("rel") not in ("self", "edit", "hub"):
            return e.get("href")
    for e in links:
        if text := _text(e):
            return text
    guid = _first(item, "guid", "id")
    return guid if guid.startswith(("http://", "https://")) else ""


def _author(item: ElementTree.Element) -> str:
    for e in item:
        if _name(e) == "author" and (name := _first(e, "name")):
            return name
    return _first(item, "creator", "author")


def parse_feed(payload: str | bytes | None) -> dict:
    """{'format', 'title', 'items'}; raises FeedError for anything unsafe or unknown."""
    data = payload.encode() if isinstance(payload, str) else payload or b""
    if not data.strip():
        raise FeedError("empty")
    if len(data) > MAX_BYTES:
        raise FeedError("too large")
    if _DECLARED.search(data):
        raise FeedError("declares entities")
    try:
        root = ElementTree.fromstring(data.lstrip(b"\xef\xbb\xbf \r\n\t"))
    except ElementTree.ParseError as e:
        raise FeedError(f"malformed: {e}") from None
    kind = {"rss": "rss", "feed": "atom", "rdf": "rdf"}.get(_name(root))
    if kind is None:
        raise FeedError(f"not a feed: {_name(root)}")
    channel = next((e for e in root if _name(e) == "channel"), root)
    holder = root if kind in ("rdf", "atom") else channel
    items = []
    for e in holder:
        if _name(e) not in ("item", "entry") or len(items) >= MAX_ITEMS:
            continue
        row = {
            "title": _first(e, "title"),
            "link": _link(e),
            "description": _first(e, "description", "summary"),
            "content": _first(e, "encoded", "content"),
            "author": _author(e),
            "published": _first(e, "pubdate", "date", "published"),
            "updated": _first(e, "updated", "modified"),
            "guid": _first(e, "guid", "id"),
            "image": _image(e),
            "categories": [c for x in e if _name(x) in ("category", "subject") and (c := x.get("term") or _text(x))][:MAX_CATEGORIES],
        }
        if row["title"] and row["link"]:
            items.append(row)
    return {"format": kind, "title": _first(channel, "title"), "items": items}


_PARSED = f"id long, format string, feed_title string, error string, items array<{ITEM}>"


def _parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([(f, pa.string()) for f in FIELDS] + [("categories", pa.list_(pa.string()))])
    for batch in it:
        cols: list[list] = [[], [], [], []]
        for payload in batch.column("payload").to_pylist():
            try:
                feed = parse_feed(payload)
                row = (feed["format"], feed["title"], None, feed["items"])
            except FeedError as e:
                row = (None, None, str(e), [])
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.list_(item)), strict=True))], names=["id", "format", "feed_title", "error", "items"])


def parse_feeds(payloads: DataFrame) -> DataFrame:
    """(id, format, feed_title, error, items) of (id, payload); one bad payload does not fail the others."""
    return payloads.select("id", "payload").mapInArrow(_parse, _PARSED)


def feed_items(payloads: DataFrame) -> DataFrame:
    """One row per usable item."""
    return parse_feeds(payloads).select("id", "format", F.explode("items").alias("item")).select("id", "format", "item.*")
