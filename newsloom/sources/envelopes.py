"""JSON envelopes to item rows: configured paths become variant expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where services put their items, and what they call the fields.
ITEM_KEYS = ("items", "articles", "results", "data", "docs", "stories", "entries")
FIELDS = {
    "title": ("title", "headline"),
    "url": ("url", "link", "webUrl"),
    "description": ("description", "summary", "abstract", "excerpt"),
    "content": ("content", "body", "fullText", "articleBody"),
    "author": ("author.name", "author", "byline", "creator"),
    "published_at": ("publishedAt", "published_at", "pubDate", "date", "webPublicationDate"),
    "updated_at": ("updatedAt", "updated_at", "lastModified"),
    "image_url": ("urlToImage", "image.url", "image", "imageUrl", "thumbnail"),
    "external_id": ("id", "uuid", "guid", "articleId"),
    "language": ("language", "lang"),
    "country": ("country", "countryCode"),
    "category": ("category", "section", "sectionName", "topic"),
    "source_name": ("source.name", "source", "publisher"),
}
MAX_ITEMS = 500


@dataclass(frozen=True)
class Mapping:
    """``items_path`` is a dotted path, '' for probing the usual keys; fields are candidate paths."""

    items_path: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = tuple(FIELDS.items())


def _path(dotted: str) -> str:
    """a.0.b -> $.a[0].b"""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split(".") if p)


def _scalar(item: Column, dotted: str) -> Column:
    """Text, number or truth value at a path; objects and lists do not count."""
    kind = F.schema_of_variant(F.try_variant_get(item, _path(dotted), "variant"))
    value = F.try_variant_get(item, _path(dotted), "string")
    return F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.nullif(F.trim(value), F.lit("")))


def items(payloads: DataFrame, mapping: Mapping = Mapping()) -> DataFrame:
    """One row per item with a title and an address, of (id, payload)."""
    parsed = payloads.select("id", F.try_parse_json("payload").alias("v"))
    paths = (mapping.items_path,) if mapping.items_path else (*ITEM_KEYS, "")
    lists = F.coalesce(*(F.try_variant_get("v", _path(p), "array<variant>") for p in paths))
    exploded = parsed.select("id", F.posexplode(F.slice(lists, 1, MAX_ITEMS)).alias("item_no", "item"))
    columns = [F.coalesce(*(_scalar(F.col("item"), p) for p in candidates)).alias(name) for name, candidates in mapping.fields]
    return exploded.select("id", "item_no", *columns).where("title is not null and url is not null")
