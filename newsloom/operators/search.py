"""Article search: predicates, ordering and pages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.columns import like_pattern

SORT_FIELDS = ("published_at", "relevance_score", "sentiment_score", "quality_score", "word_count", "title")
LIST_COLUMNS = ("id", "source_id", "source_name", "title", "description", "canonical_url", "published_at", "language", "country", "category", "sentiment_label", "relevance_score")


@dataclass(frozen=True)
class SearchQuery:
    """All conditions must hold; an unset one holds always."""

    q: str | None = None
    phrase: str | None = None
    source_id: int | None = None
    category: str | None = None
    language: str | None = None
    country: str | None = None
    sentiment_label: str | None = None
    min_sentiment: float | None = None
    max_sentiment: float | None = None
    min_relevance: float | None = None
    published_after: str | None = None
    published_before: str | None = None
    include_duplicates: bool = False
    sort: str = "published_at"
    descending: bool = True
    limit: int = 20
    offset: int = 0


def _ilike(column: str, text: str) -> Column:
    return F.expr(f"{column} ILIKE '{like_pattern(text).replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}' ESCAPE '{chr(92) * 2}'")


def predicates(s: SearchQuery) -> list[Column]:
    out: list[Column] = []
    if not s.include_duplicates:
        out.append(~F.col("is_duplicate"))
    if s.q:
        out.append(_ilike("title", s.q) | _ilike("description", s.q) | _ilike("content", s.q))
    if s.phrase:
        out.append(_ilike("title", s.phrase) | _ilike("content", s.phrase))
    for name, value in (("source_id", s.source_id), ("category", s.category and s.category.lower()), ("language", s.language and s.language.lower()), ("country", s.country and s.country.upper()), ("sentiment_label", s.sentiment_label)):
        if value is not None:
            out.append(F.col(name) == value)
    for name, low, high in (("sentiment_score", s.min_sentiment, s.max_sentiment), ("relevance_score", s.min_relevance, None)):
        if low is not None:
            out.append(F.col(name) >= low)
        if high is not None:
            out.append(F.col(name) <= high)
    if s.published_after:
        out.append(F.col("published_at") >= F.lit(s.published_after).cast("timestamp_ntz"))
    if s.published_before:
        out.append(F.col("published_at") <= F.lit(s.published_before).cast("timestamp_ntz"))
    return out


def matching(articles: DataFrame, s: SearchQuery) -> DataFrame:
    found = predicates(s)
    return articles.where(reduce(Column.__and__, found)) if found else articles


def page(articles: DataFrame, s: SearchQuery) -> DataFrame:
    """One page in a total order; the limit is the feature, between 1 and 200."""
    if s.sort not in SORT_FIELDS:
        raise ValueError(f"unknown sort field {s.sort}")
    key = F.col(s.sort)
    order = (key.desc_nulls_last() if s.descending else key.asc_nulls_last(), F.col("id").desc())
    return matching(articles, s).orderBy(*order).offset(max(0, s.offset)).limit(min(200, max(1, s.limit)))


def envelope(articles: DataFrame, s: SearchQuery, number: int, size: int) -> DataFrame:
    """(page, page_size, total, pages, has_next, has_previous)."""
    total = matching(articles, s).agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / size).cast("long")
    return total.select(F.lit(number).cast("long").alias("page"), F.lit(size).cast("long").alias("page_size"), "total", pages.alias("pages"), (pages > number).alias("has_next"), F.lit(number > 1).alias("has_previous"))


def of_source(articles: DataFrame, sources: DataFrame, slug: str) -> DataFrame:
    chosen = sources.where(F.col("slug") == slug.lower()).select(F.col("id").alias("source_id"))
    return articles.join(chosen, "source_id", "left_semi")


def keyword_links(articles: DataFrame) -> DataFrame:
    """(article_id, keyword): one row per distinct keyword of an article."""
    return articles.select(F.col("id").alias("article_id"), F.explode(F.array_distinct("keywords")).alias("keyword"))


def with_keyword(articles: DataFrame, keyword: str) -> DataFrame:
    links = keyword_links(articles).where(F.col("keyword") == keyword.lower()).select(F.col("article_id").alias("id"))
    return articles.join(links, "id", "left_semi")


def with_keyword_like(articles: DataFrame, text: str) -> DataFrame:
    links = keyword_links(articles).where(_ilike("keyword", text)).select(F.col("article_id").alias("id"))
    return articles.join(links, "id", "left_semi")
