"""Relational aggregates over articles, sources and fetch health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.columns import clamp, round4

LABEL_WEIGHTS = {"very_negative": -1.0, "negative": -0.5, "neutral": 0.0, "positive": 0.5, "very_positive": 1.0}


def instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def ago(as_of: str, hours: int) -> Column:
    return instant(as_of) - F.make_dt_interval(hours=F.lit(hours))


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def article_stats(articles: DataFrame, as_of: str) -> DataFrame:
    """One row, one pass; duplicates included."""
    at = F.col("published_at")
    return articles.agg(
        F.count(F.lit(1)).alias("total"),
        _count(at >= F.date_trunc("day", instant(as_of)).cast("timestamp_ntz")).alias("today"),
        _count(at >= ago(as_of, 24)).alias("last_24h"),
        _count(at >= ago(as_of, 168)).alias("last_7d"),
        _count(F.col("is_duplicate")).alias("duplicates"),
        _count(F.col("status") == "pending").alias("pending"),
        _count(F.col("status") == "failed").alias("failed"),
        round4(F.coalesce(F.avg("relevance_score"), F.lit(0.0))).alias("avg_relevance"),
        round4(F.coalesce(F.avg("sentiment_score"), F.lit(0.0))).alias("avg_sentiment"),
    )


def sentiment_breakdown(articles: DataFrame, as_of: str, hours: int) -> DataFrame:
    """(label counts, weighted_average) of the last hours without duplicates."""
    recent = articles.where(~F.col("is_duplicate") & (F.col("published_at") >= ago(as_of, hours)) & F.col("sentiment_label").isNotNull())
    weight = F.coalesce(*(F.when(F.col("sentiment_label") == k, v) for k, v in LABEL_WEIGHTS.items()), F.lit(0.0))
    counts = [_count(F.col("sentiment_label") == k).alias(k) for k in LABEL_WEIGHTS]
    return recent.agg(F.count(F.lit(1)).alias("total"), *counts, round4(F.coalesce(F.sum(weight) / F.count(F.lit(1)), F.lit(0.0))).alias("weighted_average"))


def category_breakdown(articles: DataFrame, top: int) -> DataFrame:
    """The largest categories, with their percentage of the rows returned."""
    counts = articles.where(~F.col("is_duplicate") & F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("articles"))
    kept = counts.orderBy(F.desc("articles"), "category").limit(top)
    share = 100.0 * F.col("articles") / F.sum("articles").over(Window.partitionBy(F.lit(1)))
    return kept.select("category", "articles", (F.floor(share * 100.0 + 0.5 + 1e-9) / 100.0).alias("percentage"))


def hourly_volume(articles: DataFrame) -> DataFrame:
    hour = F.date_trunc("hour", "published_at").cast("timestamp_ntz").alias("hour")
    return articles.where(~F.col("is_duplicate")).groupBy(hour).agg(F.count(F.lit(1)).alias("articles"), round4(F.coalesce(F.avg("sentiment_score"), F.lit(0.0))).alias("avg_sentiment"))


def source_totals(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source_id").agg(F.count(F.lit(1)).alias("articles"))


def success_rates(health: DataFrame, as_of: str, hours: int) -> DataFrame:
    recent = health.where(F.col("checked_at").between(ago(as_of, hours), instant(as_of)))
    return recent.groupBy("source_id").agg(F.count(F.lit(1)).alias("checks"), round4(F.avg(F.col("success").cast("int"))).alias("success_rate"))


def reliability(sources: DataFrame, health: DataFrame) -> DataFrame:
    """0.55 success rate + 0.35 valid share + 0.10 (1 - duplicate share); 0.5 without samples."""
    sums = health.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("success").cast("int")).alias("ok"), F.sum("articles_fetched").alias("fetched"), F.sum("articles_valid").alias("valid"), F.sum("duplicates").alias("dup")
    )
    fetched = F.col("fetched") > 0
    score = 0.55 * F.col("ok") / F.col("n") + 0.35 * F.when(fetched, F.col("valid") / F.col("fetched")).otherwise(0.5) + 0.10 * (1.0 - F.when(fetched, F.col("dup") / F.col("fetched")).otherwise(0.0))
    joined = sources.select(F.col("id").alias("source_id"), "slug").join(sums, "source_id", "left")
    return joined.select("source_id", "slug", F.when(F.col("n").isNull(), 0.5).otherwise(round4(clamp(score))).alias("reliability"))


def source_table(sources: DataFrame, articles: DataFrame, health: DataFrame, as_of: str) -> DataFrame:
    """Every source with its totals, its last day and its success and duplicate rates."""
    counts = articles.groupBy("source_id").agg(F.count(F.lit(1)).alias("articles"), _count(F.col("published_at") >= ago(as_of, 24)).alias("articles_24h"))
    rates = health.groupBy("source_id").agg(F.avg(F.col("success").cast("int")).alias("ok"), F.try_divide(F.sum("duplicates"), F.sum("articles_fetched")).alias("dup"))
    joined = sources.select(F.col("id").alias("source_id"), "slug", "status").join(counts, "source_id", "left").join(rates, "source_id", "left")
    return joined.select(
        "source_id", "slug", "status", F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("articles_24h", F.lit(0)).alias("articles_24h"), round4(F.coalesce("ok", F.lit(0.0))).alias("success_rate"), round4(F.coalesce("dup", F.lit(0.0))).alias("duplicate_rate")
    )


def failure_streaks(health: DataFrame, pause_after: int = 10) -> DataFrame:
    """(source_id, checks, streak, state): failures since the last success, by gaps and islands."""
    order = Window.partitionBy("source_id").orderBy("checked_at", "success", F.coalesce("status_code", F.lit(-1)), F.coalesce("latency_ms", F.lit(-1.0)))
    island = F.sum(F.col("success").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = health.withColumn("island", island).groupBy("source_id", "island").agg(F.count_if(~F.col("success")).alias("failures"), F.count(F.lit(1)).alias("n"))
    last = runs.groupBy("source_id").agg(F.max_by("failures", "island").alias("streak"), F.max("failures").alias("longest"), F.sum("n").alias("checks"))
    state = F.when(F.col("streak") >= pause_after, "paused").when(F.col("streak") > 0, "failing").otherwise("active")
    return last.select("source_id", "checks", F.col("streak").cast("long").alias("streak"), F.col("longest").cast("long").alias("longest"), state.alias("state"))


def rate_windows(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Fixed windows (now - now % width) of a user: hits, and how many exceed the limit."""
    start = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("long")
    hits = events.groupBy("user_id", start.alias("window_start")).agg(F.count(F.lit(1)).alias("hits"))
    return hits.withColumn("rejected", F.greatest(F.lit(0), F.col("hits") - limit).cast("long"))
