"""Trend detection: one conditional aggregation over two adjacent windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.columns import clamp, percentage_change, round4
from newsloom.operators.analytics import ago, instant


def observations(articles: DataFrame) -> DataFrame:
    """(subject_type, subject_key, source_name, sentiment, article_id, published_at) of every article.

    Subjects are the category (topic), the first five keywords of three letters
    and more, and the source; all are made in one pass.
    """
    words = F.filter(F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 5), lambda k: F.char_length(k) >= 3)
    subject = lambda kind, key: F.struct(F.lit(kind).alias("t"), key.alias("k"))
    subjects = F.concat(
        F.when(F.col("category").isNotNull(), F.array(subject("topic", F.col("category")))).otherwise(F.array().cast("array<struct<t:string,k:string>>")),
        F.array_distinct(F.transform(words, lambda k: subject("keyword", F.lower(k)))),
        F.array(subject("source", F.lower("source_name"))),
    )
    rows = articles.where(~F.col("is_duplicate")).select("id", "source_name", "sentiment_score", "published_at", F.explode(subjects).alias("s"))
    return rows.select(F.col("s.t").alias("subject_type"), F.col("s.k").alias("subject_key"), "source_name", F.coalesce("sentiment_score", F.lit(0.0)).alias("sentiment"), F.col("id").alias("article_id"), "published_at")


def detect(observed: DataFrame, as_of: str, hours: int, least: int = 3) -> DataFrame:
    """Every subject of the current window with at least ``least`` articles, scored.

    The peak is taken over all current subjects before the filter; subjects of
    the previous window alone are dropped.
    """
    at = F.col("published_at")
    now, before = at >= ago(as_of, hours), at < ago(as_of, hours)
    inside = observed.where((at >= ago(as_of, 2 * hours)) & (at < instant(as_of)))
    counts = inside.groupBy("subject_type", "subject_key").agg(
        F.count_if(now).alias("current_count"),
        F.count_if(before).alias("previous_count"),
        F.count_distinct(F.when(now, F.col("source_name"))).alias("source_count"),
        F.coalesce(F.avg(F.when(now, F.col("sentiment"))), F.lit(0.0)).alias("avg_now"),
        F.coalesce(F.avg(F.when(before, F.col("sentiment"))), F.lit(0.0)).alias("avg_before"),
    ).where("current_count > 0")
    peak = counts.agg(F.max("current_count").alias("peak"))  # one row
    growth = percentage_change(F.col("previous_count"), F.col("current_count"))
    scored = counts.crossJoin(F.broadcast(peak)).where(F.col("current_count") >= least).withColumn("growth", growth.cast("double"))
    c, s, g = F.col("current_count"), F.col("source_count"), F.col("growth")
    score = 0.45 * F.when(g > 0, clamp(g / 300.0)).otherwise(0.0) + 0.30 * clamp(F.log1p(c) / F.log1p(F.greatest(F.col("peak"), F.lit(2)))) + 0.25 * clamp(F.log1p(s) / F.log1p(F.lit(8)))
    confidence = 0.5 * clamp(c / 10.0) + 0.3 * clamp(s / 4.0) + 0.2 * F.when(F.col("previous_count") > 0, 1.0).otherwise(0.4)
    return scored.select(
        "subject_type", "subject_key", "current_count", "previous_count", "source_count",
        (F.floor(g * 100.0 + 0.5 + 1e-9) / 100.0).alias("growth_percent"),
        round4(clamp(score)).alias("trend_score"), round4(clamp(confidence)).alias("confidence"),
        round4(F.col("avg_now")).alias("avg_sentiment"), round4(F.col("avg_now") - F.col("avg_before")).alias("sentiment_delta"),
        direction(F.col("previous_count"), g).alias("direction"),
    )


def direction(previous: Column, growth: Column) -> Column:
    return F.when(previous == 0, "new").when(growth >= 25.0, "rising").when(growth <= -25.0, "falling").otherwise("stable")


def top(trends: DataFrame, n: int = 50) -> DataFrame:
    return trends.orderBy(F.desc("trend_score"), F.desc("current_count"), "subject_type", "subject_key").limit(n)


def breaking(trends: DataFrame) -> DataFrame:
    return trends.where(F.col("direction").isin("rising", "new") & (F.col("growth_percent") >= 150) & (F.col("source_count") >= 3) & (F.col("confidence") >= 0.5))


def history(observed: DataFrame) -> DataFrame:
    """Daily counts of each topic with the change against the last day that had one."""
    day = F.date_trunc("day", "published_at").cast("timestamp_ntz").alias("day")
    counts = observed.where("subject_type = 'topic'").groupBy("subject_key", day).agg(F.count(F.lit(1)).alias("articles"))
    before = F.lag("articles").over(Window.partitionBy("subject_key").orderBy("day"))
    return counts.select("subject_key", "day", "articles", F.coalesce(before, F.lit(0)).alias("before"), (F.col("articles") - F.coalesce(before, F.lit(0))).alias("change"))
