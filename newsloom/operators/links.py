"""Joins and merges: graphs, similar articles, upserts, inserts, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.columns import round4


def cooccurrence(links: DataFrame) -> DataFrame:
    """(a, b, shared, weight): keywords of the same article; weight is the share of the strongest link.

    An article has few keywords, so the pairs of one article are bounded; counts
    are combined before the shuffle.
    """
    sets = links.groupBy("article_id").agg(F.array_sort(F.collect_set("keyword")).alias("k"))
    inner = F.flatten(F.transform("k", lambda x, i: F.transform(F.slice("k", i + 2, F.size("k")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = sets.where(F.size("k") > 1).select(F.explode(inner).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("shared"))
    peak = pairs.agg(F.max("shared").alias("peak"))
    return pairs.crossJoin(F.broadcast(peak)).select("a", "b", "shared", round4(F.col("shared") / F.col("peak")).alias("weight"))


def similar_articles(articles: DataFrame, links: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, id, rank): the newest articles that share a keyword with each queried one."""
    asked = links.join(queries.select(F.col("id").alias("article_id")), "article_id", "left_semi").select(F.col("article_id").alias("query_id"), "keyword")
    # Newest first per keyword: only the first top + 1 of a keyword can be among the newest of a query.
    dated = links.join(articles.where(~F.col("is_duplicate")).select(F.col("id").alias("article_id"), "published_at"), "article_id")
    newest = dated.withColumn("r", F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("published_at"), F.desc("article_id")))).where(F.col("r") <= top + 1)
    found = asked.join(newest, "keyword").where("query_id <> article_id").select("query_id", F.col("article_id").alias("id"), "published_at").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("published_at"), F.desc("id")))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("query_id", "id", "rank")


def upsert(target: DataFrame, updates: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
    """The target with updated rows replaced and new ones added; columns in ``keep`` stay the target's."""
    new = updates.select(*(F.col(c).alias(f"_new_{c}") for c in updates.columns))
    joined = target.withColumn("_here", F.lit(True)).join(new, F.col(key) == F.col(f"_new_{key}"), "full")

    def value(c: str) -> Column:
        if f"_new_{c}" not in joined.columns:
            return F.col(c)
        first, second = (F.col(c), F.col(f"_new_{c}")) if c in keep or c == key else (F.col(f"_new_{c}"), F.col(c))
        return F.coalesce(first, second)

    return joined.select(*(value(c).alias(c) for c in target.columns))


def insert_new(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key the target lacks, first of each key by id: insert, ignoring conflicts."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("id"))
    return first.join(target.select(key), key, "left_anti").select("id", key)


def merge_extent(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Full merge that keeps the smallest first and the largest last time."""
    u = updates.select(key, F.col("first_seen").alias("f"), F.col("last_seen").alias("l"))
    return target.join(u, key, "full").select(key, F.least("first_seen", "f").alias("first_seen"), F.greatest("last_seen", "l").alias("last_seen"))


def retained(rows: DataFrame, at: str, cutoff: Column) -> DataFrame:
    """What stays after a retention run; rows without a time stay."""
    return rows.where(F.col(at).isNull() | (F.col(at) >= cutoff))
