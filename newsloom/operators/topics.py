"""Topics by weighted terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.columns import round4


def topic_scores(articles: DataFrame, definitions: dict[str, dict[str, float]], least: float = 0.12, limit: int = 3) -> DataFrame:
    """(id, topic, score, rank) of (id, title, content): weighted whole-word term counts, divided by the best.

    ``definitions`` (topic -> term -> weight) is a small parameter; every term is
    counted by a built-in expression in one pass over the text.
    """
    norm = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", "  "), F.lit(" "))
    rows = articles.select("id", norm(F.col("title")).alias("t"), norm(F.col("content")).alias("b"))

    def score(terms: dict[str, float]):
        total = F.lit(0.0)
        for term, weight in sorted(terms.items()):
            needle = " " + "  ".join(term.lower().split()) + " "
            hits = lambda c, needle=needle: ((F.length(c) - F.length(F.replace(F.col(c), F.lit(needle), F.lit("")))) / len(needle)).cast("int")
            total = total + weight * (3.0 * F.least(hits("t"), F.lit(2)) + F.pow(F.least(hits("b"), F.lit(5)), 0.7))
        return total

    each = rows.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("topic"), score(v).alias("raw")) for k, v in definitions.items()))).alias("s")).select("id", "s.topic", "s.raw").where("raw > 0")
    best = F.max("raw").over(Window.partitionBy("id"))
    scored = each.withColumn("score", round4(F.col("raw") / best)).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "topic"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit).select("id", "topic", "score", "rank")
