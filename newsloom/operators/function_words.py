"""Language of a text by its function words; profiles are a bounded table made by a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.columns import clamp, round4, terms


def profiles(documents: DataFrame, size: int = 30) -> DataFrame:
    """(lang, word, only): the most frequent words of each language of (lang, text); ``only``: of no other one.

    Counts cover all labelled texts; the table has ``size`` rows per language.
    """
    counts = documents.where("lang is not null").select("lang", F.explode(terms(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= size)
    return ranked.select("lang", "word", (F.count(F.lit(1)).over(Window.partitionBy("word")) == 1).alias("only"))


def detect(documents: DataFrame, profile: DataFrame, least_words: int = 8) -> DataFrame:
    """(id, lang, confidence) of (id, text); no row for texts that are too short or show no language.

    Words of one profile alone count three times.
    """
    words = documents.select("id", terms(F.col("text")).alias("w")).where(F.size("w") >= least_words)
    counted = words.select("id", F.size("w").alias("total"), F.explode("w").alias("word")).groupBy("id", "total", "word").agg(F.count(F.lit(1)).alias("n"))
    scores = counted.join(F.broadcast(profile), "word").groupBy("id", "total", "lang").agg((F.sum(F.col("n") * F.when(F.col("only"), 3).otherwise(1)) / F.col("total")).alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "lang")
    first = scores.withColumn("r", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("score").over(order), F.lit(0.0))).where("r = 1")
    confidence = F.least(F.lit(0.99), 0.5 * clamp(F.col("score") / 0.25) + 0.5 * (F.col("score") - F.col("second")) / F.col("score"))
    return first.select("id", "lang", round4(confidence).alias("confidence")).where(F.col("confidence") >= 0.15)
