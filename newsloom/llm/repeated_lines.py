"""Problem 4: lines repeated across one site's documents, by distributed PrefixSpan.

A document is the sequence of its source's frequent lines, numbered.  PrefixSpan
grows sequences one line at a time from projected databases.  A projection is a
pointer (document, sequence, position of its last line), never a copy of the
rest of the document; a sequence grows by any of the next ``max_gap`` frequent
lines after its end, whatever lies between them, and is kept if at least
``least`` different documents of the source hold it.  All levels are plain joins
and aggregations with partial counts, so that a source that holds a third of all
documents is counted in parallel.

Deleted are the occurrences of frequent sequences of every length, single lines
included.  Each line of a frequent sequence is frequent itself, so that longer
sequences delete no further lines, and ``max_length`` bounds how far blocks are
named, not what is deleted; every deleted line comes with the length of the
longest frequent sequence that it stands in.

A key is the letters of a line without markup, lower-cased, one space between
runs.  Defined results: null content and rows without a source or id have no
lines; a line with an empty key is never repeated; repeats within one document
count once for support and are all deleted; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.io import keep


def line_key(line: Column) -> Column:
    """Letters outside markup, lower-cased, runs joined by one space."""
    bare = F.regexp_replace(line, "<[^>]*>", "")
    return F.lower(F.array_join(F.regexp_extract_all(bare, F.lit(r"\p{L}+"), F.lit(0)), " "))


def lines(documents: DataFrame) -> DataFrame:
    """(id, source, line_no, key) of documents (id, source, content); the key is a 64-bit name of the key text."""
    docs = documents.where("id is not null and source is not null and content is not null").select("id", "source", F.split("content", "\n").alias("parts"))
    numbered = docs.select("id", "source", F.posexplode("parts").alias("at", "line")).select("id", "source", (F.col("at") + 1).cast("long").alias("line_no"), line_key(F.col("line")).alias("text"))
    return numbered.where("text <> ''").select("id", "source", "line_no", F.xxhash64("text").alias("key"))


@dataclass(frozen=True)
class SpanParams:
    least: int = 6
    max_length: int = 3
    max_gap: int = 2


def frequent_occurrences(documents: DataFrame, least: int) -> DataFrame:
    """(source, id, line_no, key, at): every occurrence of a frequent line, numbered within its document."""
    parsed = keep(lines(documents), "p4-parsed")
    carried = parsed.select("source", "key", "id").distinct().groupBy("source", "key").agg(F.count(F.lit(1)).alias("support"))
    kept = parsed.join(carried.where(F.col("support") >= least).select("source", "key"), ["source", "key"], "left_semi")
    return kept.withColumn("at", F.row_number().over(Window.partitionBy("source", "id").orderBy("line_no")))


def projections(documents: DataFrame, p: SpanParams = SpanParams()) -> list[tuple[DataFrame, DataFrame]]:
    """Per length, (patterns, occurrences).

    patterns(source, pattern, lines, support): the frequent sequences, named by a
    hash and spelled as line keys; occurrences(source, id, pattern, positions):
    where each one ends in each document, with the numbers of all its lines.
    """
    base = keep(frequent_occurrences(documents, p.least), "p4-lines")
    steps = base.select("source", "id", "at", F.col("key").alias("next"), F.col("line_no").alias("next_line"))
    level = base.select("source", "id", F.col("key").alias("pattern"), F.array("key").alias("lines"), "at", F.array("line_no").alias("positions"))
    out = []
    for length in range(1, p.max_length + 1):
        if length > 1:
            gap = F.sequence(F.lit(1), F.lit(p.max_gap))
            wanted = level.withColumn("step", F.explode(gap)).withColumn("at", F.col("at") + F.col("step")).drop("step")
            grown = wanted.join(steps, ["source", "id", "at"])
            grown = grown.select("source", "id", F.xxhash64("pattern", "next").alias("pattern"), F.concat("lines", F.array("next")).alias("lines"), "at", F.concat("positions", F.array("next_line")).alias("positions"))
            level = keep(grown, "p4-level")
        each = level.groupBy("source", "pattern", "id").agg(F.first("lines").alias("lines"))
        support = each.groupBy("source", "pattern").agg(F.first("lines").alias("lines"), F.count(F.lit(1)).alias("support")).where(F.col("support") >= p.least)
        if length > 1:
            support = keep(support, "p4-patterns")
            level = keep(level.join(support.select("source", "pattern"), ["source", "pattern"], "left_semi"), "p4-projected")
        out.append((support, level))
    return out


def frequent_sequences(documents: DataFrame, p: SpanParams = SpanParams()) -> DataFrame:
    """(source, length, pattern, support): the frequent sequences of lines; ``pattern`` is the list of line keys."""
    tables = [s.select("source", F.size("lines").cast("long").alias("length"), F.col("lines").alias("pattern"), "support") for s, _ in projections(documents, p)]
    return reduce(DataFrame.unionByName, tables)


def repeated_lines(documents: DataFrame, p: SpanParams = SpanParams()) -> DataFrame:
    """(id, line_no, length) of every line in an occurrence of a frequent sequence, with the longest one's length."""
    found = [o.select("id", F.explode("positions").alias("line_no"), F.lit(k).cast("long").alias("length")) for k, (_, o) in enumerate(projections(documents, p), 1)]
    return reduce(DataFrame.unionByName, found).groupBy("id", "line_no").agg(F.max("length").alias("length"))


def without_repeated_lines(documents: DataFrame, p: SpanParams = SpanParams()) -> DataFrame:
    """(id, content, removed): every document without its repeated lines; null content stays null."""
    drop = repeated_lines(documents, p).groupBy("id").agg(F.collect_list((F.col("line_no") - 1).cast("int")).alias("drop"))
    joined = documents.select("id", "content").join(drop, "id", "left")
    rest = F.array_join(F.filter(F.split("content", "\n"), lambda x, i: ~F.array_contains(F.col("drop"), i)), "\n")
    return joined.select("id", F.when(F.col("drop").isNull(), F.col("content")).otherwise(rest).alias("content"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("removed"))
