"""Corpus similarity as DataFrame plans: fingerprints, SimHash, Jaccard, TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.columns import content_fingerprint, hamming, jaccard, round4, terms, tokens

_HEX = "0123456789abcdef"


def duplicates_by(articles: DataFrame, key: Column) -> DataFrame:
    """(id, original): every row whose key an earlier row (by published_at, id) has."""
    keyed = articles.select("id", "published_at", key.alias("k")).where("k is not null")
    first = keyed.groupBy("k").agg(F.min_by("id", F.struct("published_at", "id")).alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(first, "k").where("id <> original").select("id", "original")


def fingerprint_duplicates(articles: DataFrame) -> DataFrame:
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    return duplicates_by(articles, content_fingerprint(text))


def title_duplicates(articles: DataFrame) -> DataFrame:
    return duplicates_by(articles, content_fingerprint(F.col("title")))


def simhash(documents: DataFrame) -> DataFrame:
    """(id, simhash): 64 bits as hex, from md5 of each token, weighted by its count.

    Each token is hashed once; the 64 bit sums are one aggregation.
    """
    words = documents.select("id", F.explode(tokens(F.col("text"))).alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias("n"))
    hashed = words.select("id", "n", F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long").alias("hi"), F.conv(F.substring(F.md5("w"), 9, 8), 16, 10).cast("long").alias("lo"))
    bit = lambda c, k: F.when(F.shiftright(F.col(c), k).bitwiseAND(F.lit(1)) == 1, F.col("n")).otherwise(-F.col("n"))
    sums = [F.sum(bit(c, k)).alias(f"{c}{k}") for c in ("hi", "lo") for k in range(32)]
    summed = hashed.groupBy("id").agg(*sums)
    word = lambda c: sum((F.when(F.col(f"{c}{k}") > 0, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(32)), F.lit(0).cast("long"))
    return summed.select("id", word("hi").alias("hi"), word("lo").alias("lo")).select("id", F.lower(F.concat(F.lpad(F.hex("hi"), 8, "0"), F.lpad(F.hex("lo"), 8, "0"))).alias("simhash"))


def simhash_pairs(hashes: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b, distance) within the distance: four 16-bit bands meet all pairs up to 3.

    Equal hashes are one class: its first member stands for it, so that copies
    do not make pairs among themselves.
    """
    reps = hashes.groupBy("simhash").agg(F.min("id").alias("id"))
    long = F.conv(F.substring("simhash", 1, 8), 16, 10).cast("long"), F.conv(F.substring("simhash", 9, 8), 16, 10).cast("long")
    bands = reps.select("id", long[0].alias("hi"), long[1].alias("lo"), F.posexplode(F.array(*(F.substring("simhash", 1 + 4 * k, 4) for k in range(4)))).alias("band", "part"))
    x, y = bands.alias("x"), bands.alias("y")
    met = x.join(y, F.expr("x.band = y.band and x.part = y.part and x.id < y.id"))
    d = hamming(F.col("x.hi"), F.col("y.hi")) + hamming(F.col("x.lo"), F.col("y.lo"))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), d.alias("distance")).where(F.col("distance") <= distance).distinct()


def simhash_classes(hashes: DataFrame) -> DataFrame:
    """(id, rep): every row, and the smallest id with the same hash, as `simhash_pairs` has it."""
    return hashes.join(hashes.groupBy("simhash").agg(F.min("id").alias("rep")), "simhash").select("id", "rep")


def _title_sets(titles: DataFrame) -> DataFrame:
    return titles.select("id", F.array_sort(F.array_distinct(tokens(F.col("title")))).alias("t")).where(F.size("t") > 0)


def title_classes(titles: DataFrame) -> DataFrame:
    """(id, rep): every title with tokens, and the smallest id with the same token set, as `title_jaccard_pairs` has it."""
    sets = _title_sets(titles)
    return sets.join(sets.groupBy("t").agg(F.min("id").alias("rep")), "t").select("id", "rep")


def title_jaccard_pairs(titles: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, similarity) of titles whose token sets reach the threshold, by prefix filter.

    Tokens are ordered by how many titles hold them; two similar titles share
    one of their first ``n - ceil(t n) + 1``.  Titles with equal token sets are
    one class, represented by its smallest id.
    """
    sets = _title_sets(titles)
    reps = sets.groupBy("t").agg(F.min("id").alias("id"))
    each = reps.select("id", F.explode("t").alias("w"))
    df = each.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(df, "w").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x["w"]).alias("t"))
    n = F.size("t")
    prefix = ordered.select("id", "t", F.explode(F.slice("t", F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))).alias("w"))
    x, y = prefix.alias("x"), prefix.alias("y")
    sizes = (F.size("x.t") >= F.size("y.t") * threshold - 1e-9) & (F.size("y.t") >= F.size("x.t") * threshold - 1e-9)
    met = x.join(y, F.expr("x.w = y.w and x.id < y.id")).where(sizes)
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), round4(jaccard(F.col("x.t"), F.col("y.t"))).alias("similarity")).where(F.col("similarity") >= threshold).distinct()


def class_links(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, rep, links): every row's class, and how many other rows it is linked with, those of its own class included.

    ``classes`` (id, rep); ``pairs`` (a, b) between representatives.
    """
    sizes = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("m"))
    ways = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    far = ways.join(sizes.select(F.col("rep").alias("other"), "m"), "other").groupBy("rep").agg(F.sum("m").alias("far"))
    counted = sizes.join(far, "rep", "left").select("rep", (F.col("m") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    return classes.join(counted, "rep").select("id", "rep", "links")


def term_counts(documents: DataFrame, stopwords: tuple[str, ...] = ()) -> DataFrame:
    return documents.select("id", F.explode(terms(F.col("text"), stopwords)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


def tfidf(documents: DataFrame, vocabulary: int = 4000, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, weight): (1 + ln n) (ln((1 + N) / (1 + df)) + 1) over the most frequent terms.

    The vocabulary limit is the feature: it bounds the table that is joined.
    """
    counts = term_counts(documents, stopwords)
    docs = counts.agg(F.count_distinct("id").alias("docs"))
    chosen = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(vocabulary)
    idf = chosen.crossJoin(F.broadcast(docs)).select("term", (F.log((1.0 + F.col("docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    return counts.join(idf, "term").select("id", "term", ((1.0 + F.log("n")) * F.col("idf")).alias("weight"))


def centroids(vectors: DataFrame, groups: DataFrame, top: int = 10) -> DataFrame:
    """(group, term, weight): the heaviest terms of each group's mean vector."""
    members = groups.groupBy("grp").agg(F.count_distinct("id").alias("members"))
    sums = vectors.join(groups, "id").groupBy("grp", "term").agg(F.sum("weight").alias("total"))
    ranked = sums.join(members, "grp").withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.round("total", 6)), "term"))).where(F.col("r") <= top)
    return ranked.select("grp", "term", round4(F.col("total") / F.col("members")).alias("weight"))


def top_terms(documents: DataFrame, n: int = 50) -> DataFrame:
    """The most frequent terms over all documents."""
    counts = term_counts(documents).groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))
    return counts.orderBy(F.desc("n"), "term").limit(n)
