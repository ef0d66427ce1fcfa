"""Greedy four-level deduplication at scale.

A row is a duplicate if an *earlier kept* row has the same address (level 1), the
same content hash (2), a SimHash within three bits (3), or a similar title and
text (4).  A duplicate is never compared against.  The sequential rule is solved
in rounds over all rows at once: an undecided row is kept if no earlier row
that is kept or undecided matches it, and a duplicate if a kept one does.

Equality levels need no pairs: the smallest order number per key decides.  The
other levels are built by bands and prefixes, as links between *classes* of rows
that match the same rows at that level: equal SimHashes, and equal titles with
equal texts.  A class is a key as well; what it links to is again decided by the
smallest order number there, so copies are never spelled out in pairs.  Every
round is written to the shared folder, so the plan stays short and survives lost
executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.columns import tokens
from newsloom.io import keep
from newsloom.operators import similarity as sim

KEYS = {"canonical_url": 1, "content_hash": 2}


#: Texts of one title class are paired in blocks of two parts of about so many.
PART = 256


def title_and_text_links(articles: DataFrame, title_threshold: float = 0.85, text_threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, links): members(id, copy) of rows with terms; links(x, y, score), x < y, between different copies.

    Linked are similar titles, equal ones among them, whose texts are similar as
    well, by TF-IDF cosine with the term weights of all rows.
    """
    body = F.substring(F.coalesce("content", "description"), 1, 4000)
    texts = articles.select("id", F.concat_ws("\n", "title", body).alias("text"))
    weights = keep(sim.tfidf(texts), "dedup-weights")
    copied = articles.where("title is not null").select("id", F.md5(F.concat("title", F.lit("\0"), F.coalesce(body, F.lit("")))).alias("copy"))
    members = keep(copied.join(weights.select("id").distinct(), "id"), "dedup-copies")
    shown = members.groupBy("copy").agg(F.min("id").alias("id"))
    titles = articles.select("id", "title").join(shown, "id", "left_semi")
    # Titles without a word are equal as the title hash has it: one class.
    wordless = titles.where(F.size(tokens(F.col("title"))) == 0)
    classes = sim.title_classes(titles).unionByName(wordless.crossJoin(wordless.agg(F.min("id").alias("rep"))).select("id", "rep"))
    classes = keep(classes, "dedup-titles")
    sizes = classes.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"), F.count(F.lit(1)).alias("m"))
    across = sim.title_jaccard_pairs(titles, title_threshold).select(F.col("a").alias("ra"), F.col("b").alias("rb"), "similarity")
    within = sizes.where("m > 1").select(F.col("rep").alias("ra"), F.col("rep").alias("rb"), F.lit(1.0).alias("similarity"))
    size = lambda n: sizes.select(F.col("rep").alias(f"r{n}"), F.col("parts").alias(f"parts{n}"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(f"parts{n}") - 1)).alias(f"part{n}")
    blocks = across.unionByName(within).join(size("a"), "ra").join(size("b"), "rb").select("ra", "rb", "similarity", "partsb", numbers("a")).select("ra", "rb", "similarity", "parta", numbers("b"))
    placed = classes.join(sizes, "rep").select("id", "rep", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    put = lambda n: placed.select(F.col("id").alias(n), F.col("rep").alias(f"r{n}"), F.col("part").alias(f"part{n}"))
    pairs = blocks.join(put("a"), ["ra", "parta"]).join(put("b"), ["rb", "partb"]).where("ra <> rb or a < b").select("a", "b", "similarity")
    norms = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    side = lambda n: weights.select(F.col("id").alias(n), "term", F.col("weight").alias(f"w{n}"))
    norm = lambda n: norms.select(F.col("id").alias(n), F.col("norm").alias(f"n{n}"))
    dots = pairs.join(side("a"), "a").join(side("b"), ["b", "term"]).groupBy("a", "b", "similarity").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    cosine = F.col("dot") / (F.col("na") * F.col("nb"))
    accepted = dots.join(norm("a"), "a").join(norm("b"), "b").withColumn("cosine", cosine).where((F.col("cosine") >= text_threshold) | (F.col("similarity") >= 0.95) & (F.col("cosine") >= 0.55))
    copy = lambda n: shown.select(F.col("id").alias(n), F.col("copy").alias(f"c{n}"))
    named = accepted.join(copy("a"), "a").join(copy("b"), "b")
    return members, named.select(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"), (0.5 * F.col("similarity") + 0.5 * F.col("cosine")).alias("score"))


def simhash_links(hashes: DataFrame) -> DataFrame:
    """(x, y, score) between different SimHashes within three bits."""
    of = lambda n, c: hashes.select(F.col("id").alias(n), F.col("simhash").alias(c))
    return sim.simhash_pairs(hashes).join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y", (1.0 - F.col("distance") / 64.0).alias("score"))


def resolve(rows: DataFrame, keys: dict[str, int], pairs: DataFrame, links: dict[str, DataFrame] | None = None) -> DataFrame:
    """(id, duplicate_of, level) of every row; null where it is kept.

    ``rows`` (id, ord, key columns), ``ord`` unique; ``pairs`` (later, earlier,
    level, score) by id, with earlier of smaller ``ord``; ``links``: for a key,
    (x, y, score) between different values of it, in either order, at its level.
    """
    ways = {k: keep(e.select("x", "y", "score").unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"), "score")), "dedup-links") for k, e in (links or {}).items()}
    state = keep(rows.select("id", "ord", *keys, F.lit("open").alias("state")), "dedup-state")
    while True:
        live = state.where("state <> 'duplicate'")

        def first(key: str, name: str) -> DataFrame:
            return live.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(name)).agg(F.min("ord").alias(f"live_{key}"), F.min(F.when(F.col("state") == "kept", F.col("ord"))).alias(f"kept_{key}"))

        marked = state
        blocked, hit = F.lit(False), F.lit(False)
        for k in keys:
            marked = marked.join(first(k, k), k, "left")
            blocked = blocked | F.coalesce(F.col(f"live_{k}") < F.col("ord"), F.lit(False))
            hit = hit | F.coalesce(F.col(f"kept_{k}") < F.col("ord"), F.lit(False))
        for k, way in ways.items():
            # Of all rows a class links to, the first one decides.
            reached = way.join(first(k, "y"), "y").groupBy(F.col("x").alias(k)).agg(F.min(f"live_{k}").alias(f"far_live_{k}"), F.min(f"kept_{k}").alias(f"far_kept_{k}"))
            marked = marked.join(reached, k, "left")
            blocked = blocked | F.coalesce(F.col(f"far_live_{k}") < F.col("ord"), F.lit(False))
            hit = hit | F.coalesce(F.col(f"far_kept_{k}") < F.col("ord"), F.lit(False))
        near = pairs.join(live.select(F.col("id").alias("earlier"), (F.col("state") == "kept").alias("is_kept")), "earlier").groupBy(F.col("later").alias("id")).agg(F.lit(True).alias("near"), F.max("is_kept").alias("near_kept"))
        marked = marked.join(near, "id", "left")
        blocked = blocked | F.coalesce("near", F.lit(False))
        hit = hit | F.coalesce("near_kept", F.lit(False))
        new = F.when(F.col("state") != "open", F.col("state")).when(hit, "duplicate").when(~blocked, "kept").otherwise("open")
        state = keep(marked.select("id", "ord", *keys, new.alias("state")), "dedup-state")
        if state.where("state = 'open'").isEmpty():
            break
    kept = state.where("state = 'kept'")
    gone = state.where("state = 'duplicate'")
    hits = [
        gone.join(kept.groupBy(k).agg(F.min_by("id", "ord").alias("of"), F.min("ord").alias("of_ord")), k).where("of_ord < ord").select("id", "of", F.lit(level).alias("level"), F.lit(1.0).alias("score"), "of_ord")
        for k, level in keys.items()
    ]
    chosen = pairs.join(kept.select(F.col("id").alias("earlier"), F.col("ord").alias("of_ord")), "earlier").join(gone.select(F.col("id").alias("later")), "later")
    hits.append(chosen.select(F.col("later").alias("id"), F.col("earlier").alias("of"), "level", "score", "of_ord"))
    for k, way in ways.items():
        # The first kept row of each linked class; a later one is worth it only with a higher score.
        ends = kept.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("y")).agg(F.min_by("id", "ord").alias("of"), F.min("ord").alias("of_ord"))
        met = way.join(ends, "y").groupBy("x", "score").agg(F.min_by("of", "of_ord").alias("of"), F.min("of_ord").alias("of_ord"))
        before = Window.partitionBy("x").orderBy("of_ord").rowsBetween(Window.unboundedPreceding, -1)
        steps = met.withColumn("so_far", F.max("score").over(before)).where("so_far is null or score > so_far")
        hits.append(gone.join(steps.withColumnRenamed("x", k), k).where("of_ord < ord").select("id", "of", F.lit(keys[k]).alias("level"), "score", "of_ord"))
    best = reduce(DataFrame.unionByName, hits).groupBy("id").agg(F.min_by(F.struct("of", "level"), F.struct("level", -F.col("score"), "of_ord")).alias("m"))
    return state.select("id").join(best, "id", "left").select("id", F.col("m.of").alias("duplicate_of"), F.col("m.level").alias("level"))


def deduplicate(articles: DataFrame, newest_first: bool = False) -> DataFrame:
    """(id, duplicate_of, level) by all four levels; the oldest wins unless ``newest_first``."""
    at = F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(0))
    order = F.struct((-at if newest_first else at).alias("t"), "id")
    rows = articles.select("id", "canonical_url", "content_hash", order.alias("ord"))
    hashes = keep(sim.simhash(articles.select("id", F.concat_ws(" ", "title", F.coalesce("content", "description")).alias("text"))), "dedup-simhash")
    members, alike = title_and_text_links(articles)
    keyed = rows.join(hashes, "id", "left").join(members, "id", "left")
    none = rows.limit(0).select(F.col("id").alias("later"), F.col("id").alias("earlier"), F.lit(0).alias("level"), F.lit(0.0).alias("score"))
    return resolve(keyed, KEYS | {"simhash": 3, "copy": 4}, none, {"simhash": simhash_links(hashes), "copy": alike})
