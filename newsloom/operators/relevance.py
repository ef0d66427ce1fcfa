"""Relevance scores, the personal feed, alert rules and record quality."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.columns import clamp, round4, url_domain, word_count
from newsloom.operators.analytics import ago, instant

# Weights of the signals, and the half life of recency in hours.
WEIGHTS = {"source": 0.20, "recency": 0.25, "topic": 0.18, "keyword": 0.12, "entity": 0.08, "quality": 0.10, "corroboration": 0.05, "engagement": 0.02}
HALF_LIFE_HOURS = 18.0
# What spam looks like.
SPAM = (
    r"(?i)\b(click here|buy now|limited time offer|100% free|earn \$\d+)\b",
    r"(?i)\b(viagra|casino|porn|xxx|escort)\b",
    r"(?i)(https?://\S+){6,}",
)
MIN_TITLE, MIN_WORDS, MAX_UPPER = 8, 15, 0.7


@dataclass(frozen=True)
class Profile:
    topics: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    preferred_sources: tuple[str, ...] = ()
    excluded_sources: tuple[str, ...] = ()
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))


def recency(published_at: Column, as_of: str, half_life: float = HALF_LIFE_HOURS) -> Column:
    """0.5 ** (age / half life); 0 without a date, 1 for future ones."""
    seconds = F.unix_micros(instant(as_of).cast("timestamp")) - F.unix_micros(published_at.cast("timestamp"))
    hours = F.greatest(F.lit(0.0), seconds / 3_600_000_000.0)
    return F.coalesce(F.pow(F.lit(0.5), hours / max(0.5, half_life)), F.lit(0.0))


def overlap(wanted: tuple[str, ...], candidates: Column) -> Column:
    """Share of the wanted terms that stand in some candidate; 0.5 if nothing is wanted."""
    if not wanted:
        return F.lit(0.5)
    found = F.coalesce(candidates, F.array().cast("array<string>"))

    def hit(term: str) -> Column:
        return F.when(F.exists(found, lambda c: F.lower(c).contains(term.lower())), 1.0).otherwise(0.0)

    return sum(map(hit, wanted), F.lit(0.0)) / float(len(wanted))


def scored(articles: DataFrame, sources: DataFrame, as_of: str, profile: Profile = Profile()) -> DataFrame:
    """Articles with source columns and a ``score``; an excluded source gives 0."""
    dims = sources.select(F.col("id").alias("source_id"), "slug", "weight", "reliability_score")
    joined = articles.join(dims, "source_id", "left")
    source = clamp(0.5 * clamp(F.coalesce("weight", F.lit(1.0)) / 2.0) + 0.5 * clamp(F.coalesce("reliability_score", F.lit(0.5))))
    if profile.preferred_sources:
        source = F.when(F.coalesce(F.col("slug").isin(*profile.preferred_sources), F.lit(False)), clamp(source + 0.3)).otherwise(source)
    parts = {
        "source": source,
        "recency": recency(F.col("published_at"), as_of),
        "topic": overlap(profile.topics, F.when(F.col("category").isNotNull(), F.array("category"))),
        "keyword": overlap(profile.keywords, F.col("keywords")),
        "entity": F.lit(0.5),
        "quality": clamp(F.coalesce("quality_score", F.lit(0.5))),
        "corroboration": F.lit(0.25),  # log2(1 + 1) / 4: one source
        "engagement": F.lit(0.5),
    }
    total = sum(profile.weights.values())
    score = round4(clamp(sum((parts[k] * w for k, w in profile.weights.items()), F.lit(0.0)) / total))
    if profile.excluded_sources:
        score = F.when(F.coalesce(F.col("slug").isin(*profile.excluded_sources), F.lit(False)), 0.0).otherwise(score)
    return joined.withColumn("score", score)


def feed(articles: DataFrame, sources: DataFrame, as_of: str, profile: Profile, limit: int = 20, offset: int = 0) -> DataFrame:
    """The best articles for a reader; without preferences the newest ones."""
    found = scored(articles.where(~F.col("is_duplicate")), sources, as_of, profile).where("score > 0")
    empty = not (profile.topics or profile.keywords or profile.preferred_sources)
    order = [F.desc("published_at"), F.desc("id")] if empty else [F.desc("score"), F.desc("published_at"), F.desc("id")]
    return found.orderBy(*order).offset(offset).limit(limit)


def alert_matches(articles: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """(alert_id, matches, newest) of the rules that enough articles meet.

    ``rules`` (alert_id, keywords, topics, sentiment, min_relevance,
    window_minutes, min_articles) are few and are checked against all articles
    of the longest window in one pass; an empty list asks nothing.
    """
    haystack = F.lower(F.concat_ws(" ", "title", "description", F.concat_ws(" ", "keywords")))
    recent = articles.where(~F.col("is_duplicate") & (F.col("published_at") < instant(as_of))).select("id", "published_at", "category", "sentiment_score", "relevance_score", haystack.alias("haystack"))
    age = (F.unix_micros(instant(as_of).cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp"))) / 60_000_000
    sentiment = F.when(F.col("sentiment_score") > 0.1, "positive").when(F.col("sentiment_score") < -0.1, "negative").otherwise("neutral")
    meets = (
        (age <= F.col("window_minutes"))
        & (F.coalesce("relevance_score", F.lit(0.0)) >= F.col("min_relevance"))
        & ((F.size("keywords") == 0) | F.exists("keywords", lambda k: F.col("haystack").contains(F.lower(k))))
        & ((F.size("topics") == 0) | F.array_contains("topics", F.coalesce("category", F.lit(""))))
        & (F.col("sentiment").isNull() | (F.col("sentiment") == sentiment))
    )
    hits = recent.join(F.broadcast(rules), meets).groupBy("alert_id", "min_articles").agg(F.count(F.lit(1)).alias("matches"), F.max("published_at").alias("newest"))
    return hits.where(F.col("matches") >= F.col("min_articles")).select("alert_id", "matches", "newest")


def cooled_down(alerts: DataFrame, as_of: str) -> DataFrame:
    """Alerts that may fire again: never fired, or their cooldown is over."""
    over = F.col("last_triggered_at") + F.make_dt_interval(mins=F.col("cooldown_minutes")) <= instant(as_of)
    return alerts.where(F.col("last_triggered_at").isNull() | over)


def with_quality(items: DataFrame) -> DataFrame:
    """Raw items with ``issues``, ``quality`` and ``is_valid``; all checks are expressions."""
    title = F.trim(F.coalesce("title", F.lit("")))
    letters = F.regexp_count(title, F.lit(r"\p{L}"))
    upper = F.regexp_count(title, F.lit(r"\p{Lu}"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    body = word_count(F.when(~blank("content"), F.col("content")).otherwise(F.coalesce("description", F.lit(""))))
    text = F.concat_ws("\n", title, F.coalesce("description", F.lit("")), F.substring(F.coalesce("content", F.lit("")), 1, 2000))
    spam = F.lit(False)
    for pattern in SPAM:
        spam = spam | text.rlike(pattern)
    checks = (
        ("missing_title", title == "", 0.5, True),
        ("title_too_short", (title != "") & (F.char_length(title) < MIN_TITLE), 0.3, True),
        ("shouting_title", (F.char_length(title) >= MIN_TITLE) & (letters > 0) & (upper > letters * MAX_UPPER), 0.05, False),
        ("invalid_url", F.coalesce(url_domain(F.trim("url")), F.lit("")) == "", 0.5, True),
        ("missing_date", blank("published_at"), 0.3, True),
        ("empty_content", blank("content") & blank("description"), 0.15, False),
        ("thin_content", ~(blank("content") & blank("description")) & (body < MIN_WORDS), 0.1, False),
        ("missing_description", blank("description"), 0.05, False),
        ("missing_author", blank("author"), 0.05, False),
        ("missing_image", blank("image_url"), 0.02, False),
        ("spam_like", spam, 0.6, True),
    )
    # The checks are made once, as one column; codes and losses are read off it.
    flagged = items.withColumn("_flags", F.array(*(F.coalesce(cond, F.lit(False)) for _, cond, _, _ in checks)))
    codes = F.transform(F.array(*(F.lit(code) for code, _, _, _ in checks)), lambda code, i: F.when(F.get("_flags", i), code))
    losses = F.transform(F.array(*(F.lit(cost) for _, _, cost, _ in checks)), lambda cost, i: F.when(F.get("_flags", i), cost).otherwise(0.0))
    loss = F.aggregate(losses, F.lit(0.0), lambda acc, x: acc + x)
    fatal = [k for k, (_, _, _, f) in enumerate(checks) if f]
    valid = ~F.exists(F.array(*map(F.lit, fatal)), lambda k: F.get("_flags", k))
    return flagged.select(*items.columns, F.filter(codes, lambda x: x.isNotNull()).alias("issues"), round4(clamp(1.0 - loss)).alias("quality"), valid.alias("is_valid"))


def quality_report(items: DataFrame) -> DataFrame:
    """(issue, items): how many items have each issue."""
    return with_quality(items).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("items"))


def first_of_day(articles: DataFrame) -> DataFrame:
    """The first article of each source and day (first-wins per key)."""
    day = F.date_trunc("day", "published_at").cast("timestamp_ntz")
    order = Window.partitionBy("source_id", "day").orderBy("published_at", "id")
    return articles.withColumn("day", day).withColumn("r", F.row_number().over(order)).where("r = 1").select("source_id", "day", "id")


def recent_duplicates_view(articles: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Candidates of the dedup window: stored articles of the last hours."""
    return articles.where((F.col("published_at") >= ago(as_of, hours)) & ~F.col("is_duplicate")).select("id", "title", "canonical_url", "content_hash", "title_hash", "simhash")
