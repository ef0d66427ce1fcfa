"""The registered queries of the core: name -> (spark, sf_dir) -> DataFrame, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import columns as C
from newsloom.io import table
from newsloom.operators import analytics, dedup, enrichment, function_words, links, names, relevance, search, sentiment, similarity, stories, timestamps, topics, trends
from newsloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

#: All "last hours" windows end here: the newest stored article is a few hours older.
AS_OF = "2024-10-19 00:00:00"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _counts(sql: str) -> str:
    """count_if(x) as a BIGINT: DuckDB's own is wider."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _counts(sql)
        return f

    return register


def _q4(x: str) -> str:
    return f"floor(({x}) * 10000.0::DOUBLE + 0.5::DOUBLE + 1e-9::DOUBLE) / 10000.0::DOUBLE"


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


_LIST = "id, source_id, source_name, title, description, canonical_url, published_at, language, country, category, sentiment_label, relevance_score"
_AT = f"TIMESTAMP '{AS_OF}'"


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles")


def _listed(df: DataFrame) -> DataFrame:
    return df.select(*search.LIST_COLUMNS)


# --- search -----------------------------------------------------------------


@query(f"SELECT {_LIST} FROM articles WHERE NOT is_duplicate AND language = 'en'")
def scan_filter_language(spark, d):
    return _listed(search.matching(_articles(spark, d), search.SearchQuery(language="EN")))


@query(f"SELECT {_LIST} FROM articles WHERE NOT is_duplicate AND (title ILIKE '%harbour tunnel%' OR description ILIKE '%harbour tunnel%' OR content ILIKE '%harbour tunnel%')")
def search_ilike_q(spark, d):
    return _listed(search.matching(_articles(spark, d), search.SearchQuery(q="Harbour Tunnel")))


@query(f"SELECT {_LIST} FROM articles WHERE NOT is_duplicate AND (title ILIKE '%night trains%' OR content ILIKE '%night trains%')")
def search_phrase(spark, d):
    return _listed(search.matching(_articles(spark, d), search.SearchQuery(phrase="night trains")))


@query(f"SELECT {_LIST} FROM articles WHERE (title ILIKE '%a\\_b%' ESCAPE '\\' OR description ILIKE '%a\\_b%' ESCAPE '\\' OR content ILIKE '%a\\_b%' ESCAPE '\\')")
def search_like_escape(spark, d):
    return _listed(search.matching(_articles(spark, d), search.SearchQuery(q="a_b", include_duplicates=True)))


@query(f"SELECT {_LIST} FROM articles WHERE NOT is_duplicate AND sentiment_score >= -0.5 AND sentiment_score <= 0.8 AND relevance_score >= 0.4 AND published_at >= TIMESTAMP '2024-08-01' AND published_at <= TIMESTAMP '2024-10-01'")
def search_range_filters(spark, d):
    s = search.SearchQuery(min_sentiment=-0.5, max_sentiment=0.8, min_relevance=0.4, published_after="2024-08-01 00:00:00", published_before="2024-10-01 00:00:00")
    return _listed(search.matching(_articles(spark, d), s))


@query(f"SELECT {_LIST} FROM articles WHERE NOT is_duplicate AND category = 'economy' AND country = 'GB' AND sentiment_label = 'positive'")
def search_equalities(spark, d):
    return _listed(search.matching(_articles(spark, d), search.SearchQuery(category="Economy", country="gb", sentiment_label="positive")))


@query(f"SELECT {_LIST} FROM articles WHERE source_id IN (SELECT id FROM sources WHERE slug = (SELECT min(slug) FROM sources))")
def search_source_join(spark, d):
    sources = table(spark, d, "sources")
    first = sources.agg(F.min("slug").alias("slug"))
    chosen = sources.join(F.broadcast(first), "slug", "left_semi").select(F.col("id").alias("source_id"))
    return _listed(_articles(spark, d).join(chosen, "source_id", "left_semi"))


@query(f"SELECT {_LIST} FROM articles WHERE list_contains(keywords, 'economy')")
def search_topic_semi(spark, d):
    return _listed(search.with_keyword(_articles(spark, d), "Economy"))


@query(f"SELECT {_LIST} FROM articles WHERE id IN (SELECT id FROM (SELECT id, unnest(keywords) AS k FROM articles) WHERE k ILIKE '%train%')")
def search_entity_semi(spark, d):
    return _listed(search.with_keyword_like(_articles(spark, d), "train"))


@query("SELECT raw_id, source_slug, author FROM raw_articles WHERE author ILIKE '%staff%'")
def search_author(spark, d):
    return table(spark, d, "raw_articles").where(F.expr("author ILIKE '%staff%'")).select("raw_id", "source_slug", "author")


@query("SELECT id, relevance_score FROM articles WHERE NOT is_duplicate ORDER BY relevance_score DESC NULLS LAST, id DESC LIMIT 20 OFFSET 20")
def topk_search_page(spark, d):
    return search.page(_articles(spark, d), search.SearchQuery(sort="relevance_score", offset=20)).select("id", "relevance_score")


@query("""SELECT 2::BIGINT AS page, 20::BIGINT AS page_size, count(*)::BIGINT AS total, ceil(count(*) / 20.0)::BIGINT AS pages,
ceil(count(*) / 20.0)::BIGINT > 2 AS has_next, true AS has_previous FROM articles WHERE NOT is_duplicate AND language = 'de'""")
def page_envelope(spark, d):
    return search.envelope(_articles(spark, d), search.SearchQuery(language="de"), 2, 20)


@query("SELECT id, title, array_to_string(list_sort(list_distinct(keywords)), '|') AS keywords FROM articles WHERE keywords IS NOT NULL")
def detail_nested(spark, d):
    nested = search.keyword_links(_articles(spark, d)).groupBy(F.col("article_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("keyword")), "|").alias("keywords"))
    return _articles(spark, d).select("id", "title").join(nested, "id")


# --- aggregates ---------------------------------------------------------------


@query(f"""SELECT count(*) AS total, count_if(published_at >= date_trunc('day', {_AT})) AS today, count_if(published_at >= {_AT} - INTERVAL 24 HOUR) AS last_24h,
count_if(published_at >= {_AT} - INTERVAL 168 HOUR) AS last_7d, count_if(is_duplicate) AS duplicates, count_if(status = 'pending') AS pending, count_if(status = 'failed') AS failed,
{_q4("coalesce(avg(relevance_score), 0)")} AS avg_relevance, {_q4("coalesce(avg(sentiment_score), 0)")} AS avg_sentiment FROM articles""")
def stats_conditional_agg(spark, d):
    return analytics.article_stats(_articles(spark, d), AS_OF).select(*(F.col(c).cast("bigint").alias(c) for c in ("total", "today", "last_24h", "last_7d", "duplicates", "pending", "failed")), "avg_relevance", "avg_sentiment")


@query(f"""SELECT count(*) AS total, count_if(sentiment_label = 'very_negative') AS very_negative, count_if(sentiment_label = 'negative') AS negative, count_if(sentiment_label = 'neutral') AS neutral,
count_if(sentiment_label = 'positive') AS positive, count_if(sentiment_label = 'very_positive') AS very_positive,
{_q4("coalesce(sum(CASE sentiment_label WHEN 'very_negative' THEN -1.0::DOUBLE WHEN 'negative' THEN -0.5::DOUBLE WHEN 'positive' THEN 0.5::DOUBLE WHEN 'very_positive' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / count(*), 0)")} AS weighted_average
FROM articles WHERE NOT is_duplicate AND sentiment_label IS NOT NULL AND published_at >= {_AT} - INTERVAL 720 HOUR""")
def sentiment_breakdown(spark, d):
    return analytics.sentiment_breakdown(_articles(spark, d), AS_OF, 720)


@query("""WITH c AS (SELECT category, count(*) AS articles FROM articles WHERE NOT is_duplicate AND category IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT category, articles, floor(100.0::DOUBLE * articles / sum(articles) OVER () * 100.0 + 0.5 + 1e-9) / 100.0 AS percentage FROM c""")
def category_breakdown_pct(spark, d):
    return analytics.category_breakdown(_articles(spark, d), 5)


@query(f"SELECT date_trunc('hour', published_at) AS hour, count(*) AS articles, {_q4('coalesce(avg(sentiment_score), 0)')} AS avg_sentiment FROM articles WHERE NOT is_duplicate GROUP BY 1")
def hourly_volume_series(spark, d):
    return analytics.hourly_volume(_articles(spark, d))


@query("SELECT source_id, count(*) AS articles FROM articles GROUP BY 1")
def source_totals(spark, d):
    return analytics.source_totals(_articles(spark, d))


@query(f"SELECT source_id, count(*) AS checks, {_q4('avg(success::INT)')} AS success_rate FROM source_health WHERE checked_at BETWEEN {_AT} - INTERVAL 720 HOUR AND {_AT} GROUP BY 1")
def source_success_rate(spark, d):
    return analytics.success_rates(table(spark, d, "source_health"), AS_OF, 720)


_REL = "0.55::DOUBLE * ok / n + 0.35::DOUBLE * (CASE WHEN fetched > 0 THEN valid::DOUBLE / fetched ELSE 0.5::DOUBLE END) + 0.1::DOUBLE * (1.0::DOUBLE - (CASE WHEN fetched > 0 THEN dup::DOUBLE / fetched ELSE 0.0::DOUBLE END))"


@query(f"""WITH h AS (SELECT source_id, count(*) AS n, sum(success::INT)::BIGINT AS ok, sum(articles_fetched)::BIGINT AS fetched, sum(articles_valid)::BIGINT AS valid, sum(duplicates)::BIGINT AS dup FROM source_health GROUP BY 1)
SELECT s.id AS source_id, slug, CASE WHEN n IS NULL THEN 0.5::DOUBLE ELSE {_q4(_clamp(_REL))} END AS reliability FROM sources s LEFT JOIN h ON h.source_id = s.id""")
def source_reliability(spark, d):
    return analytics.reliability(table(spark, d, "sources"), table(spark, d, "source_health"))


@query(f"""WITH a AS (SELECT source_id, count(*) AS n, count_if(published_at >= {_AT} - INTERVAL 24 HOUR) AS n24 FROM articles GROUP BY 1),
h AS (SELECT source_id, avg(success::INT) AS ok, sum(duplicates)::DOUBLE / nullif(sum(articles_fetched), 0) AS dup FROM source_health GROUP BY 1)
SELECT s.id AS source_id, slug, status, coalesce(n, 0) AS articles, coalesce(n24, 0) AS articles_24h, {_q4('coalesce(ok, 0)')} AS success_rate, {_q4('coalesce(dup, 0)')} AS duplicate_rate
FROM sources s LEFT JOIN a ON a.source_id = s.id LEFT JOIN h ON h.source_id = s.id""")
def source_stats_join(spark, d):
    return analytics.source_table(table(spark, d, "sources"), _articles(spark, d), table(spark, d, "source_health"), AS_OF)


@query("""SELECT (SELECT count(*) FROM articles) AS articles, (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM sources WHERE status = 'active') AS active_sources,
(SELECT count_if(is_duplicate) FROM articles) AS duplicates""")
def overview(spark, d):
    a = _articles(spark, d).agg(F.count(F.lit(1)).alias("articles"), F.count_if("is_duplicate").alias("duplicates"))
    s = table(spark, d, "sources").agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("status") == "active").alias("active_sources"))
    return a.crossJoin(s).select("articles", "sources", "active_sources", "duplicates")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events) GROUP BY 1, 2")
def latest_window_scalar_subquery(spark, d):
    events = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    latest = events.agg(F.max("day").alias("day"))
    return events.join(F.broadcast(latest), "day").groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def json_props_extract(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query("""WITH h AS (SELECT *, sum(success::INT) OVER (PARTITION BY source_id ORDER BY checked_at, success, coalesce(status_code, -1), coalesce(latency_ms, -1) ROWS UNBOUNDED PRECEDING) AS island FROM source_health),
r AS (SELECT source_id, island, count_if(NOT success) AS failures, count(*) AS n FROM h GROUP BY 1, 2),
l AS (SELECT source_id, arg_max(failures, island)::BIGINT AS streak, max(failures)::BIGINT AS longest, sum(n)::BIGINT AS checks FROM r GROUP BY 1)
SELECT source_id, checks, streak, longest, CASE WHEN streak >= 10 THEN 'paused' WHEN streak > 0 THEN 'failing' ELSE 'active' END AS state FROM l""")
def health_fsm_gaps_islands(spark, d):
    return analytics.failure_streaks(table(spark, d, "source_health"))


@query("SELECT user_id, (epoch_us(ts) // 3600000000 * 3600)::BIGINT AS window_start, count(*) AS hits, greatest(0, count(*) - 2)::BIGINT AS rejected FROM events GROUP BY 1, 2")
def tumbling_rate_limit(spark, d):
    return analytics.rate_windows(table(spark, d, "events"), 3600, 2)


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    from newsloom.streaming.windows import window_counts

    return window_counts(table(spark, d, "events"), "6 hours").select("window_start", "event_type", "n", F.round("total", 2).alias("total"))


# --- trends -------------------------------------------------------------------

_OBS = """obs AS (
SELECT 'topic' AS subject_type, category AS subject_key, source_name, coalesce(sentiment_score, 0) AS sentiment, id, published_at FROM articles WHERE NOT is_duplicate AND category IS NOT NULL
UNION ALL SELECT DISTINCT 'keyword', lower(k), source_name, coalesce(sentiment_score, 0), id, published_at FROM (SELECT *, unnest(keywords[1:5]) AS k FROM articles) WHERE NOT is_duplicate AND length(k) >= 3
UNION ALL SELECT 'source', lower(source_name), source_name, coalesce(sentiment_score, 0), id, published_at FROM articles WHERE NOT is_duplicate)"""
_HOURS = 360
_TREND = f"""WITH {_OBS}, c AS (SELECT subject_type, subject_key, count_if(published_at >= {_AT} - INTERVAL {_HOURS} HOUR) AS current_count, count_if(published_at < {_AT} - INTERVAL {_HOURS} HOUR) AS previous_count,
count(DISTINCT CASE WHEN published_at >= {_AT} - INTERVAL {_HOURS} HOUR THEN source_name END) AS source_count,
coalesce(avg(CASE WHEN published_at >= {_AT} - INTERVAL {_HOURS} HOUR THEN sentiment END), 0) AS a1, coalesce(avg(CASE WHEN published_at < {_AT} - INTERVAL {_HOURS} HOUR THEN sentiment END), 0) AS a0
FROM obs WHERE published_at >= {_AT} - INTERVAL {2 * _HOURS} HOUR AND published_at < {_AT} GROUP BY 1, 2 HAVING current_count > 0),
p AS (SELECT *, max(current_count) OVER () AS peak, CASE WHEN previous_count = 0 THEN 100.0::DOUBLE * current_count ELSE (current_count - previous_count)::DOUBLE / abs(previous_count) * 100.0::DOUBLE END AS growth FROM c),
t AS (SELECT subject_type, subject_key, current_count, previous_count, source_count, floor(growth * 100.0::DOUBLE + 0.5::DOUBLE + 1e-9::DOUBLE) / 100.0::DOUBLE AS growth_percent,
{_q4(_clamp(f"0.45::DOUBLE * (CASE WHEN growth > 0 THEN {_clamp('growth / 300.0::DOUBLE')} ELSE 0.0::DOUBLE END) + 0.30::DOUBLE * {_clamp('ln(1.0::DOUBLE + current_count) / ln(1.0::DOUBLE + greatest(peak, 2))')} + 0.25::DOUBLE * {_clamp('ln(1.0::DOUBLE + source_count) / ln(9.0::DOUBLE)')}"))} AS trend_score,
{_q4(_clamp(f"0.5::DOUBLE * {_clamp('current_count / 10.0::DOUBLE')} + 0.3::DOUBLE * {_clamp('source_count / 4.0::DOUBLE')} + 0.2::DOUBLE * (CASE WHEN previous_count > 0 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END)"))} AS confidence,
{_q4('a1')} AS avg_sentiment, {_q4('a1 - a0')} AS sentiment_delta, CASE WHEN previous_count = 0 THEN 'new' WHEN growth >= 25 THEN 'rising' WHEN growth <= -25 THEN 'falling' ELSE 'stable' END AS direction FROM p WHERE current_count >= 3)
"""


def _trends(spark, d):
    return trends.detect(trends.observations(_articles(spark, d)), AS_OF, _HOURS)


@query(_TREND + "SELECT * FROM t ORDER BY trend_score DESC, current_count DESC, subject_type, subject_key LIMIT 50")
def trend_detect(spark, d):
    return trends.top(_trends(spark, d))


@query(_TREND + "SELECT * FROM t WHERE direction IN ('rising', 'new') AND growth_percent >= 150 AND source_count >= 3 AND confidence >= 0.5")
def trend_breaking(spark, d):
    return trends.breaking(_trends(spark, d))


@query(f"WITH {_OBS} SELECT subject_type, subject_key, count(*) AS n, count(DISTINCT source_name) AS sources FROM obs GROUP BY 1, 2")
def trend_observations_union(spark, d):
    seen = trends.observations(_articles(spark, d))
    return seen.groupBy("subject_type", "subject_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_name").alias("sources"))


@query(f"""WITH {_OBS}, c AS (SELECT subject_key, date_trunc('day', published_at) AS day, count(*) AS articles FROM obs WHERE subject_type = 'topic' GROUP BY 1, 2)
SELECT subject_key, day, articles, coalesce(lag(articles) OVER (PARTITION BY subject_key ORDER BY day), 0) AS before, articles - coalesce(lag(articles) OVER (PARTITION BY subject_key ORDER BY day), 0) AS change FROM c""")
def trend_history_lag(spark, d):
    return trends.history(trends.observations(_articles(spark, d)))


# --- links, merges, inserts -----------------------------------------------------

_LINKS = "k AS (SELECT DISTINCT id, unnest(keywords) AS keyword FROM articles)"


@query(f"""WITH {_LINKS}, p AS (SELECT x.keyword AS a, y.keyword AS b, count(*) AS shared FROM k x JOIN k y ON x.id = y.id AND x.keyword < y.keyword GROUP BY 1, 2)
SELECT a, b, shared, {_q4('shared::DOUBLE / max(shared) OVER ()')} AS weight FROM p""")
def cooccurrence_graph(spark, d):
    return links.cooccurrence(search.keyword_links(_articles(spark, d)))


@query(f"""WITH {_LINKS}, f AS (SELECT DISTINCT q.id AS query_id, a.id, a.published_at FROM k q JOIN k o ON q.keyword = o.keyword AND q.id <> o.id JOIN articles a ON a.id = o.id WHERE q.id % 20 = 0 AND NOT a.is_duplicate),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY published_at DESC, id DESC) AS rank FROM f) SELECT * FROM r WHERE rank <= 5""")
def similar_articles(spark, d):
    articles = _articles(spark, d)
    return links.similar_articles(articles, search.keyword_links(articles), articles.where("id % 20 = 0"))


@query("""WITH u AS (SELECT slug, name || ' (updated)' AS name, 'pending' AS status, weight + 0.1::DOUBLE AS weight FROM sources WHERE id % 3 = 0 UNION ALL SELECT slug || '-copy', name, 'pending', weight FROM sources WHERE id % 5 = 0)
SELECT coalesce(s.slug, u.slug) AS slug, coalesce(u.name, s.name) AS name, coalesce(s.status, u.status) AS status, coalesce(u.weight, s.weight) AS weight FROM sources s FULL JOIN u ON s.slug = u.slug""")
def upsert_merge(spark, d):
    sources = table(spark, d, "sources")
    changed = sources.where("id % 3 = 0").select("slug", F.concat("name", F.lit(" (updated)")).alias("name"), F.lit("pending").alias("status"), (F.col("weight") + 0.1).alias("weight"))
    added = sources.where("id % 5 = 0").select(F.concat("slug", F.lit("-copy")).alias("slug"), "name", F.lit("pending").alias("status"), "weight")
    return links.upsert(sources.select("slug", "name", "status", "weight"), changed.unionByName(added), "slug", keep=("status",))


@query("""WITH t AS (SELECT source_id, min(published_at) AS f, max(published_at) AS l FROM articles GROUP BY 1), u AS (SELECT source_id, min(checked_at) AS f, max(checked_at) AS l FROM source_health GROUP BY 1)
SELECT coalesce(t.source_id, u.source_id) AS source_id, least(t.f, u.f) AS first_seen, greatest(t.l, u.l) AS last_seen FROM t FULL JOIN u ON t.source_id = u.source_id""")
def event_upsert_extent(spark, d):
    extent = lambda df, at: df.groupBy("source_id").agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    return links.merge_extent(extent(_articles(spark, d), "published_at"), extent(table(spark, d, "source_health"), "checked_at"), "source_id")


_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH n AS (SELECT raw_id AS id, sha256({_NORM.format('title')}) AS title_hash FROM raw_articles WHERE title IS NOT NULL), m AS (SELECT sha256({_NORM.format('title')}) AS title_hash FROM articles WHERE title IS NOT NULL)
SELECT title_hash, min(id) AS id FROM n WHERE title_hash NOT IN (SELECT title_hash FROM m) GROUP BY 1""")
def antijoin_insert(spark, d):
    new = table(spark, d, "raw_articles").select(F.col("raw_id").alias("id"), C.content_fingerprint(F.col("title")).alias("title_hash"))
    return links.insert_new(_articles(spark, d).select(C.content_fingerprint(F.col("title")).alias("title_hash")), new, "title_hash")


@query(f"SELECT source_id, count(*) AS kept FROM source_health WHERE checked_at >= {_AT} - INTERVAL 720 HOUR GROUP BY 1")
def retention_filter(spark, d):
    kept = links.retained(table(spark, d, "source_health"), "checked_at", analytics.ago(AS_OF, 720))
    return kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT event_id, ts, user_id FROM events WHERE event_type IN ('click', 'signup') AND ts <= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id LIMIT 25")
def queue_due_topk(spark, d):
    due = table(spark, d, "events").where(F.col("event_type").isin("click", "signup") & (F.col("ts") <= analytics.instant("2024-01-10 00:00:00")))
    return due.orderBy(F.desc("ts"), "event_id").limit(25).select("event_id", "ts", "user_id")


# --- relevance, alerts, quality ---------------------------------------------------

_READER = relevance.Profile(topics=("economy", "science"), keywords=("trains",), preferred_sources=("pinport-ledger",), excluded_sources=("bozei-beacon",))
_RECENCY = f"coalesce(pow(0.5::DOUBLE, greatest(0.0::DOUBLE, (epoch_us({_AT}) - epoch_us(published_at)) / 3600000000.0::DOUBLE) / 18.0::DOUBLE), 0.0::DOUBLE)"
_SOURCE = _clamp(f"0.5::DOUBLE * {_clamp('coalesce(weight, 1.0::DOUBLE) / 2.0::DOUBLE')} + 0.5::DOUBLE * {_clamp('coalesce(reliability_score, 0.5::DOUBLE)')}")
_QUALITY = _clamp("coalesce(quality_score, 0.5::DOUBLE)")
_SCORED = f"""WITH p AS (SELECT a.*, s.slug, {_SOURCE} AS src, {_RECENCY} AS rec, {_QUALITY} AS qua FROM articles a LEFT JOIN sources s ON s.id = a.source_id)"""


@query(f"""{_SCORED} SELECT id, {_q4(_clamp("(0.0::DOUBLE + src * 0.2::DOUBLE + rec * 0.25::DOUBLE + 0.5::DOUBLE * 0.18::DOUBLE + 0.5::DOUBLE * 0.12::DOUBLE + 0.5::DOUBLE * 0.08::DOUBLE + qua * 0.1::DOUBLE + 0.25::DOUBLE * 0.05::DOUBLE + 0.5::DOUBLE * 0.02::DOUBLE) / 1.0::DOUBLE"))} AS score FROM p""")
def recency_relevance(spark, d):
    return relevance.scored(_articles(spark, d), table(spark, d, "sources"), AS_OF).select("id", "score")


@query(f"""{_SCORED}, q AS (SELECT id, published_at, CASE WHEN slug = 'bozei-beacon' THEN 0.0::DOUBLE ELSE {_q4(_clamp(f"(0.0::DOUBLE + (CASE WHEN slug = 'pinport-ledger' THEN {_clamp('src + 0.3::DOUBLE')} ELSE src END) * 0.2::DOUBLE + rec * 0.25::DOUBLE + (CASE WHEN category IN ('economy', 'science') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) * 0.18::DOUBLE + (CASE WHEN len(list_filter(coalesce(keywords, []), lambda k: contains(lower(k), 'trains'))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.12::DOUBLE + 0.5::DOUBLE * 0.08::DOUBLE + qua * 0.1::DOUBLE + 0.25::DOUBLE * 0.05::DOUBLE + 0.5::DOUBLE * 0.02::DOUBLE) / 1.0::DOUBLE"))} END AS score FROM p WHERE NOT is_duplicate)
SELECT id, score FROM q WHERE score > 0 ORDER BY score DESC, published_at DESC, id DESC LIMIT 20""")
def feed_rerank(spark, d):
    return relevance.feed(_articles(spark, d), table(spark, d, "sources"), AS_OF, _READER).select("id", "score")


@query(f"""WITH r(alert_id, kw, topics, sentiment, min_relevance, window_minutes, min_articles) AS (VALUES (1, ['harbour', 'tunnel'], []::VARCHAR[], NULL, 0.0::DOUBLE, 43200, 1), (2, []::VARCHAR[], ['economy'], 'positive', 0.3::DOUBLE, 20160, 2), (3, ['trains'], ['science', 'health'], 'negative', 0.0::DOUBLE, 86400, 1)),
a AS (SELECT *, lower(concat_ws(' ', title, description, array_to_string(coalesce(keywords, []), ' '))) AS hay, CASE WHEN sentiment_score > 0.1 THEN 'positive' WHEN sentiment_score < -0.1 THEN 'negative' ELSE 'neutral' END AS sb FROM articles WHERE NOT is_duplicate AND published_at < {_AT})
SELECT alert_id, count(*) AS matches, max(published_at) AS newest FROM r JOIN a ON (epoch_us({_AT}) - epoch_us(published_at)) / 60000000.0 <= window_minutes AND coalesce(relevance_score, 0) >= r.min_relevance
AND (len(kw) = 0 OR len(list_filter(kw, lambda k: contains(hay, k))) > 0) AND (len(topics) = 0 OR list_contains(topics, coalesce(category, ''))) AND (sentiment IS NULL OR sentiment = sb) GROUP BY alert_id, min_articles HAVING count(*) >= min_articles""")
def alert_rules_theta(spark, d):
    rules = spark.createDataFrame(
        [(1, ["harbour", "tunnel"], [], None, 0.0, 43200, 1), (2, [], ["economy"], "positive", 0.3, 20160, 2), (3, ["trains"], ["science", "health"], "negative", 0.0, 86400, 1)],
        "alert_id int, keywords array<string>, topics array<string>, sentiment string, min_relevance double, window_minutes int, min_articles int",
    )
    return relevance.alert_matches(_articles(spark, d), rules, AS_OF)


@query(f"SELECT source_id, max(published_at) AS last_triggered_at FROM articles GROUP BY 1 HAVING max(published_at) + INTERVAL 1440 MINUTE <= {_AT} OR max(published_at) IS NULL")
def alert_cooldown(spark, d):
    alerts = _articles(spark, d).groupBy("source_id").agg(F.max("published_at").alias("last_triggered_at")).withColumn("cooldown_minutes", F.lit(1440))
    return relevance.cooled_down(alerts, AS_OF).select("source_id", "last_triggered_at")


_ISSUES = r"""q AS (SELECT raw_id, trim(coalesce(title, '')) AS t, coalesce(description, '') AS ds, coalesce(content, '') AS ct, coalesce(author, '') AS au, coalesce(image_url, '') AS im, coalesce(published_at, '') AS pa, trim(coalesce(url, '')) AS u FROM raw_articles),
w AS (SELECT *, len(regexp_extract_all(CASE WHEN ct <> '' THEN ct ELSE ds END, '[\p{L}\p{N}_]+')) AS words, len(regexp_extract_all(t, '\p{L}')) AS le, len(regexp_extract_all(t, '\p{Lu}')) AS up, t || chr(10) || ds || chr(10) || substr(ct, 1, 2000) AS hay FROM q),
i AS (SELECT raw_id, [CASE WHEN t = '' THEN 'missing_title' END, CASE WHEN t <> '' AND length(t) < 8 THEN 'title_too_short' END, CASE WHEN length(t) >= 8 AND le > 0 AND up::DOUBLE / le > 0.7 THEN 'shouting_title' END,
CASE WHEN NOT regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN 'invalid_url' END, CASE WHEN pa = '' THEN 'missing_date' END, CASE WHEN ct = '' AND ds = '' THEN 'empty_content' END, CASE WHEN NOT (ct = '' AND ds = '') AND words < 15 THEN 'thin_content' END,
CASE WHEN ds = '' THEN 'missing_description' END, CASE WHEN au = '' THEN 'missing_author' END, CASE WHEN im = '' THEN 'missing_image' END,
CASE WHEN regexp_matches(hay, '(?i)\b(click here|buy now|limited time offer|100% free|earn \$\d+)\b') OR regexp_matches(hay, '(?i)\b(viagra|casino|porn|xxx|escort)\b') OR regexp_matches(hay, '(?i)(https?://\S+){6,}') THEN 'spam_like' END] AS raw_issues FROM w),
j AS (SELECT raw_id, list_filter(raw_issues, lambda x: x IS NOT NULL) AS issues FROM i)"""
_COST = "list_sum(list_transform(issues, lambda x: CASE x WHEN 'missing_title' THEN 0.5::DOUBLE WHEN 'title_too_short' THEN 0.3::DOUBLE WHEN 'shouting_title' THEN 0.05::DOUBLE WHEN 'invalid_url' THEN 0.5::DOUBLE WHEN 'missing_date' THEN 0.3::DOUBLE WHEN 'empty_content' THEN 0.15::DOUBLE WHEN 'thin_content' THEN 0.1::DOUBLE WHEN 'missing_description' THEN 0.05::DOUBLE WHEN 'missing_author' THEN 0.05::DOUBLE WHEN 'missing_image' THEN 0.02::DOUBLE ELSE 0.6::DOUBLE END))"


@query(f"WITH {_ISSUES} SELECT raw_id, array_to_string(issues, ',') AS issues, {_q4(_clamp(f'1.0::DOUBLE - coalesce({_COST}, 0.0::DOUBLE)'))} AS quality, NOT list_has_any(issues, ['missing_title', 'title_too_short', 'invalid_url', 'missing_date', 'spam_like']) AS is_valid FROM j")
def quality_score(spark, d):
    return relevance.with_quality(table(spark, d, "raw_articles")).select("raw_id", F.array_join("issues", ",").alias("issues"), "quality", "is_valid")


@query(f"WITH {_ISSUES} SELECT issue, count(*) AS items FROM (SELECT unnest(issues) AS issue FROM j) GROUP BY 1")
def quality_report(spark, d):
    return relevance.quality_report(table(spark, d, "raw_articles"))


@query("SELECT source_id, day, id FROM (SELECT source_id, date_trunc('day', published_at) AS day, id, row_number() OVER (PARTITION BY source_id, date_trunc('day', published_at) ORDER BY published_at, id) AS r FROM articles) WHERE r = 1")
def first_wins_per_key(spark, d):
    return relevance.first_of_day(_articles(spark, d))


# --- text functions and similarity ---------------------------------------------------


@query("SELECT doc_id AS id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))::BIGINT AS words FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), C.word_count(F.col("text")).alias("words"))


_TERMS = "t AS (SELECT doc_id AS id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}]+'), lambda w: length(w) >= 2)) AS term FROM documents)"


@query(f"WITH {_TERMS} SELECT term, count(*) AS n, count(DISTINCT id) AS documents FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def top_terms(spark, d):
    return similarity.top_terms(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


_TFIDF = f"""{_TERMS}, c AS (SELECT id, term, count(*) AS n FROM t GROUP BY 1, 2), v AS (SELECT term, count(*) AS df FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4000), m AS (SELECT count(DISTINCT id) AS docs FROM c),
w AS (SELECT c.id, c.term, (1.0::DOUBLE + ln(n)) * (ln((1.0::DOUBLE + docs) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS weight FROM c JOIN v USING (term), m)"""


@query(f"WITH {_TFIDF} SELECT id, term, {_q4('weight')} AS weight FROM w")
def tfidf_vectors(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return similarity.tfidf(docs).select("id", "term", C.round4(F.col("weight")).alias("weight"))


@query(f"""WITH {_TFIDF}, g AS (SELECT doc_id AS id, category AS grp FROM documents WHERE category IS NOT NULL), mm AS (SELECT grp, count(DISTINCT id) AS members FROM g GROUP BY 1),
s AS (SELECT grp, term, sum(weight) AS total FROM w JOIN g USING (id) GROUP BY 1, 2), r AS (SELECT grp, term, total, row_number() OVER (PARTITION BY grp ORDER BY round(total, 6) DESC, term) AS r FROM s)
SELECT grp, term, {_q4('total / members')} AS weight FROM r JOIN mm USING (grp) WHERE r <= 10""")
def centroid_topk(spark, d):
    docs = table(spark, d, "documents")
    vectors = similarity.tfidf(docs.select(F.col("doc_id").alias("id"), "text"))
    return similarity.centroids(vectors, docs.where("category is not null").select(F.col("doc_id").alias("id"), F.col("category").alias("grp")))


_BODY = _NORM.format("coalesce(title, '') || chr(10) || coalesce(content, '')")


@query(f"""WITH k AS (SELECT id, published_at, sha256({_BODY}) AS k FROM articles), f AS (SELECT k, arg_min(id, (published_at, id)) AS original, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1)
SELECT id, original FROM k JOIN f USING (k) WHERE id <> original""")
def fingerprint_exact_dups(spark, d):
    return similarity.fingerprint_duplicates(_articles(spark, d))


@query(f"""WITH k AS (SELECT id, published_at, sha256({_NORM.format('title')}) AS k FROM articles WHERE title IS NOT NULL), f AS (SELECT k, arg_min(id, (published_at, id)) AS original, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1)
SELECT id, original FROM k JOIN f USING (k) WHERE id <> original""")
def title_hash_dups(spark, d):
    return similarity.title_duplicates(_articles(spark, d))


@query(f"""WITH s AS (SELECT raw_id AS id, list_sort(list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+'))) AS t FROM raw_articles WHERE title IS NOT NULL), r AS (SELECT t, min(id) AS id FROM s WHERE len(t) > 0 GROUP BY 1),
p AS (SELECT x.id AS a, y.id AS b, {_q4("len(list_intersect(x.t, y.t))::DOUBLE / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)))")} AS similarity FROM r x JOIN r y ON x.id < y.id)
SELECT a, b, similarity FROM p WHERE similarity >= 0.85""")
def token_jaccard_pairs(spark, d):
    return similarity.title_jaccard_pairs(table(spark, d, "raw_articles").select(F.col("raw_id").alias("id"), "title"))


# Every row by itself: the classes are not assumed.
@query(f"""WITH s AS (SELECT raw_id AS id, list_sort(list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+'))) AS t FROM raw_articles WHERE title IS NOT NULL)
SELECT x.id, min(y.id) FILTER (WHERE x.t = y.t) AS rep, count(*) - 1 AS links FROM s x JOIN s y ON len(x.t) > 0 AND len(y.t) > 0 AND {_q4("len(list_intersect(x.t, y.t))::DOUBLE / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)))")} >= 0.85 GROUP BY 1""")
def token_jaccard_members(spark, d):
    titles = table(spark, d, "raw_articles").select(F.col("raw_id").alias("id"), "title")
    return similarity.class_links(similarity.title_classes(titles), similarity.title_jaccard_pairs(titles))


_SIM = """w AS (SELECT id, t, count(*) AS n FROM (SELECT raw_id AS id, unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+')) AS t FROM raw_articles) GROUP BY 1, 2),
h AS (SELECT id, n, ('0x' || left(md5(t), 16))::UBIGINT AS h FROM w), b AS (SELECT id, k, sum(CASE WHEN (h >> (63 - k)) & 1 = 1 THEN n ELSE -n END) AS s FROM h, (SELECT unnest(range(64)) AS k) GROUP BY 1, 2),
z AS (SELECT id, string_agg(CASE WHEN s > 0 THEN '1' ELSE '0' END, '' ORDER BY k) AS bits FROM b GROUP BY 1),
hx AS (SELECT id, bits, array_to_string(list_transform(range(16), lambda i: substr('0123456789abcdef', 1 + instr('0000 0001 0010 0011 0100 0101 0110 0111 1000 1001 1010 1011 1100 1101 1110 1111', substr(bits, (4 * i + 1)::BIGINT, 4)) // 5, 1)), '') AS simhash FROM z)"""


def _titles_as_text(spark, d):
    return table(spark, d, "raw_articles").where("title is not null").select(F.col("raw_id").alias("id"), F.col("title").alias("text"))


@query(f"WITH {_SIM} SELECT id, simhash FROM hx")
def simhash_md5(spark, d):
    return similarity.simhash(_titles_as_text(spark, d))


@query(f"""WITH {_SIM}, r AS (SELECT bits, min(id) AS id FROM z GROUP BY 1), p AS (SELECT x.id AS a, y.id AS b, hamming(x.bits, y.bits)::BIGINT AS distance FROM r x JOIN r y ON x.id < y.id) SELECT a, b, distance FROM p WHERE distance <= 3""")
def simhash_band_join(spark, d):
    return similarity.simhash_pairs(similarity.simhash(_titles_as_text(spark, d)))


@query(f"WITH {_SIM} SELECT x.id, min(y.id) FILTER (WHERE x.bits = y.bits) AS rep, count(*) - 1 AS links FROM z x JOIN z y ON hamming(x.bits, y.bits) <= 3 GROUP BY 1")
def simhash_band_members(spark, d):
    hashes = similarity.simhash(_titles_as_text(spark, d))
    return similarity.class_links(similarity.simhash_classes(hashes), similarity.simhash_pairs(hashes))


@query("SELECT raw_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS domain FROM raw_articles WHERE url IS NOT NULL")
def url_domain(spark, d):
    return table(spark, d, "raw_articles").where("url is not null").select("raw_id", C.url_domain(F.col("url")).alias("domain"))


@query("""SELECT raw_id, CASE WHEN s = '' THEN NULL ELSE substr(s, 1, 48) END AS category FROM (SELECT raw_id, regexp_replace(regexp_replace(lower(trim(category)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM raw_articles)""")
def category_slug_map(spark, d):
    return table(spark, d, "raw_articles").select("raw_id", C.normalize_category(F.col("category")).alias("category"))


_LANGS = ", ".join(f"'{k}': '{v}'" for k, v in C.LANGUAGE_ALIASES.items())


@query(f"""WITH l AS (SELECT raw_id, replace(lower(trim(language)), '_', '-') AS v FROM raw_articles), b AS (SELECT raw_id, v, split_part(v, '-', 1) AS b FROM l)
SELECT raw_id, coalesce(MAP {{{_LANGS}}}[v], MAP {{{_LANGS}}}[b], CASE WHEN regexp_full_match(b, '[a-z]{{2}}') THEN b END) AS language FROM b""")
def language_alias_map(spark, d):
    return table(spark, d, "raw_articles").select("raw_id", C.normalize_language(F.col("language")).alias("language"))


@query("SELECT raw_id, CASE WHEN regexp_full_match(v, '[A-Z]{2}') THEN v WHEN regexp_matches(v, '-[A-Z]{2}$') THEN regexp_extract(v, '-([A-Z]{2})$', 1) END AS country FROM (SELECT raw_id, upper(trim(country)) AS v FROM raw_articles)")
def country_code(spark, d):
    return table(spark, d, "raw_articles").select("raw_id", C.normalize_country(F.col("country")).alias("country"))


@query()
def dedup_resolved(spark, d):
    return dedup.deduplicate(_articles(spark, d))


@query()
def event_clusters(spark, d):
    items = table(spark, d, "raw_articles")
    rows = items.select(
        F.col("raw_id").alias("id"), "title", "description", "content", "source_name", F.col("fetched_at").alias("published_at"), "category",
        C.normalize_language(F.col("language")).alias("language"), F.lit(None).cast("double").alias("sentiment_score"), F.lit(None).cast("array<string>").alias("keywords"), F.lit(False).alias("is_duplicate"),
    )
    return stories.story_clusters(rows, days=7)


@query()
def keyphrases(spark, d):
    found = enrichment.enrich(_articles(spark, d)).select("id", F.explode("keyphrases").alias("k"))
    return found.select("id", "k.text", "k.score", "k.frequency")


@query()
def summary_extract(spark, d):
    return enrichment.enrich(_articles(spark, d)).select("id", "summary")


_BARE = "list_transform(list_filter(regexp_split_to_array(trim(content), '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(lower(w), '[^\\p{L}]', '', 'g'))"
_SYL = "CASE WHEN w = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN suffix(w, 'e') AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END"


@query(f"""WITH w AS (SELECT id, content, {_BARE} AS b FROM articles), s AS (SELECT id, content, len(b) AS n, coalesce(list_sum(list_transform(b, lambda w: {_SYL})), 0)::BIGINT AS syl, greatest(1, len(regexp_extract_all(content, '[.!?]'))) AS ends FROM w)
SELECT id, CASE WHEN length(content) >= 100 AND n >= 20 THEN {_q4(_clamp("(206.835::DOUBLE - 1.015::DOUBLE * (n::DOUBLE / ends) - 84.6::DOUBLE * (syl::DOUBLE / n)) / 100.0::DOUBLE"))} END AS readability FROM s""")
def readability_flesch(spark, d):
    return _articles(spark, d).select("id", enrichment.readability(F.col("content")).alias("readability"))


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}]+')"


@query(f"""WITH t AS (SELECT doc_id AS id, lang, list_filter({_WORDS}, lambda w: length(w) >= 2) AS w FROM documents), c AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM t WHERE lang IS NOT NULL) GROUP BY 1, 2),
r AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM c), p AS (SELECT lang, word, count(*) OVER (PARTITION BY word) = 1 AS only_one FROM r WHERE r <= 30),
k AS (SELECT id, total, word, count(*) AS n FROM (SELECT id, len(w) AS total, unnest(w) AS word FROM t WHERE len(w) >= 8) GROUP BY 1, 2, 3),
s AS (SELECT id, p.lang, sum(n * CASE WHEN only_one THEN 3 ELSE 1 END)::DOUBLE / total AS score FROM k JOIN p USING (word) GROUP BY id, total, p.lang),
f AS (SELECT id, lang, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, lang) AS r, coalesce(lead(score) OVER (PARTITION BY id ORDER BY score DESC, lang), 0.0::DOUBLE) AS second FROM s),
g AS (SELECT id, lang, {_q4(f"least(0.99::DOUBLE, 0.5::DOUBLE * {_clamp('score / 0.25::DOUBLE')} + 0.5::DOUBLE * (score - second) / score)")} AS confidence FROM f WHERE r = 1) SELECT * FROM g WHERE confidence >= 0.15""")
def language_profile_score(spark, d):
    docs = table(spark, d, "documents")
    return function_words.detect(docs.select(F.col("doc_id").alias("id"), "text"), function_words.profiles(docs.select("lang", "text")))


@query(sentiment.sentiment_sql("articles", "id", "concat_ws(chr(10), title, content)"))
def sentiment_scores(spark, d):
    return sentiment.sentiment(_articles(spark, d).select("id", F.concat_ws("\n", "title", "content").alias("text")))


@query()
def named_entities(spark, d):
    found = names.named_entities(_articles(spark, d))
    return found.select("id", F.array_join(F.transform("entities", lambda x: F.concat_ws(":", x["name"], x["kind"])), "|").alias("entities"))


TOPICS = {"transport": {"night trains": 1.0, "tram": 1.0, "river freight": 2.0, "track": 1.0}, "money": {"million": 1.0, "shares": 2.0, "cost": 1.0}, "schools": {"school roof": 2.0, "teacher": 1.0}}


def _topic_sql() -> str:
    norm = "' ' || regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}_]+', '  ', 'g') || ' '"
    parts = []
    for topic, found in TOPICS.items():
        total = "0.0::DOUBLE"
        for term, weight in sorted(found.items()):
            needle = " " + "  ".join(term.split()) + " "
            hits = lambda c, n=needle: f"((length({c}) - length(replace({c}, '{n}', ''))) // {len(n)})"
            total += f" + {weight}::DOUBLE * (3.0::DOUBLE * least({hits('t')}, 2) + pow(least({hits('b')}, 5)::DOUBLE, 0.7::DOUBLE))"
        parts.append(f"SELECT id, '{topic}' AS topic, {total} AS raw FROM n")
    return f"""WITH n AS (SELECT id, {norm.format('title')} AS t, {norm.format('content')} AS b FROM articles), e AS ({' UNION ALL '.join(parts)}),
s AS (SELECT id, topic, {_q4('raw / max(raw) OVER (PARTITION BY id)')} AS score FROM e WHERE raw > 0), r AS (SELECT id, topic, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, topic) AS rank FROM s WHERE score >= 0.12)
SELECT * FROM r WHERE rank <= 3"""


@query(_topic_sql())
def topic_lexicon_score(spark, d):
    return topics.topic_scores(_articles(spark, d), TOPICS)


@query("""WITH RECURSIVE m AS (SELECT DISTINCT user_id AS alert_id, ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), f AS (SELECT alert_id, min(ts) AS fired_at FROM m GROUP BY 1
UNION ALL SELECT f.alert_id, (SELECT min(m.ts) FROM m WHERE m.alert_id = f.alert_id AND m.ts >= f.fired_at + INTERVAL 1440 MINUTE) FROM f WHERE f.fired_at IS NOT NULL) SELECT alert_id::BIGINT AS alert_id, fired_at FROM f WHERE fired_at IS NOT NULL""")
def alert_cooldown(spark, d):
    matches = table(spark, d, "events").select(F.col("user_id").alias("alert_id"), "ts")
    return ingest.cooled(matches, 1440).select("alert_id", F.col("fired_at").cast("timestamp_ntz").alias("fired_at"))


@query()
def author_names(spark, d):
    return table(spark, d, "raw_articles").select("raw_id", C.normalize_author(F.col("author")).alias("author"))


@query()
def url_canonical(spark, d):
    from newsloom.functions.udfs import canonical_url

    return table(spark, d, "raw_articles").select("raw_id", canonical_url(F.col("url")).alias("canonical_url"))


@query()
def p5_found(spark, d):
    return timestamps.article_times(table(spark, d, "raw_articles"), table(spark, d, "sources"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Trends over windows wide enough for the smallest tables."""
    return trends.top(trends.detect(trends.observations(_articles(spark, d)), AS_OF, 1080, least=1))
