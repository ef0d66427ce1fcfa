"""Order-dependent operators against plain versions, and streams against batches."""

import itertools
import math
import random
import time
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.functions import columns as C
from newsloom.operators import dedup, enrichment, links, relevance, search, similarity, stories
from newsloom.streaming import ingest, windows

RNG = random.Random(5)
T0 = datetime(2025, 1, 1)


def sequential(rows, keys, pairs):
    """The rule as it is stated: one row after the other, against kept ones only."""
    near = {(later, earlier) for later, earlier, *_ in pairs}
    kept = []
    for r in sorted(rows, key=lambda r: r[1]):
        if not any(any(r[2 + k] is not None and r[2 + k] == o[2 + k] for k in range(len(keys))) or (r[0], o[0]) in near for o in kept):
            kept.append(r)
    return {r[0] for r in kept}


def test_resolution_equals_the_sequential_rule(spark):
    rows = [(i, i, RNG.choice([None, *range(25)]), RNG.choice([None, *range(30)])) for i in range(60)]
    pairs = [(b, a, 4, 0.9) for a, b in {tuple(sorted(RNG.sample(range(60), 2))) for _ in range(40)}]
    df = spark.createDataFrame(rows, "id long, ord long, canonical_url int, content_hash int")
    edges = spark.createDataFrame(pairs, "later long, earlier long, level int, score double")
    found = dedup.resolve(df, dedup.KEYS, edges).collect()
    kept = {r.id for r in found if r.duplicate_of is None}
    assert kept == sequential(rows, dedup.KEYS, pairs)
    assert all(r.duplicate_of in kept for r in found if r.duplicate_of is not None)
    assert dedup.resolve(df.limit(0), dedup.KEYS, edges.limit(0)).count() == 0


def test_linked_classes_equal_the_sequential_rule(spark):
    rng = random.Random(11)
    rows = [(i, rng.randrange(1000) * 100 + i, rng.choice([None, *range(40)]), rng.choice([None, *range(15)]), rng.choice([None, *range(30)])) for i in range(80)]
    links = {"simhash": {tuple(sorted(rng.sample(range(15), 2))): rng.choice([0.98, 0.97]) for _ in range(8)}, "copy": {tuple(sorted(rng.sample(range(30), 2))): rng.random() for _ in range(15)}}
    keys = {"content_hash": 2, "simhash": 3, "copy": 4}

    def hits(r, o):
        for k, (name, level) in enumerate(keys.items()):
            x, y = r[2 + k], o[2 + k]
            score = None if x is None or y is None else 1.0 if x == y else links.get(name, {}).get((min(x, y), max(x, y)))
            if score is not None:
                yield level, -score, o[1], o[0]

    kept, want = [], {}
    for r in sorted(rows, key=lambda r: r[1]):
        found = min((h for o in kept for h in hits(r, o)), default=None)
        want[r[0]] = (found[3], found[0]) if found else (None, None)
        kept += [] if found else [r]
    df = spark.createDataFrame(rows, "id long, ord long, content_hash int, simhash int, copy int")
    none = spark.createDataFrame([], "later long, earlier long, level int, score double")
    edges = {k: spark.createDataFrame([(x, y, s) for (x, y), s in e.items()], "x int, y int, score double") for k, e in links.items()}
    assert {r.id: (r.duplicate_of, r.level) for r in dedup.resolve(df, keys, none, edges).collect()} == want


def article(i, title, content, **more):
    row = {"id": i, "title": title, "content": content, "description": None, "canonical_url": f"u{i}", "content_hash": f"h{i}", "published_at": T0 + timedelta(hours=i), "language": "en", "source_name": f"s{i % 3}", "sentiment_score": 0.1, "keywords": ["k"], "is_duplicate": False}
    return row | more


SCHEMA = "id long, title string, content string, description string, canonical_url string, content_hash string, published_at timestamp_ntz, language string, source_name string, sentiment_score double, keywords array<string>, is_duplicate boolean"


def test_deduplicate_levels(spark):
    body = "The regulator approved the merger of the two port operators after a long review of the harbour fees and the night shifts "
    other = "Farmers counted the seed stores in the valley while the council argued about a tram line to the coast "
    rows = [article(1, "Regulator approves merger", body * 2), article(2, "x", other, canonical_url="u1"), article(3, "y", "z", content_hash="h1"), article(4, "Regulator approves merger", body * 2 + "One more sentence follows."), article(5, "Seeds and trams", other * 2), article(6, None, None, canonical_url=None)]
    found = {r.id: (r.duplicate_of, r.level) for r in dedup.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1] == found[5] == found[6] == (None, None)
    assert found[2] == (1, 1) and found[3] == (1, 2) and found[4][0] == 1 and found[4][1] in (3, 4)


def test_deduplicate_reaches_every_member_of_a_class(spark):
    body = "The regulator approved the merger of the two port operators after a long review of the harbour fees and the night shifts. " * 3
    # The class of equal texts has its smallest id last; a near text between its members still meets the first one.
    rows = [article(1, "Port fees", body, published_at=T0 + timedelta(hours=30)), article(2, "Port fees", body, published_at=T0), article(3, "Dock news", body + "Officials agreed.")]
    # Equal titles with texts that agree in part, in the same order of words and in another; an unrelated text under the title stays.
    told = "Farmers counted seed stores near the valley while ministers argued about tram lines, budgets, schools and bridges"
    rows += [article(11, "Valley talks go on", told), article(12, "Valley talks go on", told.replace("budgets, schools and bridges", "taxes, clinics plus roads today")), article(13, "go on valley talks", told.replace("Farmers counted seed stores", "Growers weighed grain heaps")), article(14, "Valley talks go on", "Quartz watches sold quickly during winter auctions abroad")]
    rows += [article(21, "???", "Orchestras rehearsed symphonies inside empty theatres"), article(22, "!!", "Orchestras rehearsed symphonies inside empty theatres while critics listened")]
    df = spark.createDataFrame(rows, SCHEMA)
    hashes = {r.id: int(r.simhash, 16) for r in similarity.simhash(df.select("id", F.concat_ws(" ", "title", "content").alias("text"))).collect()}
    assert hashes[1] == hashes[2] and 0 < (hashes[3] ^ hashes[1]).bit_count() <= 3
    assert all((hashes[a] ^ hashes[b]).bit_count() > 3 for a, b in ((11, 12), (11, 13), (11, 14), (21, 22)))
    found = {r.id: (r.duplicate_of, r.level) for r in dedup.deduplicate(df).collect()}
    assert found == {2: (None, None), 1: (2, 3), 3: (2, 3), 11: (None, None), 12: (11, 4), 13: (11, 4), 14: (None, None), 21: (None, None), 22: (21, 4)}


def test_story_clusters(spark):
    quake = "A strong earthquake shook the northern coast on Friday, damaging homes and closing the harbour for the night."
    rows = [article(1, "Earthquake hits coast", quake), article(2, "Strong earthquake on northern coast", quake + " Rescue teams arrived."), article(3, "Coast quake closes harbour", quake), article(4, "Markets calm", "Shares were flat in quiet trading before the holiday weekend."), article(5, None, None)]
    found = stories.story_clusters(spark.createDataFrame(rows, SCHEMA), threshold=0.4).collect()
    assert len(found) == 1 and found[0].article_ids == "1,2,3" and found[0].source_count == 3 and 0 < found[0].importance <= 1
    assert stories.story_clusters(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_vectors(texts, vocabulary):
    counts = [Counter(stories._TERM.findall(t.lower())) for t in texts]
    df = Counter(w for c in counts for w in c)
    chosen = {w for w, _ in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:vocabulary]}
    n = sum(bool(c) for c in counts)
    for c in counts:
        v = {w: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[w])) + 1) for w, k in c.items() if w in chosen}
        norm = math.sqrt(sum(x * x for x in v.values()))
        yield {w: x / norm for w, x in v.items()}


def plain_stories(vs, threshold):
    """The rule as it is stated: each article against the centroids of all stories before it."""
    sums, out = [], []
    for v in vs:
        if not v:
            out.append((-1, 0.0))
            continue
        sims = [sum(x * c[w] for w, x in v.items()) / math.sqrt(sum(x * x for x in c.values())) for c in sums]
        best = max(range(len(sums)), key=lambda s: sims[s], default=None)
        if best is None or sims[best] <= 0 or sims[best] < threshold:
            best = len(sums)
            sums.append(Counter())
        out.append((best, sims[best] if best < len(sims) else 1.0))
        sums[best].update(v)
    return out


def test_stories_equal_the_sequential_rule():
    rng = random.Random(23)
    words = [a + b for a in "bcdfghjklm" for b in ("ab", "er", "in", "ol", "um", "at", "en", "is", "or", "ut", "al", "ek")]
    texts = ["", "12 !!", *(" ".join(words[int(len(words) * rng.random() ** 2)] for _ in range(rng.randrange(1, 40))) for _ in range(150))]
    for _ in range(150):  # edits of earlier texts, so that stories grow and move
        old = rng.choice(texts).split()
        texts.append(" ".join(rng.choice(words) if rng.random() < rng.choice([0, 0.2, 0.5]) else w for w in old))
    for vocabulary, threshold in itertools.product((60, 4000), (0.0, 0.2, 0.4, 0.55, 0.8, 1.1)):
        found, want = stories.assign(stories.vectors(texts, vocabulary), threshold), plain_stories(plain_vectors(texts, vocabulary), threshold)
        assert [s for s, _ in found] == [s for s, _ in want]
        assert all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(found, want, strict=True))
    assert stories.assign(stories.vectors([]), 0.5) == [] and stories.assign(stories.vectors(["", "?"]), 0.5) == [(-1, 0.0)] * 2


def test_a_large_window_of_stories_takes_seconds():
    rng = random.Random(29)
    name = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:05d}")
    texts = [" ".join(name(int(300 * rng.random() ** 1.5)) for _ in range(90)) + " " + " ".join(name(300 + rng.randrange(3000)) for _ in range(50)) for _ in range(2400)]
    texts += texts[::40]
    began = time.process_time()
    found = stories.assign(stories.vectors(texts), 0.55)
    assert time.process_time() - began < 15
    assert [s for s, _ in found] == [*range(2400), *range(0, 2400, 40)]


def test_keyphrases_and_summary():
    text = "The harbour tunnel project was delayed. The harbour tunnel project needs new funding, engineers warned. Funding talks continue."
    found = enrichment.keyphrases(text, "Harbour tunnel project delayed")
    assert "harbour tunnel project" in found[0][0] and len({p for p, _, _ in found}) == len(found) and found == sorted(found, key=lambda x: -x[1])
    assert enrichment.keyphrases(None) == [] and enrichment.keyphrases("") == [] and enrichment.summary(None) == ""
    long = " ".join(f"Sentence number {k} speaks about the harbour tunnel and its funding in some detail." for k in range(9))
    short = enrichment.summary(long)
    assert short and len(short) <= 600 and short.startswith("Sentence number 0")
    assert enrichment.shorten("word " * 100, 20) == "word word word…"


def test_simhash_bands_are_complete(spark):
    rows = [(i, f"{RNG.getrandbits(64):016x}") for i in range(60)]
    for i in range(60, 120):
        h = int(rows[i - 60][1], 16)
        for b in RNG.sample(range(64), RNG.randrange(6)):
            h ^= 1 << b
        rows.append((i, f"{h:016x}"))
    reps = {}
    for i, h in rows:
        reps.setdefault(h, i)
    ids = sorted((i, int(h, 16)) for h, i in reps.items())
    want = {(a, b) for k, (a, x) in enumerate(ids) for b, y in ids[k + 1 :] if (x ^ y).bit_count() <= 3}
    got = {(r.a, r.b) for r in similarity.simhash_pairs(spark.createDataFrame(rows, "id long, simhash string")).collect()}
    assert got == want


def test_title_pairs_are_complete(spark):
    words = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(RNG.choices(words, k=RNG.randrange(1, 14))) or None) for i in range(120)] + [(200, None), (201, ""), (202, "???")]
    sets = {}
    for i, t in rows:
        s = frozenset((t or "").replace("?", "").split())
        if s:
            sets.setdefault(s, i)
    items = [(i, s) for s, i in sets.items()]
    want = {(min(i, j), max(i, j)) for k, (i, s) in enumerate(items) for j, t in items[k + 1 :] if len(s & t) / len(s | t) >= 0.85}
    got = {(r.a, r.b) for r in similarity.title_jaccard_pairs(spark.createDataFrame(rows, "id long, title string")).collect()}
    assert got == want


def test_members_of_title_classes(spark):
    words = " ".join(f"w{k}" for k in range(10))
    titles = spark.createDataFrame([(5, words), (3, words + " w3!"), (9, words.upper()), (4, words + " more"), (8, "apart"), (7, "?"), (6, None)], "id long, title string")
    found = similarity.class_links(similarity.title_classes(titles), similarity.title_jaccard_pairs(titles))
    assert {tuple(r) for r in found.collect()} == {(3, 3, 3), (5, 3, 3), (9, 3, 3), (4, 4, 3), (8, 8, 0)}


def test_search_escapes_wildcards(spark):
    df = spark.createDataFrame([(1, "100% sure", None, None, False), (2, "100 sure", None, None, False), (3, "a_b", None, None, True), (4, "it's", "x", None, False)], "id long, title string, description string, content string, is_duplicate boolean")
    ids = lambda s: {r.id for r in search.matching(df, s).collect()}
    assert ids(search.SearchQuery(q="100%")) == {1} and ids(search.SearchQuery(q="a_b", include_duplicates=True)) == {3} and ids(search.SearchQuery(q="it's")) == {4}


def test_columns(spark):
    df = spark.createDataFrame([("By Jane Doe, Staff", " Tech ", "en_US", "de", None)], "author string, category string, language string, country string, nothing string")
    r = df.select(C.normalize_author(F.col("author")).alias("a"), C.normalize_category(F.col("category")).alias("c"), C.normalize_language(F.col("language")).alias("l"), C.normalize_country(F.col("country")).alias("k"), C.word_count(F.col("nothing")).alias("w"), C.clamp(F.col("nothing").cast("double")).alias("n")).first()
    assert tuple(r) == ("Jane Doe", "technology", "en", "DE", 0, None)


def test_quality_of_awkward_items(spark):
    cols = "raw_id long, title string, url string, published_at string, description string, content string, author string, image_url string"
    rows = [(1, None, None, None, None, None, None, None), (2, "A fine and proper title", "https://a.example/x", "2024-01-01", "d", "word " * 30, "J", "i"), (3, "CLICK HERE BUY NOW", "https://a.example", "x", "click here", "", "J", "i")]
    found = {r.raw_id: r for r in relevance.with_quality(spark.createDataFrame(rows, cols)).collect()}
    assert found[2].is_valid and found[2].quality == 1.0 and not found[1].is_valid and found[1].quality == 0.0
    assert {"shouting_title", "spam_like"} <= set(found[3].issues)


def test_upsert_keeps_operator_fields(spark):
    target = spark.createDataFrame([("a", 1, "paused"), ("b", 2, "active")], "slug string, weight int, status string")
    updates = spark.createDataFrame([("a", 9, "active"), ("c", 3, "active")], "slug string, weight int, status string")
    assert {tuple(r) for r in links.upsert(target, updates, "slug", keep=("status",)).collect()} == {("a", 9, "paused"), ("b", 2, "active"), ("c", 3, "active")}


def test_ingest_stream_is_idempotent(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    rows = [(k % 7, T0 + timedelta(minutes=k)) for k in range(20)]
    schema = "key long, fetched_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))
    start = lambda c: ingest.ingest(spark.readStream.schema(schema).parquet(str(source)), str(out), str(tmp_path / c), "key").awaitTermination()
    start("c1")
    start("c2")  # everything again
    assert sorted(r.key for r in spark.read.parquet(str(out)).collect()) == list(range(7))


def test_window_stream_equals_batch(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=7 * k), "ab"[k % 2], float(k)) for k in range(40)]
    schema = "ts timestamp, event_type string, value double"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.window_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 hour", "10 minutes")
    stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, windows.window_counts(df, "1 hour").collect()))


def test_cooldown_counts_from_the_last_firing(spark):
    rows = [(1, "2024-01-01 00:59:00"), (1, "2024-01-01 01:01:00"), (1, "2024-01-01 01:59:00"), (1, "2024-01-01 01:59:00"), (2, "2024-01-01 01:00:00"), (None, "2024-01-01 01:00:00"), (3, None)]
    df = spark.createDataFrame(rows, "alert_id long, ts string").selectExpr("alert_id", "cast(ts as timestamp) ts", "1 as fired_at")
    got = sorted((r.alert_id, str(r.fired_at)[11:16], r.matches) for r in ingest.cooled(df, 60).collect())
    assert got == [(1, "00:59", 2), (1, "01:59", 2), (2, "01:00", 1)]
    assert ingest.cooled(df.limit(0), 60).count() == 0


def test_cooldown_over_a_stream(spark, tmp_path):
    source = tmp_path / "matches"
    schema = "alert_id long, ts timestamp"
    for k, times in enumerate((["00:59", "01:01"], ["01:58", "01:59", "03:30"])):
        spark.createDataFrame([(1, f"2024-01-01 {t}:00") for t in times], "alert_id long, ts string").selectExpr("alert_id", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(str(source))
        stream = ingest.cooled_stream(spark.readStream.schema(schema).parquet(str(source)), 60)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(str(r.fired_at)[11:16] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["00:59", "01:59", "03:30"]
