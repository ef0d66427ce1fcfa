"""Story clusters: time-ordered nearest-centroid grouping within bounded windows.

The grouping is sequential by nature, because each article moves the centroid of
the story it joins.  It therefore runs as one grouped-map task per window
(language and two days by default), and windows in parallel.  Within a window
stories out of an article's reach are left out by a bound that loses none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TERM = re.compile(r"[^\W\d_]{2,}")
_NEAR = 1e-9
SCHEMA = "window string, event_key string, title string, size long, source_count long, first_seen timestamp_ntz, last_updated timestamp_ntz, avg_sentiment double, importance double, article_ids string"


class Vectors(NamedTuple):
    """Unit TF-IDF vectors, one after the other; term numbers rise with the number of texts that hold the term."""

    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    size: int


def vectors(texts: Iterable[str], vocabulary: int = 4000) -> Vectors:
    """Unit TF-IDF vectors; ties at the vocabulary limit go by term."""
    number: dict[str, int] = {}
    held, times = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for t in texts:
        c = Counter(_TERM.findall(t.lower()))
        held.append(np.fromiter((number.setdefault(w, len(number)) for w in c), np.int32, len(c)))
        times.append(np.fromiter(c.values(), np.int32, len(c)))
    lengths = np.array([len(x) for x in held[1:]], np.int64)
    terms, counts = np.concatenate(held), np.concatenate(times)
    del held, times
    names, df = list(number), np.bincount(terms, minlength=len(number)).tolist()
    chosen = sorted(range(len(names)), key=lambda k: (-df[k], names[k]))[:vocabulary][::-1]
    place = np.full(len(names), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    n = int((lengths > 0).sum())
    idf = np.array([math.log((1 + n) / (1 + df[k])) + 1 for k in chosen])
    tf = np.array([0.0] + [1 + math.log(k) for k in range(1, counts.max(initial=0) + 1)])
    terms = place[terms]
    owners, counts, terms = np.repeat(np.arange(len(lengths)), lengths)[terms >= 0], counts[terms >= 0], terms[terms >= 0]
    starts = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(lengths)))])
    weights = tf[counts] * idf[terms]
    for a, b in pairwise(starts.tolist()):
        if b > a:
            weights[a:b] /= math.sqrt(sum((weights[a:b] * weights[a:b]).tolist()))
    return Vectors(starts, terms, weights, len(chosen))


def assign(vs: Vectors, threshold: float, common: float = 0.6) -> list[tuple[int, float]]:
    """(story, similarity) of each vector in order: the best story at the threshold, or a new one; (-1, 0) of an empty vector.

    Stories of one article are looked up by their rarer terms alone.  What the common terms can add is at
    most the product of both lengths in them, so a story whose sum stays below the threshold with it is out of reach
    and the others are compared in full.  Terms are common from where they hold ``common`` times the threshold
    of the squares; it decides speed, not results.  Stories of more articles are columns of one matrix.
    """
    starts, terms, weights, size = vs
    bounds = starts.tolist()
    mass = np.cumsum(np.bincount(terms, weights * weights, size)[::-1])[::-1]
    cut = int((mass > common * threshold * (starts[1:] > starts[:-1]).sum()).sum())
    rare = terms < cut
    rest = np.sqrt(np.bincount(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), np.where(rare, 0, weights * weights), len(starts) - 1))
    low = np.concatenate([[0], np.cumsum(np.bincount(terms[rare], minlength=cut))])
    high = low[:-1].copy()
    posted, shares = np.zeros(low[-1], np.int64), np.zeros(low[-1])
    founder, single, lengths = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool), np.zeros(len(starts))
    column: dict[int, int] = {}
    stories: list[int] = []
    sums, norms, orders = np.zeros((size, 16)), np.zeros(16), []
    full = np.zeros(size)
    count, out = 0, []
    for i, (a, b) in enumerate(pairwise(bounds)):
        if a == b:
            out.append((-1, 0.0))
            continue
        w, x = terms[a:b], weights[a:b]
        r, rx = w[rare[a:b]], x[rare[a:b]]
        spans = list(zip(low[r].tolist(), high[r].tolist(), strict=True))
        full[w] = x
        found: list[tuple[float, int]] = []
        if count:
            at = lengths[:count] * rest[i]
            if spans:
                at += np.bincount(np.concatenate([posted[p:q] for p, q in spans]), np.concatenate([shares[p:q] for p, q in spans]) * np.repeat(rx, high[r] - low[r]), count)
            near = np.flatnonzero((at >= threshold - _NEAR) & single[:count])
            if len(near):
                sizes = starts[founder[near] + 1] - starts[founder[near]]
                ends = np.cumsum(sizes)
                of = np.arange(ends[-1]) + np.repeat(starts[founder[near]] - ends + sizes, sizes)
                dots = np.add.reduceat(full[terms[of]] * weights[of], ends - sizes)
                found += zip(dots.tolist(), near.tolist(), strict=True)
        if stories:
            m = len(stories)
            sims = (x @ sums[w, :m]) / norms[:m]
            found += ((sims[k], stories[k]) for k in np.flatnonzero(sims >= max(threshold, sims.max()) - _NEAR).tolist())
        top = max(found, default=(0.0, 0))[0]
        best = (0.0, 0)
        for s in (s for d, s in found if d >= max(threshold, top) - _NEAR):  # with the sums of the rule itself
            if s in column:
                other, norm = sums[w, column[s]], norms[column[s]]
            else:
                p, q = bounds[founder[s]], bounds[founder[s] + 1]
                full[w] = 0
                full[terms[p:q]] = weights[p:q]
                other, norm = full[w], math.sqrt(sum((weights[p:q] * weights[p:q]).tolist()))
                full[terms[p:q]] = 0
            d = 0.0
            for y in (x * other).tolist():
                d += y
            best = max(best, (d / float(norm), -s))
        full[w] = 0
        if best[0] >= threshold and best[0] > 0:
            s = -best[1]
            if s not in column:
                k = column[s] = len(stories)
                stories.append(s)
                single[s] = False
                if k == sums.shape[1]:
                    sums, norms = np.pad(sums, ((0, 0), (0, k))), np.pad(norms, (0, k))
                p, q = bounds[founder[s]], bounds[founder[s] + 1]
                sums[terms[p:q], k] = weights[p:q]
                orders.append(terms[p:q])
            k = column[s]
            orders[k] = np.concatenate([orders[k], w[sums[w, k] == 0]])
            sums[w, k] += x
            norms[k] = math.sqrt(sum((sums[orders[k], k] ** 2).tolist()))
            out.append((s, min(1.0, best[0])))
        else:
            founder[count], single[count], lengths[count] = i, True, rest[i]
            posted[high[r]], shares[high[r]] = count, rx
            high[r] += 1
            out.append((count, 1.0))
            count += 1
    return out


def importance(sources: int, size: int, cohesion: float, sentiment: float) -> float:
    one = lambda x: min(1.0, max(0.0, x))
    return round(one(0.45 * one(math.log1p(sources) / math.log1p(10)) + 0.25 * one(math.log1p(size) / math.log1p(20)) + 0.2 * one(cohesion) + 0.1 * one(abs(sentiment))), 4)


def _cluster(threshold: float, least: int, sources: int):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["published_at", "id"]).reset_index(drop=True)
        placed = assign(vectors(df["text"]), threshold)
        df["story"], df["sim"] = [s for s, _ in placed], [x for _, x in placed]
        df = df[df["story"] >= 0]
        df = df[df.groupby("story")["story"].transform("size") >= least]
        rows = []
        for _, g in df.groupby("story", sort=True):
            if g["source_name"].nunique() < sources:
                continue
            title = min(g["title"], key=len)
            sentiment = float(g["sentiment_score"].fillna(0).mean())
            key = hashlib.sha256(f"{g['id'].iloc[0]}|{title.casefold()}".encode()).hexdigest()[:40]
            rows.append((g["window"].iloc[0], key, title, len(g), g["source_name"].nunique(), g["published_at"].min(), g["published_at"].max(), sentiment, importance(g["source_name"].nunique(), len(g), float(g["sim"].mean()), sentiment), ",".join(map(str, g["id"]))))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def story_clusters(articles: DataFrame, threshold: float = 0.55, least: int = 2, sources: int = 2, days: int = 2) -> DataFrame:
    """Stories of at least ``least`` articles from ``sources`` sources, per language and window of ``days``."""
    number = F.floor(F.datediff(F.to_date("published_at"), F.lit("1970-01-01").cast("date")) / days)
    window = F.concat_ws("|", F.coalesce("language", F.lit("")), number.cast("string"))
    text = F.concat_ws(" ", "title", "title", F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " "), F.substring(F.coalesce("content", "description", F.lit("")), 1, 1500))
    rows = articles.where(~F.col("is_duplicate") & F.col("title").isNotNull() & F.col("published_at").isNotNull()).select("id", "title", "source_name", "published_at", "sentiment_score", window.alias("window"), text.alias("text"))
    return rows.groupBy("window").applyInPandas(_cluster(threshold, least, sources), SCHEMA)
