"""Per-document text operators: keyphrases, summaries, readability.

Readability is an expression; the others run in one Arrow stage.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.columns import clamp, round4

# English function words.
STOPWORDS = frozenset(
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further "
    "had has have having he her here hers him his how i if in into is it its just me more most my no nor not of off on once only or other our out over own same she should so some such than that the "
    "their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)
# Words of news prose that say little.
NEWS_WORDS = frozenset(
    "said says say told reported report reports according news article read update updated monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "year years month months week weeks day days today yesterday tomorrow time times people man woman men women thing things way ways percent per cent million billion trillion first second third last next previous".split()
)
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_PHRASE_END = re.compile(r"[.!?;:,()\[\]{}\"“”«»\n\r\t|/]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"'(])")


def keyphrases(text: str | None, title: str | None = None, limit: int = 12, least: float = 1.0) -> list[tuple[str, float, int]]:
    """(phrase, score, count): runs of content words, scored by how much longer phrases their words stand in.

    The title counts twice.  A phrase is skipped when the better ones already
    hold all its words.
    """
    corpus = f"{title}. {title}. {text or ''}" if title else text or ""
    phrases: list[tuple[str, ...]] = []
    for chunk in _PHRASE_END.split(corpus):
        run: list[str] = []
        for w in [*_WORD.findall(chunk.casefold()), ""]:
            content = len(w) >= 3 and not w.isdigit() and w not in STOPWORDS and w not in NEWS_WORDS
            if content:
                run.append(w)
            if run and (not content or len(run) == 4):
                phrases.append(tuple(run))
                run = []
    count, degree = Counter(w for p in phrases for w in p), Counter()
    for p in phrases:
        for w in p:
            degree[w] += len(p)
    score = {p: sum(degree[w] / count[w] for w in p) for p in phrases}
    often = Counter(phrases)
    chosen: list[tuple[str, float, int]] = []
    seen: set[str] = set()
    for p in sorted(score, key=lambda p: -score[p]):
        if len(chosen) == limit or score[p] < least:
            break
        if not seen.issuperset(p):
            chosen.append((" ".join(p), round(score[p], 4), often[p]))
            seen.update(p)
    return chosen


def shorten(text: str, limit: int) -> str:
    """Cut at a space, if one stands late enough, with an ellipsis."""
    text = text.strip()
    if len(text) <= limit:
        return text
    cut = text[: limit - 1].rstrip()
    space = cut.rfind(" ")
    return (cut[:space] if space > 0.6 * limit else cut).rstrip() + "…"


def summary(text: str | None, title: str | None = None, sentences: int = 3, chars: int = 600) -> str:
    """The most telling sentences in their order."""
    if not text or not text.strip():
        return ""
    parts = [s for x in _SENTENCE.split(text.replace("\n", " ")) if 40 <= len(s := x.strip()) <= 400]
    if len(parts) <= sentences:
        return shorten(" ".join(parts) or text, chars)
    tokens = lambda s: [w for w in re.findall(r"[^\W\d_]{2,}", s.casefold()) if w not in STOPWORDS]
    counts = Counter(tokens(text))
    top = 1 + math.log(max(counts.values(), default=1))
    wanted = set(tokens(title or ""))

    def value(k: int) -> float:
        ws = tokens(parts[k])
        if not ws:
            return -1.0
        weight = sum((1 + math.log(counts[w])) / top for w in ws) / math.sqrt(len(ws))
        shared = len(wanted & set(ws)) / len(wanted) if wanted else 0.0
        return weight * (1 - 0.5 * k / len(parts)) * (1 + 0.6 * shared)

    best = sorted(sorted(range(len(parts)), key=lambda k: (-value(k), k))[:sentences])
    return shorten(" ".join(parts[k] for k in best), chars)


def _enrich(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrase = pa.struct([("text", pa.string()), ("score", pa.float64()), ("frequency", pa.int64())])
    for batch in it:
        pairs = list(zip(batch.column("title").to_pylist(), batch.column("content").to_pylist(), strict=True))
        found = [[{"text": p, "score": s, "frequency": n} for p, s, n in keyphrases(c, t)] for t, c in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(phrase)), pa.array([summary(c, t) for t, c in pairs], pa.string())], names=["id", "keyphrases", "summary"])


def enrich(articles: DataFrame) -> DataFrame:
    """(id, keyphrases, summary) of (id, title, content)."""
    return articles.select("id", "title", "content").mapInArrow(_enrich, "id long, keyphrases array<struct<text:string,score:double,frequency:long>>, summary string")


def readability(text: Column) -> Column:
    """Reading ease in [0, 1]; null for fewer than 100 characters or 20 words."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}]", ""))
    groups = lambda w: F.regexp_count(w, F.lit("[aeiouy]+"))
    syllables = F.aggregate(bare, F.lit(0), lambda acc, w: acc + F.when(w == "", 0).otherwise(F.greatest(F.lit(1), groups(w) - F.when(w.endswith("e") & (groups(w) > 1), 1).otherwise(0))))
    n = F.size(words)
    ends = F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]")))
    ease = (206.835 - 1.015 * (n / ends) - 84.6 * (syllables / F.greatest(n, F.lit(1)))) / 100.0
    return F.when((F.char_length(text) >= 100) & (n >= 20), round4(clamp(ease)))
