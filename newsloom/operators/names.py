"""Named entities: capitalised runs of tokens, told apart by a table of rules.

A text is a row of tokens with the sign that ends each.  Neighbouring capitalised
tokens make a name (small connecting words may stand between them); a name ends
with its sentence unless its last token is a known abbreviation.  What a name is
follows from the first rule of ``RULES`` that holds: a rule says where to look
(inside the name, before it, after it), for which words, and the kind.

Defined results: null and empty texts have no names; names in the title count
twice; ties in mentions are ordered by name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.functions import lexicons as L

_SIGNS = re.compile(r"^[^\w&]+|[^\w&]+$")
_DATES = frozenset("monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split())
_LINKS = frozenset("of de del van der &".split())
_LONGEST_NAME = 5


@dataclass(frozen=True)
class Token:
    word: str
    capital: bool
    #: The name may not go on behind it, and the next token opens a sentence.
    ends: bool
    breaks: bool


def tokenise(text: str) -> list[Token]:
    out = []
    for raw in text.split():
        word = _SIGNS.sub("", raw)
        if not word:
            continue
        tail = raw[raw.rfind(word[-1]) + 1 :]
        stop = any(c in tail for c in ".!?") and word not in L.ABBREVIATIONS
        out.append(Token(word, word[0].isupper(), stop, stop or bool(tail.strip(".")) or not raw.startswith(word)))
    return out


@dataclass(frozen=True)
class Name:
    words: tuple[str, ...]
    before: str
    after: str
    opens: bool  # its first token opens a sentence


def spans(tokens: list[Token]) -> Iterator[Name]:
    k = 0
    while k < len(tokens):
        if not tokens[k].capital:
            k += 1
            continue
        end = k + 1
        while end < len(tokens) and not tokens[end - 1].breaks and end - k < _LONGEST_NAME:
            if tokens[end].capital:
                end += 1
            elif tokens[end].word in _LINKS and end + 1 < len(tokens) and tokens[end + 1].capital:
                end += 2
            else:
                break
        around = (tokens[k - 1].word if k else "", tokens[end].word if end < len(tokens) and not tokens[end - 1].ends else "")
        yield Name(tuple(t.word for t in tokens[k:end]), *around, k == 0 or tokens[k - 1].ends)
        k = end


#: (where, words, most words of the name, kind), the first that holds.
RULES: tuple[tuple[str, frozenset[str], int, str], ...] = (
    ("inside", L.ORG_WORDS, _LONGEST_NAME, "organization"),
    ("before", L.PERSON_TITLES, _LONGEST_NAME, "person"),
    ("after", L.PERSON_VERBS, _LONGEST_NAME, "person"),
    ("before", L.PLACE_WORDS, 2, "location"),
)


def kind_of(name: Name, known: dict[str, str]) -> str:
    """By the gazetteer, else the first rule, else the shape: two words name a person, capitals an organisation."""
    if (found := known.get(" ".join(name.words))) is not None:
        return found
    places = {"inside": set(name.words), "before": {name.before, name.before.lower()}, "after": {name.after}}
    for where, words, most, kind in RULES:
        if len(name.words) <= most and not words.isdisjoint(places[where]):
            return kind
    if len(name.words) == 2 and all(w.isalpha() for w in name.words):
        return "person"
    return "organization" if "".join(name.words).isupper() else "other"


def _is_name(name: Name, known: dict[str, str]) -> bool:
    first, *rest = name.words
    if " ".join(name.words) in known:
        return True
    if not rest:
        common = first in L.SENTENCE_STARTERS or first in L.PERSON_TITLES or first.lower() in _DATES
        return len(first) > 1 and not common and (first.isupper() or not name.opens)
    return not (len(rest) == 1 and first in L.SENTENCE_STARTERS and rest[0] in L.SENTENCE_STARTERS)


def entities(text: str | None, title: str | None = None, known: dict[str, str] | None = None, limit: int = 30) -> list[tuple[str, str, int, float]]:
    """(name, kind, mentions, salience) of the most mentioned names; ``limit`` is the reference's report size."""
    known = known or {}
    counts: Counter[tuple[str, str]] = Counter()
    spelled: dict[tuple[str, str], Counter] = defaultdict(Counter)
    for part, weight in ((title, 2), (text, 1)):
        for name in spans(tokenise(part or "")):
            if name.words[0] in ("The", "A", "An") and len(name.words) > 1:
                name = Name(name.words[1:], name.words[0], name.after, False)
            if _is_name(name, known):
                key = (" ".join(name.words).casefold(), kind_of(name, known))
                counts[key] += weight
                spelled[key][" ".join(name.words)] += 1
    total = counts.total()
    order = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    return [(spelled[k].most_common(1)[0][0], k[1], n, round(n / total, 4)) for k, n in order[:limit]]


def _worker(known: dict[str, str]):
    entity = pa.struct([("name", pa.string()), ("kind", pa.string()), ("mentions", pa.int64()), ("salience", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [entities(c, t, known) for t, c in zip(batch.column("title").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            rows = [[dict(zip(("name", "kind", "mentions", "salience"), e, strict=True)) for e in own] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(entity))], names=["id", "entities"])

    return run


def named_entities(articles: DataFrame, gazetteer: dict[str, str] | None = None) -> DataFrame:
    """(id, entities) of (id, title, content); the gazetteer (name -> kind) is a bounded parameter."""
    schema = "id long, entities array<struct<name:string,kind:string,mentions:long,salience:double>>"
    return articles.select("id", "title", "content").mapInArrow(_worker(gazetteer or {}), schema)
