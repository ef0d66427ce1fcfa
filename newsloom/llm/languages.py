"""Problem 7: missing or wrong language labels, by compression classification.

A language is a raw-content zstandard dictionary.  A text belongs to the
language whose dictionary compresses it to the fewest bytes; where the margin to
the next one is narrow, the decision is rejected (``und``).  Documents and, for
mixed ones, their lines are classified the same way.

The dictionaries are fitted on a bounded sample of labelled rows
(``fit_rows``).  Labels are unreliable, so that the fit runs twice: dictionaries
of the labelled texts decide which texts keep their label and which lines belong
to which language, and the final dictionaries are made of those lines.  Names
say nothing about a language: words that the sample holds rarely, or in several
languages alike, are left out of the dictionaries, so that they cost the same in
each.

Defined results: null, empty and letterless content has no language; markup
(``<...>``) is not counted; texts are used whole; unknown labels count as none.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from newsloom.io import hash_sample

_TAG = re.compile(r"<[^>]*>")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_SPACES = re.compile(r"\s+")
_PHRASE = re.compile(r"\0+(?:[\W_]*\0+)*|(?<=[.!?]) ")
LANGUAGES = ("en", "de", "fr", "es", "pt")

# What sources write for the languages that occur.
_LABELS = {
    "en": "en eng english englisch anglais inglés ingles inglês",
    "de": "de ger deu german deutsch allemand alemán aleman alemão alemao",
    "fr": "fr fra fre french français francais französisch francés frances francês",
    "es": "es spa spanish español espanol castellano spanisch espagnol espanhol",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués",
}
LABELS = {name: code for code, names in _LABELS.items() for name in names.split()}


def label_code(label: str | None) -> str | None:
    """The language a label names: codes of two or three letters, regions, words; None for none."""
    text = (label or "").strip().lower()
    return LABELS.get(text) or LABELS.get(re.split(r"[-_\s(]", text, maxsplit=1)[0])


@dataclass(frozen=True)
class LanguageParams:
    fit_rows: int = 2500
    corrections: int = 3
    shared_from: int = 5
    #: A word or phrase is a language's if that share of its rates falls on it; names fall on all alike.
    own_share: float = 0.42
    dictionary_bytes: int = 24 << 10
    search_log: int = 4
    #: A line counts as another language's if that dictionary saves this share against all others.
    line_margin: float = 0.115
    #: Below this margin between the best two, a text has no certain language.
    narrow: float = 0.02
    line_letters: int = 40
    memo: int = 50_000


def letters(text: str) -> int:
    return sum(map(len, _LETTERS.findall(text)))


def plain(text: str) -> str:
    """What is compressed: without markup, in lower case, numbers and spacing evened."""
    return _SPACES.sub(" ", _DIGITS.sub("0", _TAG.sub(" ", text).lower())).strip()


class Classifier:
    """Compressed sizes under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], p: LanguageParams, effort: str = "usual") -> None:
        self.p = p
        self.memo: dict[str, dict[str, int]] = {}
        self.by = {}
        for lang, data in dictionaries.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            if effort == "low":
                d.precompute_compress(level=3)
                self.by[lang] = zstandard.ZstdCompressor(dict_data=d, level=3, write_content_size=False, write_dict_id=False)
                continue
            strategy = zstandard.STRATEGY_BTOPT if effort == "high" else zstandard.STRATEGY_LAZY2
            how = zstandard.ZstdCompressionParameters(
                window_log=17, hash_log=13, chain_log=13, search_log=p.search_log, min_match=3, target_length=24, strategy=strategy, write_content_size=False, write_dict_id=False
            )
            d.precompute_compress(compression_params=how)
            self.by[lang] = zstandard.ZstdCompressor(dict_data=d, compression_params=how)
        self.empty = {lang: len(z.compress(b"")) for lang, z in self.by.items()}

    def sizes(self, text: str) -> dict[str, int]:
        if text in self.memo:
            return self.memo[text]
        data = text.encode(errors="replace")
        found = {lang: len(z.compress(data)) - self.empty[lang] + 1 for lang, z in self.by.items()}
        if len(self.memo) >= self.p.memo:
            self.memo.clear()
        self.memo[text] = found
        return found

    @staticmethod
    def best(sizes: dict[str, int]) -> tuple[str, float]:
        """(language, margin): the share that the best saves against the next."""
        order = sorted(sizes.items(), key=lambda x: (x[1], x[0]))
        return order[0][0], 1 - order[0][1] / order[1][1] if len(order) > 1 else 1.0

    def segments(self, content: str) -> list[tuple[int, str, float]]:
        """(0, main language, confidence), then (line_no, language, confidence) of lines in another one."""
        if not self.by or not letters(_TAG.sub("", content)):
            return []
        lines = []
        total: Counter[str] = Counter()
        votes: Counter[str] = Counter()
        for no, line in enumerate(content.split("\n"), 1):
            n = letters(_TAG.sub("", line))
            if n >= self.p.line_letters:
                sizes = self.sizes(plain(line))
                lines.append((no, sizes))
                total.update(sizes)
                lang, gap = self.best(sizes)
                if gap >= self.p.narrow:
                    votes[lang] += n
        if not votes:
            total = Counter(self.sizes(plain(content)))
        whole, margin = self.best(total)
        main = max(votes, key=lambda x: (votes[x], x == whole, x)) if votes else whole
        confidence = votes[main] / votes.total() if votes else margin
        out = [(0, main if votes or margin >= self.p.narrow else "und", round(min(1.0, max(0.0, confidence)), 4))]
        for no, sizes in lines:
            lang, gap = self.best(sizes)
            if lang != main and gap >= self.p.line_margin:
                out.append((no, lang, round(gap, 4)))
        return out


def _dictionary(lines: list[str], size: int) -> bytes:
    """The first lines that fit; the most telling ones stand last, nearest to the text."""
    out, n = [], 0
    for line in lines:
        data = line.encode(errors="replace")
        if n + len(data) + 1 <= size:
            out.append(data)
            n += len(data) + 1
    return b"\n".join(reversed(out))


def _spoken(samples: list[tuple[str, list[str]]], p: LanguageParams) -> set[str]:
    """Words that belong to a language: common enough, and not spread over all of them as names are."""
    docs = Counter(lang for lang, _ in samples)
    seen: dict[str, Counter] = defaultdict(Counter)
    for lang, lines in samples:
        for w in {w for line in lines for w in _LETTERS.findall(line)}:
            seen[w][lang] += 1
    out = set()
    for w, by in seen.items():
        rates = [n / docs[lang] for lang, n in by.items()]
        if by.total() > 3 and max(rates) >= 0.01 and (max(rates) >= p.own_share * sum(rates) or len(w) < 4):
            out.add(w)
    return out


def _most(counts: Counter) -> list[str]:
    return [x for x, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]


def fit(samples: list[tuple[str, str]], p: LanguageParams = LanguageParams()) -> dict[str, bytes]:
    """Dictionaries from (language, text) pairs; a language without texts gets none.

    First, dictionaries of whole long lines correct the labels.  Then lines are
    cut into phrases where a word belongs to no language; a phrase is given to
    the language whose documents carry it most, and taken by how much of them it
    makes.
    """
    parsed = [(lang, [x for x in map(plain, t.split("\n")) if x]) for lang, t in samples]
    texts = [(lang, " ".join(sorted(lines, key=len)[-3:])) for lang, lines in parsed]
    labels = [lang for lang, _ in parsed]
    for turn in range(p.corrections + 1):
        raw: dict[str, list[str]] = defaultdict(list)
        for lang, (_, text) in zip(labels, texts, strict=True):
            raw[lang].append(text)
        rough = Classifier({lang: _dictionary(ts, p.dictionary_bytes * (2 if turn else 1)) for lang, ts in sorted(raw.items())}, p, "low")
        if len(rough.by) < 2:
            return {lang: _dictionary(ts, p.dictionary_bytes) for lang, ts in raw.items()}
        labels = [rough.best(rough.sizes(text))[0] for _, text in texts]
    sure = [(lang, lines) for lang, (_, lines) in zip(labels, parsed, strict=True)]
    spoken = _spoken(sure, p)
    gap = lambda m: m[0] if m[0] in spoken else "\0"
    docs = Counter(lang for lang, _ in sure)
    carriers: dict[str, Counter] = defaultdict(Counter)
    for lang, lines in sure:
        for x in {y.strip() for line in lines for y in _PHRASE.split(_LETTERS.sub(gap, line)) if letters(y) >= 4}:
            carriers[x][lang] += 1
    own: dict[str, Counter] = defaultdict(Counter)
    for x, mains in carriers.items():
        rates = {lang: n / docs[lang] for lang, n in mains.items()}
        home = max(rates, key=lambda lang: (rates[lang], lang))
        if mains.total() > 1 and rates[home] >= p.own_share * sum(rates.values()):
            own[home][x] = mains[home] * len(x)
    made = {lang: _dictionary(_most(own[lang]), p.dictionary_bytes) for lang in sorted(own)}
    # Lines that stand in documents of all languages alike: what they say decides.
    shared = Counter(line for _, lines in sure for line in set(lines))
    second = Classifier(made, p, "high")
    for line, n in shared.items():
        if n >= p.shared_from:
            sizes = second.sizes(line)
            lang, gap = second.best(sizes)
            if 0 < gap and sizes[lang] > 0.5 * len(line):
                own[lang][line] = n * len(line)
    return {lang: _dictionary(_most(own[lang]), p.dictionary_bytes) for lang in sorted(own)}


@dataclass
class _Worker:
    dictionaries: dict[str, bytes]
    p: LanguageParams

    def __call__(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(self.dictionaries, self.p)
        for batch in it:
            rows = [
                (i, label_code(label), *s)
                for i, label, content in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "content")), strict=True)
                if content
                for s in classify.segments(content)
            ]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "labelled", "line_no", "lang", "confidence"])


def sample(documents: DataFrame, p: LanguageParams) -> list[tuple[str, str]]:
    """At most ``fit_rows`` labelled texts, chosen by a hash of the id."""
    rows = hash_sample(documents.where("label is not null and trim(label) <> ''"), "id", p.fit_rows).where("content <> ''").select("label", "content")
    return [(code, r["content"]) for r in rows.toArrow().to_pylist() if (code := label_code(r["label"]))]


def languages(documents: DataFrame, p: LanguageParams = LanguageParams(), dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """(id, labelled, line_no, lang, confidence) of documents (id, label, content).

    One row with line_no 0 for each document with letters, holding its main
    language, and one for each long enough line in another language; ``labelled``
    is the language that the label names, or null.
    """
    documents = documents.where("id is not null").select("id", "label", "content")
    dictionaries = dictionaries or fit(sample(documents, p), p)
    return documents.where("content <> ''").mapInArrow(_Worker(dictionaries, p), "id long, labelled string, line_no long, lang string, confidence double")


def wrong_labels(found: DataFrame) -> DataFrame:
    """Documents whose label does not name their main language, and lines in other languages."""
    return found.where("line_no > 0 or lang <> 'und' and (labelled is null or labelled <> lang)").select("id", "line_no", "lang")
