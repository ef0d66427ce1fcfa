"""Problem 2: text cut off by field limits, by a corpus vocabulary trie.

A value is read from its end, and four kinds of evidence are gathered:

* the trie: its final token is no word of the corpus elsewhere but a proper
  prefix of words;
* the length: it stands out among the lengths of its source's field, as those of
  cut values do;
* a mark that the cut added, or markup that is still open;
* an open *tail*, the words after the last finished sentence.

Trie and length come first and name the reason; a mark or open markup decides
alone as well, for many cuts fall between two words, where no trie can show them.
A tail decides unless it is explained: it is the title, a credit with the
source's name, a phrase (a reading prompt, a line below the article) that values
of many different titles end with and that begins no longer sentence, or a line
of page furniture, such as the headlines of a ranking.  Those end without a full
stop too; there only trie and length decide.

The trie is a table of nodes: the proper prefixes of corpus words with the number
of words below each, as far as they are as long as some final token, joined with
the final tokens; it is never collected.  Vocabulary, phrase and length counts
cover all values.

Defined results: null, empty and blank values are neither cut nor complete and
give no row; rows without an id are ignored; a null title or source explains
nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.io import keep

_TAG = re.compile(r"<[^>]*>")
_TAGS = re.compile(r"<(/?)([a-zA-Z][\w-]*)[^>]*?(/?)>")
_LETTERS = re.compile(r"[^\W\d_]+")
_DONE = re.compile(r"[.!?][\"'”’»«“›)\]]*(?:\s+[»«”“›]+)?(?=\s|$)")
_MARK = re.compile(r"(?:…|\.{3,}|\[\s*(?:…|\.{2,}|\+\s*\d+\s*\w*)\s*\]|�|\(\s*\.{3}\s*\))[\s»”\"')\]]*$")
_RANK = re.compile(r"\s*\d{1,3}[.)]\s")
_TOKEN = re.compile(r"[^\W_]+")
_VOID = frozenset("br hr img input meta link source wbr".split())


@dataclass(frozen=True)
class CutParams:
    least_titles: int = 6
    prompt_words: int = 4
    #: A length is a limit if so many open ends of one source's field share it.
    least_length: int = 5
    #: ... and so many times as many as a length nearby has on average, so that
    #: a large source's ordinary lengths are none.
    length_ratio: float = 4.0
    length_span: int = 25
    #: A label before a colon is so short, and so are the lines of a list.
    label_chars: int = 40
    list_line_chars: int = 110


def _hash(*parts: str) -> int:
    h = xxhash.xxh64_intdigest("\0".join(parts))
    return h - (1 << 64) if h >> 63 else h


def _key(text: str) -> str:
    return " ".join(_LETTERS.findall(text)).lower()


def open_markup(text: str) -> bool:
    """A tag is not finished, or an element is still open at the end."""
    last = text.rfind("<")
    if last >= 0 and ">" not in text[last:] and re.match(r"<(?:/?[a-zA-Z][^<]*)?$|<$", text[last:]):
        return True
    stack: list[str] = []
    for close, name, void in _TAGS.findall(text):
        name = name.lower()
        if close:
            if name in stack:
                while stack and stack.pop() != name:
                    pass
        elif not void and name not in _VOID:
            stack.append(name)
    return bool(stack)


def read_end(value: str, title: str, source: str) -> tuple[str, str, str, str]:
    """(verdict, tail, last line, line before): verdict is 'cut', 'complete', 'mark' or 'tail'."""
    if "<" in value and open_markup(value):
        return "cut", "", "", ""
    if value.rstrip().endswith(">") and _TAGS.search(value):
        return "complete", "", "", ""
    lines = (x for x in (html.unescape(_TAG.sub("", y)).strip() if "<" in y or "&" in y else y.strip() for y in reversed(value.rstrip().split("\n"))) if x)
    last, before = next(lines, ""), next(lines, "")
    if not last:
        return "complete", "", "", ""
    mark = _MARK.search(last)
    if mark:
        return "mark", last[: mark.start()].rstrip(), last, before
    end = None
    for end in _DONE.finditer(last):
        pass
    tail = last[end.end() :] if end else last
    key = _key(tail)
    if not key and (end or not _key(last)):
        return ("tail", tail, last, before) if re.search(r"\d", tail) else ("complete", "", last, before)
    titled, named, whole = _key(title), _key(source), _key(last)
    if titled and whole in (titled, f"{titled} {named}".strip(), f"{named} {titled}".strip()):
        return "complete", "", last, before
    if named and titled.endswith(" " + named) and whole == titled.removesuffix(" " + named):
        return "complete", "", last, before
    if named and key.endswith(named) and tail.rstrip(" )]»”\"-").lower().endswith(source.strip().lower()[-3:]):
        return "complete", "", last, before
    return "tail", tail, last, before


_ENDS = "id long, field string, source string, verdict string, tail long, label long, words int, listed boolean, token string, chars int, about long"


def _reader(p: CutParams):
    return lambda it: (_ends(batch, p) for batch in it)


def _ends(batch: pa.RecordBatch, p: CutParams) -> pa.RecordBatch:
    rows = []
    for i, field, source, name, title, value in zip(*(batch.column(c).to_pylist() for c in ("id", "field", "source", "source_name", "title", "value")), strict=True):
        if not value or not value.strip():
            continue
        name = (name or "").strip()
        verdict, tail, last, before = read_end(value, title or "", name)
        label, colon, rest = last.partition(":")
        masked = _key(tail.replace(name, "#")) if name else _key(tail)
        # A line among short ones is part of a list, not of the text.
        listed = bool(_RANK.match(last)) or bool(before) and len(before) < p.list_line_chars and len(last) < p.list_line_chars and not _DONE.search(before[-4:]) and not _DONE.search(last)
        open_end = {"tail": last, "mark": tail}.get(verdict, "")
        tokens = _TOKEN.findall(open_end)
        token = tokens[-1].lower() if tokens and open_end.rstrip("»«\"'” -").endswith(tokens[-1]) else None
        rows.append((i, field, source, verdict, _hash("tail", masked), _hash("label", _key(label)) if colon and rest.strip() and len(label) <= p.label_chars else None, len(masked.split()), listed, token, len(value), _hash("title", _key(title or ""))))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 11
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in _ENDS.split(", ")])


def _vocabulary(p: CutParams):
    """Words with counts, and hashed sentence beginnings of up to ``prompt_words`` words, per batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            words: Counter[str] = Counter()
            starts: Counter[str] = Counter()
            for value in batch.column("value").to_pylist():
                if not value:
                    continue
                text = (_TAG.sub(" ", value) if "<" in value else value).lower()
                words.update(_TOKEN.findall(text))
                for sentence in re.split(r"[.!?\n]+\s*", text):
                    first = [m[0] for m in islice(_LETTERS.finditer(sentence), p.prompt_words + 1)]
                    starts.update(" ".join(first[:k]) for k in range(1, len(first)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*words, *[None] * len(starts)], pa.string()),
                    pa.array([*[None] * len(words), *(_hash("tail", s) for s in starts)], pa.int64()),
                    pa.array([*words.values(), *starts.values()], pa.int64()),
                ],
                names=["word", "start", "n"],
            )

    return run


def value_ends(records: DataFrame, p: CutParams = CutParams()) -> DataFrame:
    """How each value of (id, field, source, source_name, title, value) ends."""
    records = records.where("id is not null and value is not null").select("id", "field", "source", "source_name", "title", "value")
    return records.mapInArrow(_reader(p), _ENDS)


def trie_evidence(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, known, below): whether a token is a word elsewhere, and how many corpus words it begins.

    ``tokens`` (token, ends): final tokens and how often they end a value;
    ``vocabulary`` (word, n).
    """
    # Only nodes as deep as some token ends are spelled out: one small row of lengths.
    depths = tokens.agg(F.coalesce(F.collect_set(F.char_length("token")), F.array()).alias("depths"))
    deep = vocabulary.crossJoin(F.broadcast(depths)).select("word", F.explode(F.filter("depths", lambda k: k < F.char_length("word"))).alias("depth"))
    nodes = deep.select(F.expr("left(word, depth)").alias("token"))
    below = nodes.join(tokens.select("token"), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("below"))
    known = vocabulary.select(F.col("word").alias("token"), "n")
    joined = tokens.join(known, "token", "left").join(below, "token", "left")
    return joined.select("token", (F.coalesce("n", F.lit(0)) > F.col("ends")).alias("known"), F.coalesce("below", F.lit(0)).alias("below"))


def limit_lengths(ends: DataFrame, p: CutParams) -> DataFrame:
    """(source, field, chars, same_length) of the lengths that stand out among the open ends of one source's field.

    What a length has by chance is read from the lengths on either side, without
    the largest one there (it may be a limit too); the denser side counts.
    """
    counts = ends.where("verdict in ('tail', 'mark')").groupBy("source", "field", "chars").agg(F.count(F.lit(1)).alias("same_length"))
    near = Window.partitionBy("source", "field").orderBy("chars")

    def chance(first: int, last: int) -> Column:
        side = near.rangeBetween(first, last)
        return F.coalesce((F.sum("same_length").over(side) - F.max("same_length").over(side)) / (p.length_span - 1), F.lit(0.0))

    expected = counts.withColumn("chance", F.greatest(chance(-p.length_span, -1), chance(1, p.length_span)))
    stands_out = (F.col("same_length") >= p.least_length) & (F.col("same_length") >= p.length_ratio * (F.col("chance") + 1))
    return expected.where(stands_out).drop("chance")


def cut_values(records: DataFrame, p: CutParams = CutParams()) -> DataFrame:
    """(id, field, source, is_cut, reason) of every value that is not blank."""
    ends = keep(value_ends(records, p), "p2-ends")
    counts = keep(records.select("value").where("value is not null").mapInArrow(_vocabulary(p), "word string, start long, n long").groupBy("word", "start").agg(F.sum("n").alias("n")), "p2-vocabulary")
    tails = ends.where("verdict = 'tail'")

    def recurring(column: str) -> DataFrame:
        each = tails.where(F.col(column).isNotNull()).groupBy(column, "about").agg(F.count(F.lit(1)).alias("m"))
        return each.groupBy(column).agg(F.count(F.lit(1)).alias(f"{column}_titles")).where(F.col(f"{column}_titles") >= p.least_titles)

    starts = counts.where("start is not null").select(F.col("start").alias("tail"), F.col("n").alias("starts"))
    tokens = ends.where("token is not null").groupBy("token").agg(F.count(F.lit(1)).alias("ends"))
    trie = trie_evidence(tokens, counts.where("word is not null").select("word", "n"))
    lengths = limit_lengths(ends, p)
    phrases = recurring("tail").join(starts, "tail", "left")
    joined = (
        ends.join(phrases, "tail", "left")
        .join(recurring("label"), "label", "left")
        .join(trie, "token", "left")
        .join(lengths.withColumnRenamed("source", "s").withColumnRenamed("field", "f").withColumnRenamed("chars", "c"), F.expr("source <=> s and field = f and chars = c"), "left")
    )
    phrase = F.col("tail_titles").isNotNull() & (F.col("words") > 0) & ((F.col("words") > p.prompt_words) | (F.coalesce("starts", F.lit(0)) <= F.col("tail_titles") * 0.5))
    half_word = ~F.coalesce("known", F.lit(True)) & (F.coalesce("below", F.lit(0)) > 0)
    limit = F.col("same_length").isNotNull()
    explained = phrase | F.col("listed") | F.col("label_titles").isNotNull()
    reason = (
        F.when(F.col("verdict") == "complete", None)
        .when((F.col("verdict") == "tail") & phrase, None)
        .when(F.col("verdict").isin("tail", "mark") & half_word, "word")
        .when(F.col("verdict").isin("tail", "mark") & limit, "length")
        .when(F.col("verdict") == "cut", "markup")
        .when(F.col("verdict") == "mark", "mark")
        .when(~explained, "sentence")
    )
    return joined.select("id", "field", "source", reason.isNotNull().alias("is_cut"), reason.alias("reason"))


def cut_rates(cuts: DataFrame) -> DataFrame:
    """(source, field, stored, cut, rate): how often each source truncates each field."""
    return cuts.groupBy("source", "field").agg(F.count(F.lit(1)).alias("stored"), F.count_if("is_cut").alias("cut")).select("source", "field", "stored", "cut", (F.col("cut") / F.col("stored")).alias("rate"))
