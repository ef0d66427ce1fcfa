"""Problem 6: page boilerplate mixed with main content, by tree scoring.

A page is read into a tree of elements whose leaves are *segments*: texts between
block-level tags or line ends, however many elements stand in one line.  An
element around a single segment belongs to the leaf; one around several is a
*box*.  Within a box, consecutive leaves form *regions*, which furniture parts
and insertions (adverts and pointers inside the text) do not.

Paragraphs give points for length and commas, less their share of link letters
(``<a>``), to their region, half of them to the box, a quarter to its parent and
so on; a region's points are discounted by its link density, the share of its
letters that are links, furniture or no paragraph.  The region with the best
score of its own and of its ancestors is kept, with its siblings: regions in
boxes of the same kind under the same parent that reach ``sibling_share`` of its
points and are no links.

Pages without links still have furniture, which is found in the corpus: a line,
its label before a colon, its last sentence or its class counts as furniture if
the pages of ``least_titles`` different articles carry it.  The same counts tell
insertions from what ends a text.  The counts are joined, never collected or
broadcast.

Subheads are the short lines between paragraphs of the kept regions; a last line
that the page's end cut off is kept too.  Defined results: null and empty pages
have no lines; a page without a paragraph keeps nothing; rows without an id are
ignored; lines are numbered from 1, empty ones included.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.io import keep

_TAG = re.compile(r"<[^>]*>")
_PART = re.compile(r"<[^>]*>|[^<]+|<")
_NAME = re.compile(r"<(/?)([a-zA-Z][\w-]*)[^>]*?(/?)>$")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*[\"']?([^\"'>]+)")
_LETTERS = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?…][\"'”’»«“)\]\s]*$")
_RANK = re.compile(r"\s*\d{1,3}[.)]\s")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
# Elements that hold no body text, and words in their classes.
_FURNITURE_TAGS = frozenset("small aside nav footer header form button figcaption menu label select option".split())
_FURNITURE_CLASSES = ("nav", "menu", "item", "crumb", "skip", "consent", "cookie", "promo", "teaser", "related", "rank", "popular", "adv", "sponsor", "signup", "newsletter", "subscribe", "comment", "foot", "tags", "share", "social", "sidebar", "widget", "byline", "meta")


# Elements within a line of text, elements without content, and boxes that hold no body text.
_INLINE_TAGS = frozenset("a abbr b bdi bdo cite code del dfn em font i ins kbd mark q s samp span strong sub sup time tt u var wbr".split())
_VOID_TAGS = frozenset("br hr img input meta link source wbr area base col embed track".split())
_BOX_TAGS = frozenset("nav footer form menu".split())


@dataclass(frozen=True)
class ContentParams:
    least_titles: int = 6
    insertion_share: float = 0.35
    paragraph_letters: int = 40
    #: A leaf is a link if so much of its letters is; a region is a sibling at so much of the best one's points.
    link_share: float = 0.5
    sibling_share: float = 0.2
    #: A label before a colon, and a line of furniture without a full stop, are no longer.
    label_chars: int = 40
    short_letters: int = 90


@dataclass
class Box:
    """An element: its parent, its tag and attributes, and how many segments it holds."""

    parent: Box | None
    tag: str
    attrs: str
    segments: int = 0


@dataclass
class Line:
    """A leaf: a segment of a line with the elements around it alone."""

    at: int  # number among the page's segments
    no: int
    text: str
    letters: int
    linked: int  # letters in links
    box: Box
    tags: tuple[str, ...] = ()
    classes: str = ""
    sentence: bool = False


def parse(content: str) -> list[Line]:
    """The segments of a page that hold text."""
    root = Box(None, "", "")
    at, anchors = root, 0
    found: list[tuple[int, str, int, Box]] = []

    def close(no: int, parts: list[tuple[str, bool]]) -> None:
        text = html.unescape("".join(t for t, _ in parts)).strip()
        if text:
            found.append((no, text, sum(sum(map(len, _LETTERS.findall(t))) for t, linked in parts if linked), at))
        parts.clear()

    for no, raw in enumerate(content.split("\n"), 1):
        parts: list[tuple[str, bool]] = []
        for piece in _PART.findall(raw) if "<" in raw else [raw]:
            tag = _NAME.match(piece) if piece.startswith("<") else None
            if tag is None:
                if not (piece.startswith("<") and piece.endswith(">")):
                    parts.append((piece, anchors > 0))
                continue
            name = tag[2].lower()
            if name == "a":
                anchors = max(0, anchors + (-1 if tag[1] else 1))
            if name in _INLINE_TAGS:
                continue
            close(no, parts)
            if tag[1]:
                box = at
                while box is not root and box.tag != name:
                    box = box.parent
                at = box.parent if box is not root else at
            elif not tag[3] and name not in _VOID_TAGS:
                if name == "p" and at.tag == "p":  # a paragraph ends where the next one begins
                    at = at.parent
                at = Box(at, name, " ".join(_ATTR.findall(piece)).lower().strip())
        close(no, parts)
    for _, _, _, box in found:
        while box is not None:
            box.segments += 1
            box = box.parent
    out = []
    for k, (no, text, linked, box) in enumerate(found):
        line = Line(k, no, text, sum(map(len, _LETTERS.findall(text))), linked, box, sentence=bool(_END.search(text)))
        attrs = []
        while line.box.segments == 1 and line.box is not root:
            line.tags += (line.box.tag,)
            attrs.insert(0, line.box.attrs)
            line.box = line.box.parent
        line.classes = " ".join(x for x in attrs if x)
        out.append(line)
    return out


def _hash(kind: str, text: str) -> int:
    h = xxhash.xxh64_intdigest(f"{kind}\0{text}")
    return h - (1 << 64) if h >> 63 else h


def _key(text: str) -> str:
    return " ".join(_LETTERS.findall(text)).lower()


def features(line: Line, p: ContentParams) -> list[int]:
    """What may recur: the line, the label before a colon, the last sentence, the class."""
    key = _key(line.text)
    if not key:
        return []
    out = [_hash("line", key)]
    label, colon, rest = line.text.partition(":")
    if colon and rest.strip() and len(label) <= p.label_chars and (k := _key(label)):
        out.append(_hash("label", k))
    parts = _SENTENCE.split(line.text)
    if len(parts) > 1 and (k := _key(parts[-1])):
        out.append(_hash("line", k))
    if line.classes:
        out.append(_hash("class", line.classes))
    return out


def _is_paragraph(line: Line, p: ContentParams) -> bool:
    return line.sentence and line.letters >= p.paragraph_letters and line.linked <= p.link_share * line.letters


def _counter(p: ContentParams):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cols: list[list] = [[], [], [], [], []]
            for i, title, content in zip(*(batch.column(c).to_pylist() for c in ("id", "title", "content")), strict=True):
                if not content:
                    continue
                about = _hash("title", _key(title or ""))
                lines = [x for x in parse(content) if x.letters]
                for k, line in enumerate(lines):
                    inside = 0 < k < len(lines) - 1 and _is_paragraph(lines[k + 1], p) and (_is_paragraph(lines[k - 1], p) or lines[k - 1].letters >= 12)
                    for f in features(line, p):
                        for c, v in zip(cols, (i, line.at, f, about, int(inside)), strict=True):
                            c.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "at", "feature", "title", "inside"])

    return run


def furniture(line: Line, source_name: str, marks: dict[int, bool], p: ContentParams) -> str:
    """'' for text, 'in' for an insertion, 'end' for what parts regions."""
    if line.at in marks:
        return "in" if marks[line.at] else "end"
    if not _FURNITURE_TAGS.isdisjoint(line.tags) or any(c in line.classes for c in _FURNITURE_CLASSES):
        return "in" if any(c in line.classes for c in ("adv", "promo", "signup", "sponsor")) else "end"
    if not line.letters or line.linked > p.link_share * line.letters or _RANK.match(line.text):
        return "end"
    box = line.box
    while box is not None:
        if box.tag in _BOX_TAGS:
            return "end"
        box = box.parent
    short = line.letters < p.short_letters and not line.sentence
    if short and (" | " in line.text or " > " in line.text or source_name and source_name.lower() in line.text.lower()):
        return "end"
    return ""


@dataclass
class Region:
    box: Box
    own: list[Line]
    passed: int = 0  # letters of insertions
    points: float = 0.0


def _score(region: Region, p: ContentParams) -> float:
    """Points of the paragraphs, discounted by the share of letters that are links or no paragraph."""
    got = sum((1 + x.text.count(",") + min(x.letters // 80, 4)) * (1 - x.linked / x.letters) for x in region.own if _is_paragraph(x, p))
    loose = sum(x.linked if _is_paragraph(x, p) else x.letters for x in region.own) + region.passed
    every = sum(x.letters for x in region.own) + region.passed
    return got * (1 - loose / every) if every else 0.0


def body(content: str, source_name: str, marks: dict[int, bool], p: ContentParams) -> list[Line]:
    """The segments of the main body; ``marks``: recurring segments, True for insertions."""
    lines = parse(content)
    if not lines:
        return []
    regions: list[Region] = []
    parted = True
    for line in lines:
        kind = furniture(line, source_name, marks, p)
        if kind == "in":
            if regions and not parted:
                regions[-1].passed += line.letters
        elif kind == "end":
            parted = True
        else:
            if parted or regions[-1].box is not line.box:
                regions.append(Region(line.box, []))
            regions[-1].own.append(line)
            parted = False
    if not regions:
        return []
    passed: dict[int, float] = {}
    for r in regions:
        r.points = _score(r, p)
        box, share = r.box, r.points / 2
        while box is not None:
            passed[id(box)] = passed.get(id(box), 0.0) + share
            box, share = box.parent, share / 2

    def total(r: Region) -> float:
        box, got, share = r.box, r.points, 0.25
        while box is not None:
            got += passed[id(box)] * share
            box, share = box.parent, share / 2
        return got

    best = max(range(len(regions)), key=lambda k: (total(regions[k]), -k))
    chosen = regions[best]
    kind = (chosen.box.tag, chosen.box.attrs, id(chosen.box.parent))
    out: list[Line] = []
    for r in regions:
        sibling = r.box is not chosen.box and r.box.parent is not None and (r.box.tag, r.box.attrs, id(r.box.parent)) == kind and r.points >= p.sibling_share * chosen.points > 0
        if r is chosen or sibling:
            out += _between_paragraphs(r.own, lines[-1], p)
    return out


def _between_paragraphs(own: list[Line], last_line: Line, p: ContentParams) -> list[Line]:
    """A region from its first paragraph to its last, or to the page's end where that cut it."""
    paragraphs = [k for k, x in enumerate(own) if _is_paragraph(x, p)]
    if not paragraphs:
        return own if len(own) == 1 and own[0] is last_line and own[0].letters >= p.paragraph_letters else []
    last = len(own) - 1 if own[-1] is last_line and not own[-1].sentence else paragraphs[-1]
    return own[paragraphs[0] : last + 1]


def _extractor(p: ContentParams):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, nos, texts = [], [], []
            for i, name, content, marks in zip(*(batch.column(c).to_pylist() for c in ("id", "source_name", "content", "marks")), strict=True):
                kept = body(content, (name or "").strip(), {m["at"]: m["insertion"] for m in marks or []}, p) if content else []
                ids.append(i)
                nos.append(list(dict.fromkeys(x.no for x in kept)))
                texts.append("\n".join(x.text for x in kept))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.list_(pa.int64())), pa.array(texts, pa.string())], names=["id", "kept", "text"])

    return run


def main_bodies(pages: DataFrame, p: ContentParams = ContentParams()) -> DataFrame:
    """(id, kept, text) of pages (id, source_name, title, content) whose content is not null: line numbers and text of the body."""
    pages = pages.where("id is not null and content is not null").select("id", "source_name", "title", "content")
    seen = keep(pages.mapInArrow(_counter(p), "id long, at int, feature long, title long, inside int"), "p6-features")
    each = seen.groupBy("feature", "title").agg(F.count(F.lit(1)).alias("n"), F.sum("inside").alias("inside"))
    often = each.groupBy("feature").agg(F.count(F.lit(1)).alias("titles"), (F.sum("inside") / F.sum("n")).alias("share")).where(F.col("titles") >= p.least_titles)
    often = often.select("feature", (F.col("share") >= p.insertion_share).alias("insertion"))
    marks = seen.join(often, "feature").groupBy("id", "at").agg(F.min("insertion").alias("insertion")).groupBy("id").agg(F.collect_list(F.struct("at", "insertion")).alias("marks"))
    return pages.join(marks, "id", "left").select("id", "source_name", "content", "marks").mapInArrow(_extractor(p), "id long, kept array<long>, text string")


def main_lines(pages: DataFrame, p: ContentParams = ContentParams()) -> DataFrame:
    """(id, line_no) of the lines that hold the body."""
    return main_bodies(pages, p).select("id", F.explode("kept").alias("line_no"))


def main_text(pages: DataFrame, p: ContentParams = ContentParams()) -> DataFrame:
    """(id, text, lines): the body of each page, its segments without markup, one a line; null content has a null text."""
    found = main_bodies(pages, p)
    return pages.where("id is not null").select("id").join(found, "id", "left").select("id", F.col("text"), F.coalesce(F.size("kept"), F.lit(0)).cast("long").alias("lines"))
