"""Problem 10: long exact spans shared between records, by passage MinHash banding.

The passages are all windows of ``min_chars`` code points of a text, not its
paragraphs: a shared stretch need not begin or end with a paragraph, and a
paragraph that merely holds one has a low similarity to the other.  The MinHash
of a passage is the smallest hash of its ``gram``-character pieces.  Two equal
passages have similarity 1, so a single band of a single row meets them with
certainty; neighbouring passages mostly have the same minimum, so that a text of
n characters has about ``2 n / (min_chars - gram)`` different ones.

Passages that collide are verified exactly: the pieces are extended character by
character in both texts, as far as a stretch of ``min_chars`` may reach.  Equal
texts are one class from the start.  Removals are clustered by connected
components.

Defined results: null texts and texts shorter than ``min_chars`` share nothing;
rows without an id are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.io import keep
from newsloom.llm import kernels as K
from newsloom.llm.components import connected
from newsloom.llm.runs import blocked, over_runs


@dataclass(frozen=True)
class SpanParams:
    min_chars: int = 300
    gram: int = 128
    hot: int = 256

    @property
    def reach(self) -> int:
        """A stretch that contains a piece reaches at most so far beyond it."""
        return self.min_chars - self.gram


def passage_minima(points: np.ndarray, p: SpanParams) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the distinct minima of all passages."""
    h = K.window_hashes(points, p.gram)
    low = K.sliding_min(h, p.reach + 1)
    if not len(low):
        return low, np.empty(0, np.int64)
    chosen = np.isin(h, low[np.r_[True, low[1:] != low[:-1]]])
    at = np.flatnonzero(chosen)
    return h[at], at


def _marker(p: SpanParams):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, digests, keys, places = [], [], [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if i is None or text is None or len(text) < p.min_chars:
                    continue
                h, at = passage_minima(K.code_points(text), p)
                ids.append(i), keys.append(h.view(np.int64)), places.append(at.astype(np.int32))
                digests.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                names=["id", "digest", "keys", "places"],
            )

    return run


def _contexts(p: SpanParams):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[list] = [[], [], [], [], [], []]
            for i, text, marks in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "marks")), strict=True):
                for m in marks:
                    at = m["at"]
                    row = (m["key"], m["members"], i, at, text[max(0, at - p.reach) : at], text[at : at + p.min_chars])
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["key", "members", "id", "at", "before", "after"])

    return run


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _extend(p: SpanParams):
    def handle(rows: list[tuple]) -> list[tuple]:
        # Occurrences with equal surroundings need one comparison only.
        groups: dict[tuple[str, str], list[tuple]] = defaultdict(list)
        for i, at, before, after, left, right in rows:
            groups[before, after].append((i, at, left, right))
        items = list(groups.items())
        out = []
        for x, ((bx, ax), mx) in enumerate(items):
            for (by, ay), my in items[x:]:
                after = _common(ax, ay)
                before = _common(bx[::-1], by[::-1])
                if after < p.gram or before + after < p.min_chars:
                    continue
                for i, at, il, ir in mx:
                    for j, bt, jl, jr in my:
                        if i < j and (il and jr or ir and jl):
                            out.append((i, j, at - before, at + after, bt - before, bt + after))
                        elif j < i and mx is not my and (il and jr or ir and jl):
                            out.append((j, i, bt - before, bt + after, at - before, at + after))
        return list(dict.fromkeys(out))

    return handle


_SPAN = "a long, b long, a_from int, a_to int, b_from int, b_to int"


def shared_spans(records: DataFrame, p: SpanParams = SpanParams()) -> tuple[DataFrame, DataFrame]:
    """(classes, spans) of records (id, text).

    classes(id, rep): every long enough record and the smallest id with the same
    text.  spans(a, b, a_from, a_to, b_from, b_to): equal stretches of different
    representatives, as code point ranges; the ranges of a pair overlap and
    together cover all its shared stretches of ``min_chars`` and more.
    """
    records = records.select("id", "text")
    marked = keep(records.mapInArrow(_marker(p), "id long, digest binary, keys array<long>, places array<int>"), "p10-marks")
    reps = marked.groupBy("digest").agg(F.min("id").alias("rep"))
    classes = keep(marked.select("id", "digest").join(reps, "digest").select("id", "rep"), "p10-classes")
    chosen = marked.join(classes.where("id = rep").select("id"), "id", "left_semi")
    marks = chosen.select("id", F.explode(F.arrays_zip("keys", "places")).alias("m")).select("id", F.col("m.keys").alias("key"), F.col("m.places").alias("at"))
    shared = marks.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("key", "members")
    met = marks.join(shared, "key").groupBy("id").agg(F.collect_list(F.struct("key", "members", "at")).alias("marks"))
    contexts = keep(records.join(met, "id").mapInArrow(_contexts(p), "key long, members long, id long, at int, before string, after string"), "p10-contexts")
    runs = blocked(contexts, p.hot, ["id", "at", "before", "after"]).repartition("key", "block").sortWithinPartitions("key", "block")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())] + [(c, pa.int32()) for c in ("a_from", "a_to", "b_from", "b_to")])
    spans = runs.mapInArrow(over_runs(["id", "at", "before", "after", "is_left", "is_right"], _extend(p), schema), _SPAN)
    return classes, keep(spans, "p10-spans")


def shared_share(records: DataFrame, p: SpanParams = SpanParams()) -> DataFrame:
    """(id, rep, n_chars, shared_chars, links): how much of each record stands elsewhere too.

    ``links`` counts other representatives; a record with a full copy is shared whole.
    """
    classes, spans = shared_spans(records, p)
    ends = spans.select(F.col("a").alias("rep"), F.col("b").alias("other"), F.col("a_from").alias("s"), F.col("a_to").alias("e")).union(spans.select("b", "a", "b_from", "b_to"))
    merged = ends.groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("r"), F.count_distinct("other").alias("links"))
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("to"))
    step = lambda acc, x: F.struct((acc["covered"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["to"]))).alias("covered"), F.greatest(acc["to"], x["e"]).alias("to"))
    covered = merged.select("rep", "links", F.aggregate("r", start, step)["covered"].cast("long").alias("covered"))
    sizes = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    chars = records.where("id is not null and text is not null").select("id", F.char_length("text").cast("long").alias("n_chars"))
    return (
        chars.join(classes, "id", "left")
        .join(sizes, "rep", "left")
        .join(covered, "rep", "left")
        .select(
            "id",
            F.coalesce("rep", "id").alias("rep"),
            "n_chars",
            F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("long").alias("shared_chars"),
            F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        )
    )


def removals(records: DataFrame, p: SpanParams = SpanParams()) -> DataFrame:
    """(id, component, from_char, to_char): what to remove so that every shared stretch stands once.

    Records that stretches or copies hold together are one component, named by
    its smallest id.  The stretch stays in the record with the smaller id; a
    later copy of a whole text is removed whole.  Ranges of one record are
    disjoint.
    """
    classes, spans = shared_spans(records, p)
    found = connected(spans.select("a", "b")).withColumnRenamed("node", "rep")
    merged = spans.groupBy(F.col("b").alias("rep")).agg(F.array_sort(F.collect_set(F.struct(F.col("b_from").alias("s"), F.col("b_to").alias("e")))).alias("r"))
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] <= F.try_element_at(acc, F.lit(-1))["e"]), longer).otherwise(F.concat(acc, F.array(x)))

    parts = merged.select("rep", F.explode(F.aggregate("r", empty, join)).alias("x")).select("rep", "x.s", "x.e")
    sized = classes.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    first = sized.where("id = rep").join(parts, "rep").select("id", "component", F.col("s").alias("from_char"), F.col("e").alias("to_char"))
    chars = records.where("id is not null and text is not null").select("id", F.char_length("text").alias("n"))
    whole = sized.where("id <> rep").join(chars, "id").select("id", "component", F.lit(0).alias("from_char"), F.col("n").alias("to_char"))
    return first.unionByName(whole)
