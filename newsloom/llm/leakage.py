"""Problem 8: evaluation texts leaking into training text.

All runs of ``n`` words of the evaluation items form a hash set that is
broadcast, and every document is scanned once by rolling hashes of its word
windows.  Hits are verified word by word.  The set is bounded: the items' runs
are counted first, items with more than ``block_grams`` of them are cut into
pieces that overlap by ``n - 1`` words, and pieces are taken in blocks of at most
``block_grams`` runs, each broadcast and probed on its own.

Defined results: null texts and texts of fewer than ``n`` words hold nothing;
rows without an id are ignored; items with equal texts all hit.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import kernels as K

_WORD = re.compile(r"[^\W_]+")
_HITS = "id long, item_id long, first int, last int, from_char int, to_char int"


def _index(items: list[tuple[int, int, str]], n: int) -> tuple[np.ndarray, list[list[tuple[int, int]]], dict[int, list[str]]]:
    """(sorted hashes, places of each, words of each piece's item) of pieces (item, piece, words joined by blanks)."""
    memo, at, texts = K.WordHash(), defaultdict(list), {}
    for item, piece, text in items:
        ws = texts[item, piece] = text.split(" ")
        for k, h in enumerate(K.rolling_word_hashes(memo.of(ws), n).tolist()):
            at[h].append(((item, piece), k))
    hashes = np.array(sorted(at), dtype=np.uint64)
    return hashes, [at[h] for h in hashes.tolist()], texts


def _pieces(n: int, block_grams: int):
    """Items cut into pieces (item_id, piece, words, grams) of at most ``block_grams`` runs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ws = K.words(text)
                for k, start in enumerate(range(0, len(ws) - n + 1, block_grams)):
                    own = ws[start : start + block_grams + n - 1]
                    rows.append((i, k, " ".join(own), len(own) - n + 1))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            types = (pa.int64(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["item_id", "piece", "words", "grams"])

    return run


def _scanner(index, n: int):
    """``index`` is the broadcast index of one block."""

    def hits(text: str, memo: K.WordHash) -> list[tuple[int, int, int, int, int]]:
        hashes, where, texts = index.value
        ws = K.words(text)
        own = K.rolling_word_hashes(memo.of(ws), n)
        if not len(own) or not len(hashes):
            return []
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        found = np.flatnonzero(hashes[at] == own)
        if not len(found):
            return []
        runs: dict[int, list[list[int]]] = defaultdict(list)
        for k in found.tolist():
            for item, j in where[at[k]]:
                if ws[k : k + n] == texts[item][j : j + n]:
                    spans = runs[item]
                    if spans and k <= spans[-1][1]:
                        spans[-1][1] = k + n
                    else:
                        spans.append([k, k + n])
        if not runs:
            return []
        places = [m.span() for m in _WORD.finditer(text)]
        return [(item, a, b, places[a][0], places[b - 1][1]) for (item, _), spans in runs.items() for a, b in spans]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = K.WordHash()
        for batch in it:
            rows = [(i, *h) for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) if text for h in hits(text, memo)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "item_id", "first", "last", "from_char", "to_char"])

    return run


def leaks(documents: DataFrame, items: DataFrame, n: int = 13, block_grams: int = 1_000_000) -> DataFrame:
    """(id, item_id, first, last, from_char, to_char) of documents (id, text) and items (item_id, text).

    One row for each maximal run of words that a document shares with a piece of
    an item; words [first, last) of the document, characters [from_char, to_char).
    """
    documents = documents.where("id is not null and text is not null").select("id", "text")
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    spark = documents.sparkSession
    pieces = items.mapInArrow(_pieces(n, block_grams), "item_id long, piece int, words string, grams long")
    total = pieces.agg(F.sum("grams")).first()[0] or 0
    blocks = -(-2 * total // block_grams) if total > block_grams else 1
    scans = []
    for b in range(blocks):
        part = pieces if blocks == 1 else pieces.where(F.pmod(F.xxhash64("item_id", "piece"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(_index([(r["item_id"], r["piece"], r["words"]) for r in part.toArrow().to_pylist()], n))
        scans.append(documents.mapInArrow(_scanner(index, n), _HITS))
    return reduce(DataFrame.unionByName, scans)


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(id, text, leaked_chars): documents with the leaked spans taken out."""
    spans = found.groupBy("id").agg(F.array_sort(F.collect_set(F.struct(F.col("from_char").alias("s"), F.col("to_char").alias("e")))).alias("spans"))
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("to"))
    cut = lambda acc, x: F.struct(
        F.when(x["s"] > acc["to"], F.concat(acc["kept"], F.col("text").substr(acc["to"] + 1, x["s"] - acc["to"]))).otherwise(acc["kept"]).alias("kept"),
        F.greatest(acc["to"], x["e"]).alias("to"),
    )
    joined = documents.select("id", "text").join(spans, "id", "left").withColumn("c", F.aggregate("spans", start, cut))
    kept = F.concat(F.col("c.kept"), F.col("text").substr(F.col("c.to") + 1, F.char_length("text")))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(kept)
    return joined.select("id", text.alias("text"), (F.char_length(F.col("text")) - F.char_length(text)).cast("long").alias("leaked_chars"))
