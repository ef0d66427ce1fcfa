"""Problem 1: near-duplicate records, by a MinHash LSH forest.

Every record gets ``trees`` sequences of ``max_depth`` MinHash labels.  A tree is
the prefix trie of one label sequence; its entries are kept sorted by prefix, so
that records with a common prefix lie next to each other.  Matching begins at the
longest prefixes and shortens them, level by level:

* at a level, the records that share a prefix there, and in no trie a longer one,
  are candidates; they are compared by signature where they meet, and the rest
  is verified on the full shingle sets;
* after it, the recall reached is estimated from the links found: a pair of
  similarity s is met at depth d with probability ``1 - (1 - s^d)^trees``, so
  that each link stands for one over this of them, and three more at the
  threshold are assumed unseen.  Prefixes are shortened until the estimate, or
  the probability for a pair at the threshold, reaches ``target_recall``.

A prefix shared by many records (``hot``) is paired whole, in blocks spread over
many tasks: what records share may lie in such prefixes only.  Records with equal
shingle sets are one class from the start; only the class's smallest id goes
through the forest.

Defined results: records with a null id, null content or fewer than
``min_words`` words of content are never paired; a null title counts as empty;
an empty table gives an empty result; very long texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.io import keep
from newsloom.llm import kernels as K
from newsloom.llm.components import connected
from newsloom.llm.runs import blocked


@dataclass(frozen=True)
class Forest:
    """Parameters: all sizes are independent of the data."""

    threshold: float = 0.8
    shingle: int = 5
    min_words: int = 20
    trees: int = 32
    max_depth: int = 4
    target_recall: float = 0.9995
    hot: int = 256
    #: The signature may understate a similarity by this much (over six
    #: standard deviations of 128 labels at 0.6).
    margin: float = 0.27

    def recall(self, similarity: float, depth: int) -> float:
        """The probability that a pair shares a prefix of this length in some trie."""
        return 1 - (1 - similarity**depth) ** self.trees

    def enough(self, depth: int, links: int, missed: float) -> bool:
        """Whether prefixes need not be shortened further; ``missed`` is the estimate from the links found."""
        at_threshold = self.recall(self.threshold, depth)
        unseen = missed + 3 * (1 / at_threshold - 1)
        return depth == 1 or at_threshold >= self.target_recall or links >= self.target_recall * (links + unseen)


def _sketcher(p: Forest):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, minhash = K.WordHash(), K.MinHash(p.trees * p.max_depth)
        for batch in it:
            ids, digests, sigs = [], [], []
            for i, title, content in zip(*(batch.column(c).to_pylist() for c in ("id", "title", "content")), strict=True):
                body = K.words(content)
                if len(body) < p.min_words:
                    continue
                sh = np.unique(K.shingle_hashes(memo.of(K.words(title) + body), p.shingle))
                if not len(sh):
                    continue
                ids.append(i), digests.append(K.set_digest(sh))
                sigs.append((minhash(sh) & np.uint32(0xFFFF)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(sigs, pa.binary())], names=["id", "digest", "sig"])

    return run


def _prefixes(p: Forest, depth: int):
    """Every record's prefix of this length in each trie, as one number."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = batch.num_rows
            labels = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(n, p.trees, p.max_depth).astype(np.uint64)
            key = np.broadcast_to(np.arange(p.trees, dtype=np.uint64), (n, p.trees))
            for d in range(depth):
                key = K.mix(key * np.uint64(1 << 16) + labels[:, :, d])
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * p.trees)
            keys = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(key).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), keys], names=["id", "keys"])

    return run


def _pairs_in_runs(p: Forest, depth: int):
    """Rows sorted by key and block: pairs whose longest common prefix has this length and that look alike."""
    least = p.threshold - p.margin
    k = p.trees * p.max_depth

    def run_pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        ids = np.array([r[0] for r in rows])
        sig = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint16).reshape(len(rows), k)
        left = np.array([r[2] for r in rows])
        right = np.array([r[3] for r in rows])
        out = []
        for a in range(len(rows)):
            if not left[a]:
                continue
            rest = np.flatnonzero(right & (ids != ids[a]))
            if not len(rest):
                continue
            same = sig[rest] == sig[a]
            alike = same.mean(axis=1) >= least
            rest, same = rest[alike], same[alike]
            if depth < p.max_depth and len(rest):  # met at a longer prefix before
                new = ~same.reshape(-1, p.trees, p.max_depth)[:, :, : depth + 1].all(axis=2).any(axis=1)
                rest = rest[new]
            out += [(int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))) for b in rest]
        return list(dict.fromkeys(out))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in it:
            found = []
            for key, block, i, sig, left, right in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "id", "sig", "is_left", "is_right")), strict=True):
                if (key, block) != current:
                    found += run_pairs(rows)
                    current, rows = (key, block), []
                rows.append((i, sig, left, right))
            yield _pair_batch(found)
        yield _pair_batch(run_pairs(rows))

    return run


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], names=["a", "b"])


def sketch(records: DataFrame, p: Forest) -> DataFrame:
    """(id, digest, sig) of every record (id, title, content) with enough words."""
    return records.where(F.col("id").isNotNull() & F.col("content").isNotNull()).mapInArrow(_sketcher(p), "id long, digest long, sig binary")


def forest_candidates(reps: DataFrame, p: Forest, depth: int) -> DataFrame:
    """Distinct pairs (a < b) of records (id, sig) whose longest common prefix has this length and that look alike."""
    entries = reps.mapInArrow(_prefixes(p, depth), "id long, keys array<long>").select("id", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = keep(entries.join(shared, "key"), "p1-met")
    rows = blocked(met, p.hot, ["id"]).join(reps.select("id", "sig"), "id")
    runs = rows.repartition("key", "block").sortWithinPartitions("key", "block")
    return runs.mapInArrow(_pairs_in_runs(p, depth), "a long, b long").distinct()


def _shingler(p: Forest):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = K.WordHash()
        for batch in it:
            sets = [
                np.unique(K.shingle_hashes(memo.of(K.words(t) + K.words(c)), p.shingle)).tobytes()
                for t, c in zip(batch.column("title").to_pylist(), batch.column("content").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "sh"])

    return run


def _verifier(p: Forest):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sims = [K.jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return run


def verify(candidates: DataFrame, records: DataFrame, p: Forest) -> DataFrame:
    """The candidates whose full shingle sets reach the threshold, with the similarity."""
    wanted = candidates.select(F.col("a").alias("id")).union(candidates.select(F.col("b").alias("id"))).distinct()
    sets = records.join(wanted, "id", "left_semi").mapInArrow(_shingler(p), "id long, sh binary")
    sets = keep(sets, "p1-sets")
    both = candidates.join(sets.select(F.col("id").alias("a"), F.col("sh").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sh").alias("sb")), "b")
    return both.mapInArrow(_verifier(p), "a long, b long, similarity double").where(F.col("similarity") >= p.threshold)


def near_duplicates(records: DataFrame, p: Forest = Forest()) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of records (id, title, content).

    classes(id, rep): every record with enough words, and the smallest id with
    the same shingle set.  links(a, b, similarity, depth): every pair of different
    representatives at or above the threshold, a < b, and the prefix length at
    which it was met.
    """
    records = records.select("id", "title", "content")
    sketches = keep(sketch(records, p), "p1-sketches")
    reps = sketches.groupBy("digest").agg(F.min("id").alias("rep"))
    classes = keep(sketches.select("id", "digest").join(reps, "digest").select("id", "rep"), "p1-classes")
    chosen = sketches.join(classes.where("id = rep").select("id"), "id", "left_semi").select("id", "sig")
    links = None
    for depth in range(p.max_depth, 0, -1):
        candidates = keep(forest_candidates(chosen, p, depth), "p1-candidates")
        found = keep(verify(candidates, records, p).withColumn("depth", F.lit(depth)), "p1-links")
        links = found if links is None else links.unionByName(found)
        met = 1 - F.pow(1 - F.pow("similarity", F.lit(float(depth))), F.lit(float(p.trees)))
        n, missed = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(1 / met - 1), F.lit(0.0))).first()
        if p.enough(depth, n, missed):
            break
    return classes, links


def groups(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, rep, component, links, depth) of every record of ``classes``.

    ``component`` is the smallest id of the group that links hold together,
    ``links`` the number of other classes that the record's class is linked to,
    ``depth`` the longest prefix at which one of them was met (null for none).
    """
    ends = links.select(F.col("a").alias("rep"), "depth").unionByName(links.select(F.col("b").alias("rep"), "depth")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"), F.max("depth").alias("depth"))
    found = connected(links.select("a", "b")).withColumnRenamed("node", "rep")
    joined = classes.join(found, "rep", "left").join(ends, "rep", "left")
    return joined.select("id", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"), "depth")


def all_pairs(classes: DataFrame, links: DataFrame, block: int = 1000) -> DataFrame:
    """Links spelled out for every member of both classes, and the pairs within a class, in blocks."""
    copied = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = blocked(classes.join(copied, "rep").select(F.col("rep").alias("key"), "id", "members"), block, ["id"])
    sides = members.where("is_left").alias("x").join(members.where("is_right").alias("y"), F.expr("x.key = y.key and x.block = y.block and (x.id < y.id or not x.is_right)"))
    within = sides.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    across = (
        links.join(classes.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a")
        .join(classes.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b")
        .select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    )
    return across.unionByName(within)
