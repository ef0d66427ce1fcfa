"""Problem 3: new batches against everything accepted, by a persisted vector index.

A text is a vector with one coordinate per shingle.  The index is an inverted
file in one folder:

* ``vectors``: the full vector of every document, by batch;
* ``cells``: a *cell* is a coordinate and holds every vector that has it among
  its first ones, in an order that puts rare coordinates first; the cells are a
  table bucketed by coordinate;
* ``names``: address keys and digests of equal vectors, bucketed by name;
* ``order`` and ``params``: the fitted order, so that another process can
  ``open`` the folder; ``log``: which batches were appended;
* ``state`` and ``answers``: what was found for each batch.

A query walks its own coordinates in the same order.  Once it has probed the
cells of its first ``n - ceil(t n) + 1`` coordinates, a vector not met so far
lacks so many of them that its similarity stays below ``t``: the bound says that
no nearer match is possible, and probing ends.  A vector met is passed over if
the sizes alone keep it below ``t`` or if its 128-bit code is too far away; the
nearest by code is reranked exactly on the full vectors, and all others are for
those queries that it does not answer: of these, full vectors travel only where
1,024 bits of each leave the threshold possible, which loses nothing.

The new batch's cells are written first, in the same buckets, so that probing
joins bucket with bucket: of the history only the cells are scanned, nothing of
it is shuffled, and no vectors are compared with each other that the batch does
not ask for.  Appending is one file of the log.  Of a cell that receives more
than ``leaders`` vectors from one batch, about that many, chosen by hash, are
probed first; the others lie beside them and are probed for the queries that the
leaders do not answer.

Long texts (``dense_from`` shingles and more) are indexed in a fixed
``1/dense_share`` of the coordinate space, with the bound widened by
``deviations`` standard deviations of the sampling, and codes are let through up
to four deviations: an approximation whose recall is measured against brute
force.  ``exact=True`` indexes the whole space and leaves codes aside: nothing
is lost then, for about four times the cells.  The order is fitted on
``fit_rows`` rows of the history: it only decides how many vectors share a cell,
never what is found.

Cells around learned centroids were measured and given up; README has the
figures.

Defined results: rows without an id or epoch are ignored; null or short texts
(fewer than ``min_words`` words of content) are compared by address only; null
addresses match nothing; rows of one batch never match each other; an empty
batch answers nothing; a batch staged again replaces itself.
"""

from __future__ import annotations

import dataclasses
import gc
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.urls import canonicalize_url
from newsloom.io import hash_sample, keep, scratch_dir, small_side
from newsloom.llm import kernels as K


@dataclass(frozen=True)
class CellParams:
    threshold: float = 0.8
    shingle: int = 5
    min_words: int = 20
    fit_rows: int = 5000
    fit_least: int = 3
    dense_from: int = 60
    dense_only_from: int = 100
    dense_share: int = 4
    deviations: float = 2.5
    #: Nothing is sampled and no code is trusted.
    exact: bool = False
    #: Of one batch, so many vectors of a cell are probed first.
    leaders: int = 64
    #: Buckets of the stored tables; a number that suits the cluster, not the batch.
    parts: int = 8
    #: Up to so many rows a bucket, a batch's cells are a hash table; beyond, both sides are sorted.
    table_rows: int = 200_000

    @property
    def least_code(self) -> int:
        """Of the 64 places of a code, a match at the threshold shares 16 (1 + 3 t) on average; four deviations less are let through."""
        same = (1 + 3 * self.threshold) / 4
        return 0 if self.exact else int(64 * same - 4 * np.sqrt(64 * same * (1 - same)))


_VECTORS = "doc long, epoch int, url_key long, digest long, n int, code1 long, code2 long, vec binary, cells array<long>, bits array<long>, over int"
_CELLS = "key long, doc long, n int, code1 long, code2 long, leads boolean, epoch int"
_NAMES = "name long, epoch int"
_STORED_BYTES = 5  # of each coordinate's hash


def _code(sh: np.ndarray) -> tuple[int, int]:
    """Two bits for each of 64 bins of the hash range: those of the bin's smallest member."""
    places = np.zeros(64, dtype=np.uint8)
    bins = (sh >> np.uint64(58)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    places[bins[first]] = (sh[first] >> np.uint64(9)).astype(np.uint8) & 3
    return tuple((places[0::4] | places[1::4] << 2 | places[2::4] << 4 | places[3::4] << 6).view(np.int64).tolist())


def shared_places(pairs: list[tuple[str, str]]) -> Column:
    """How many of the 64 places two codes share."""
    apart = F.lit(0)
    for x, y in pairs:
        differ = F.col(x).bitwiseXOR(F.col(y))
        apart = apart + F.bit_count(differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return 64 - apart


def pack(sh: np.ndarray) -> bytes:
    """Sorted distinct hashes, shortened to five bytes each."""
    short = np.unique(sh >> np.uint64(64 - 8 * _STORED_BYTES))
    return short.view(np.uint8).reshape(-1, 8)[:, :_STORED_BYTES].tobytes()


def unpack(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, _STORED_BYTES)
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, :_STORED_BYTES] = rows
    return wide.view(np.uint64).ravel()


def bitmap(data: bytes) -> tuple[np.ndarray, int]:
    """1,024 bits by hash for a stored vector, and how many coordinates found their bit set by another."""
    own = unpack(data)
    bits = np.zeros(1024, np.uint8)
    bits[(own >> np.uint64(8 * _STORED_BYTES - 10)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64), len(own) - int(bits.sum())


def _ones(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0), lambda a, x: a + F.bit_count(x))


def shared_at_most() -> Column:
    """A bound on the coordinates that two vectors share: bits of both, and those that fewer bits than coordinates may hide."""
    return _ones(F.zip_with("bits", "qbits", lambda x, y: x.bitwiseAND(y))) + F.least("over", "qover")


def first_coordinates(sh: np.ndarray, p: CellParams, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The cells of a vector: its first coordinates, rare ones first, as far as the bound asks."""
    out = []
    n = len(sh)
    spaces = [(1, 0)] if p.exact or n < p.dense_only_from else []
    if not p.exact and n >= p.dense_from:
        spaces.append((p.dense_share, 1))
    for share, tag in spaces:
        own = sh if share == 1 else sh[(sh >> np.uint64(3)) % np.uint64(share) == 0]
        m = len(own)
        if not m:
            continue
        least = p.threshold
        if share > 1:
            least -= p.deviations * np.sqrt(0.24 / (1.25 * n / share) * (1 - 1 / share))
        keep_first = m - int(np.ceil(max(0.05, least) * m - 1e-9)) + 1
        at = np.minimum(np.searchsorted(common, own), max(0, len(common) - 1))
        rank = np.where(common[at] == own, counts[at], 0) if len(common) else np.zeros(m, np.int64)
        first = np.lexsort((own, rank))[: min(m, keep_first)]
        out.append((own[first] ^ np.uint64(tag)).view(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _encoder(p: CellParams, order):
    """``order`` is the broadcast (common coordinates, their counts)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = K.WordHash()
        common, counts = order.value
        for batch in it:
            cols: list[list] = [[] for _ in range(9)]
            for title, content, url in zip(*(batch.column(c).to_pylist() for c in ("title", "content", "url")), strict=True):
                url = canonicalize_url(url)
                key = K.set_digest(np.frombuffer(url.encode(errors="replace"), np.uint8)) if url else None
                body = K.words(content)
                row = (key, *[None] * 8)
                if len(body) >= p.min_words:
                    sh = np.unique(K.shingle_hashes(memo.of(K.words(title) + body), p.shingle))
                    if len(sh):
                        row = (key, K.set_digest(sh), len(sh), *_code(sh), vec := pack(sh), first_coordinates(sh, p, common, counts), *bitmap(vec))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("epoch"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=[c.split()[0] for c in _VECTORS.split(", ")],
            )

    return run


def _counter(p: CellParams):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = K.WordHash()
        for batch in it:
            sets = [K.shingle_set(f"{t or ''}\n{c or ''}", memo, p.shingle) for t, c in zip(batch.column("title").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            h, n = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    return run


def fit_order(history: DataFrame, p: CellParams) -> DataFrame:
    """(h, n): coordinates that are common in a bounded sample, with their counts.

    At most ``fit_rows * average shingles / fit_least`` of them: a bound that
    does not depend on the size of the history.
    """
    sample = hash_sample(history.where("content is not null"), "doc", p.fit_rows).select("title", "content")
    return sample.mapInArrow(_counter(p), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= p.fit_least)


def _rerank(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        sims = [K.jaccard(unpack(x), unpack(y)) for x, y in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("hit"), pa.array(sims, pa.float64()), batch.column("more")], names=["query", "hit", "similarity", "more"])


_FOUND = "query long, hit long, similarity double, more boolean"
_ANSWERS = "query long, hit long, similarity double, good boolean, more boolean, epoch int"


def _names_of(vectors: DataFrame) -> DataFrame:
    """(doc, epoch, kind, name): the address (0) and the digest (1) of every vector that has them; a name tells kinds apart."""
    pair = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(kind), c)).alias("name"))
    return vectors.select("doc", "epoch", F.explode(F.array(pair(0, "url_key"), pair(1, "digest"))).alias("x")).select("doc", "epoch", "x.kind", "x.name").where("name is not null")


def _taken(seen: Observation, table: DataFrame, **counts: Column) -> dict[str, int]:
    """Counts observed while a table was written; an empty plan may be written without being run, and is counted then."""
    try:
        got = seen.get
    except Py4JJavaError:
        got = {}
    return got if set(counts) <= set(got) else table.agg(*(c.alias(k) for k, c in counts.items())).first().asDict()


def _kept(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """A kept table and how many rows it has."""
    seen, rows = Observation(), F.count(F.lit(1))
    table = keep(df.observe(seen, rows.alias("rows")), name)
    return table, _taken(seen, table, rows=rows)["rows"]


class HistoryIndex:
    """Cells, vectors and names in one folder: ``stage`` batches, ask ``repeats``, ``append``."""

    def __init__(self, spark: SparkSession, path: str, p: CellParams) -> None:
        self.spark, self.path, self.p = spark, path, p
        order = spark.read.parquet(f"{path}/order").toArrow()
        h = order.column("h").to_numpy().view(np.uint64)
        by = np.argsort(h)
        self._order = spark.sparkContext.broadcast((h[by], order.column("n").to_numpy()[by]))
        tag = uuid.uuid4().hex
        self._names, self._cells = f"names_{tag}", f"cells_{tag}"
        for name, schema, key, by in ((self._names, _NAMES, "name", "epoch"), (self._cells, _CELLS, "key", "epoch, leads")):
            spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet PARTITIONED BY ({by}) CLUSTERED BY ({key}) INTO {p.parts} BUCKETS LOCATION '{path}/{name.split('_')[0]}'")
        #: Of every prepared batch: rows of its cells, and rows beside the leaders.
        self._sizes: dict[int, tuple[int, int]] = {}
        self._log = self._read_log()
        #: Epochs whose names are stored: those that a stage wrote.
        self._named: list[int] = list(self._log)

    @classmethod
    def create(cls, history: DataFrame, p: CellParams = CellParams(), path: str | None = None) -> HistoryIndex:
        """A new, empty index whose coordinate order is fitted on a sample of the history (doc, title, content)."""
        spark = history.sparkSession
        path = path or f"{scratch_dir(spark)}/newsloom/index-{uuid.uuid4().hex}"
        fit_order(history, p).coalesce(1).write.parquet(f"{path}/order")
        spark.createDataFrame([(json.dumps(dataclasses.asdict(p)),)], "params string").coalesce(1).write.parquet(f"{path}/params")
        return cls(spark, path, p)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> HistoryIndex:
        """The index that another process made in this folder."""
        index = cls(spark, path, CellParams(**json.loads(spark.read.parquet(f"{path}/params").first()["params"])))
        if index._log:
            for name in (index._names, index._cells):
                spark.sql(f"MSCK REPAIR TABLE {name}")
        return index

    def close(self) -> None:
        """Forget the tables' names; the folder stays."""
        for name in (self._names, self._cells):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._order.unpersist()

    def _file(self, name: str) -> tuple:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _read_log(self) -> dict[int, tuple[int, int]]:
        """The appended batches: one empty file each, whose name says its sizes too."""
        fs, place = self._file("log")
        names = [x.getPath().getName() for x in fs.listStatus(place)] if fs.exists(place) else []
        parts = [[int(n) for n in x.split("-")[1:]] for x in names if x.startswith("batch-")]
        return {e: (cells, beside) for e, cells, beside in parts}

    def appended(self) -> list[int]:
        """The epochs that queries see: one number a batch."""
        return sorted(self._log)

    def vectors(self, epochs: list[int]) -> DataFrame:
        return self.spark.read.schema(_VECTORS).parquet(f"{self.path}/vectors").where(F.col("epoch").isin(epochs))

    def stage(self, docs: DataFrame) -> None:
        """Encode the documents (doc, epoch, title, content, url) of one or more new batches; queries do not see them yet."""
        docs = docs.where("doc is not null and epoch is not null").select("doc", F.col("epoch").cast("int").alias("epoch"), "title", "content", "url")
        coded = docs.mapInArrow(_encoder(self.p, self._order), _VECTORS)
        writer = coded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        writer.partitionBy("epoch").parquet(f"{self.path}/vectors")
        staged = self.spark.read.schema(_VECTORS).parquet(f"{self.path}/vectors").where(~F.col("epoch").isin(self._named))
        self._bucketed(_names_of(staged).select("name", "epoch").distinct(), self._names, "name", F.col("name"), ["epoch"])
        self._named += [r["epoch"] for r in self.spark.table(self._names).where(~F.col("epoch").isin(self._named)).select("epoch").distinct().collect()]

    def _bucketed(self, df: DataFrame, name: str, key: str, place: Column | None, by: list[str]) -> None:
        # Placed by its key, one task writes one bucket, so that every batch adds one file to it.
        writer = (df if place is None else df.repartition(self.p.parts, place)).write.mode("append").format("parquet").option("compression", "zstd")
        writer.partitionBy(*by).bucketBy(self.p.parts, key).saveAsTable(name)

    def state(self, epochs: list[int]) -> DataFrame:
        """(doc, digest, by_url, by_copy, epoch) of prepared batches."""
        return self.spark.read.schema("doc long, digest long, by_url boolean, by_copy boolean, epoch int").parquet(f"{self.path}/state").where(F.col("epoch").isin(epochs))

    def _prepare(self, epoch: int) -> None:
        """Look a batch's names up, and write the cells of its new vectors into buckets that only its own queries read."""
        if epoch in self._sizes or epoch in self._log:
            return
        p = self.p
        own = self.vectors([epoch])
        state = own.select("doc", "digest")
        if self._log:
            known = self.spark.table(self._names).where(F.col("epoch").isin(self.appended())).select("name")
            met = _names_of(own).join(known, "name", "left_semi").groupBy("doc").agg(F.bool_or(F.col("kind") == 0).alias("by_url"), F.bool_or(F.col("kind") == 1).alias("by_copy"))
            state = state.join(met, "doc", "left")
        else:
            state = state.withColumns({"by_url": F.lit(False), "by_copy": F.lit(False)})
        state = state.select("doc", "digest", F.coalesce("by_url", F.lit(False)).alias("by_url"), F.coalesce("by_copy", F.lit(False)).alias("by_copy"), F.lit(epoch).alias("epoch"))
        state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{self.path}/state")
        # Copies have no cells. They are the fewer rows by far: taken out, they leave the others where they are.
        state = self.state([epoch]).where("digest is not null")
        equal = state.where("not by_copy").groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
        twins = state.where("not by_copy").join(equal, "digest").where("doc <> first").select("doc", "digest")
        copies, n = _kept(state.where("by_copy").select("doc", "digest").unionByName(twins).distinct(), "p3-copies")
        new = own.where("digest is not null").join(small_side(copies, n), ["doc", "digest"], "left_anti")
        cells = new.select(F.explode("cells").alias("key"), "doc", "n", "code1", "code2", "epoch")
        # One exchange by bucket serves the counts and the write.
        placed = cells.repartition(p.parts, "key").withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("key")))
        leads = (F.col("members") <= p.leaders) | (F.pmod(F.xxhash64("doc", F.lit(5)), F.col("members")) < p.leaders)
        seen = Observation()
        marked = placed.withColumn("leads", leads).select("key", "doc", "n", "code1", "code2", "leads", "epoch")
        counted = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("leads")).alias("beside"))
        self._bucketed(counted, self._cells, "key", None, ["epoch", "leads"])
        got = _taken(seen, self.spark.table(self._cells).where(F.col("epoch") == epoch), rows=F.count(F.lit(1)), beside=F.count_if(~F.col("leads")))
        self._sizes[epoch] = (got["rows"], got["beside"])

    def append(self, epoch: int) -> None:
        """From now on, queries see the batch."""
        self._prepare(epoch)
        if epoch not in self._log:
            fs, place = self._file(f"log/batch-{epoch}-{self._sizes[epoch][0]}-{self._sizes[epoch][1]}")
            fs.create(place).close()
            self._log[epoch] = self._sizes.pop(epoch)
            self._let_go()

    def _let_go(self) -> None:
        """Free what a finished batch left: shuffles and broadcasts are only removed, and the driver's heap only shrinks, once the driver collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _met(self, queries: DataFrame, cells: DataFrame) -> DataFrame:
        """(query, hit, alike) of queries and stored vectors that meet in a cell and may reach the threshold."""
        p = self.p
        own = queries.select("key", F.col("doc").alias("query"), F.col("n").alias("qn"), F.col("code1").alias("q1"), F.col("code2").alias("q2"))
        alike = shared_places([("code1", "q1"), ("code2", "q2")])
        near = (F.least("n", "qn") >= F.lit(p.threshold - 1e-9) * F.greatest("n", "qn")) & (alike >= p.least_code)
        return cells.join(own, "key").where(near).select("query", F.col("doc").alias("hit"), alike.alias("alike"))

    def _compared(self, pairs: DataFrame, rows: int, epoch: int) -> DataFrame:
        """(query, hit, similarity, more) of the pairs (query, hit, more), exactly, from the full vectors."""
        small = F.broadcast if rows <= 100_000 else (lambda df: df)
        mine = self.vectors([epoch]).select(F.col("doc").alias("query"), F.col("vec").alias("va"))
        theirs = self.vectors(self.appended()).select(F.col("doc").alias("hit"), F.col("vec").alias("vb"))
        both = mine.join(small(pairs), "query")
        # The few vectors that were hit are taken out of the history before anything travels.
        asked = pairs.select("hit") if rows <= 100_000 else pairs.select("hit").distinct()
        hits = theirs.join(small(asked), "hit", "left_semi")
        return both.join(hits, "hit").select("query", "hit", "va", "vb", "more").mapInArrow(_rerank, _FOUND)

    def _close(self, pairs: DataFrame, rows: int, epoch: int) -> DataFrame:
        """The pairs (query, hit, more) that may reach the threshold by their vectors' bits: no match is lost, and few full vectors travel."""
        small = F.broadcast if rows <= 100_000 else (lambda df: df)
        mine = self.vectors([epoch]).select(F.col("doc").alias("query"), F.col("bits").alias("qbits"), F.col("over").alias("qover"))
        theirs = self.vectors(self.appended()).select(F.col("doc").alias("hit"), "bits", "over")
        asked = pairs.select("hit") if rows <= 100_000 else pairs.select("hit").distinct()
        both = mine.join(small(pairs), "query").join(theirs.join(small(asked), "hit", "left_semi"), "hit")
        t = self.p.threshold
        sizes = _ones(F.col("bits")) + F.col("over") + _ones(F.col("qbits")) + F.col("qover")
        close = shared_at_most() * (1 + t) >= t * sizes - 1e-6
        return both.where(F.coalesce(close, F.lit(True))).select("query", "hit", "more")

    def ask(self, epoch: int) -> None:
        """Probe the appended batches for a staged one and store what its documents repeat."""
        self._prepare(epoch)
        if not self._log or epoch in self._log:
            return
        p = self.p
        cells = self.spark.table(self._cells)
        own = cells.where(F.col("epoch") == epoch)
        stored = cells.where(F.col("epoch").isin(self.appended()))
        table = (lambda df: df.hint("shuffle_hash")) if self._sizes[epoch][0] <= p.table_rows * p.parts else (lambda df: df)
        nearest = self._met(table(own), stored.where("leads")).groupBy("query").agg(F.max(F.struct("alike", "hit")).alias("best"), F.min("hit").alias("low"), F.max("hit").alias("high"))
        first, n = _kept(nearest.select("query", F.col("best.hit").alias("hit"), (F.col("low") < F.col("high")).alias("more")), "p3-nearest")
        good = F.col("similarity") >= p.threshold - 1e-12
        beside = any(b for _, b in self._log.values())
        # Every hit has a stored vector, so that each query comes back once, with what it was sent with.
        tried = self._compared(first, n, epoch).select("query", "hit", "similarity", good.alias("good"), "more")
        seen = Observation()
        counts = {"open": F.count_if(~F.col("good") & F.col("more")), "answered": F.count_if("good")}
        self._answer(tried.observe(seen, *(c.alias(k) for k, c in counts.items())), epoch, "overwrite")
        tried = self.spark.read.schema(_ANSWERS).parquet(f"{self.path}/answers").where(F.col("epoch") == epoch)
        got = _taken(seen, tried, **counts)
        if got["open"] or beside:
            # Queries are chosen in their buckets, so that the batch's cells stay where they are.
            of = lambda which, n: small_side(tried.where(which).select(F.col("query").alias("doc")), n)
            met = self._met(table(own.join(of("more and not good", got["open"]), "doc", "left_semi")), stored.where("leads"))
            if beside:
                # Leaders alone may miss what is kept beside them: then every query without an answer goes on.
                met = met.unionByName(self._met(table(own.join(of("good", got["answered"]), "doc", "left_anti")), stored.where("not leads")))
            pairs, n = _kept(met.select("query", "hit", F.lit(False).alias("more")).distinct(), "p3-pairs")
            close, n = _kept(self._close(pairs, n, epoch), "p3-close")
            more = self._compared(close, n, epoch).where(good).groupBy("query").agg(F.max(F.struct("similarity", "hit")).alias("b"))
            self._answer(more.select("query", "b.hit", "b.similarity", F.lit(True).alias("good"), F.lit(False).alias("more")), epoch, "append")

    def _answer(self, found: DataFrame, epoch: int, mode: str) -> None:
        writer = found.withColumn("epoch", F.lit(epoch)).write.mode(mode).option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("epoch").parquet(f"{self.path}/answers")

    def answers(self, epochs: list[int]) -> DataFrame:
        """(doc, epoch, by, hit, similarity) of every document of the asked batches that repeats one appended before.

        by is 'url', 'copy' or 'near', the first that holds; hit and similarity
        are given for 'near'.
        """
        state = self.state(epochs)
        by = F.when(F.col("by_url"), "url").when(F.col("by_copy"), "copy").otherwise("near")
        fs, place = self._file("answers")
        if not fs.exists(place):
            return state.where("by_url or by_copy").select("doc", "epoch", by.alias("by"), F.lit(None).cast("long").alias("hit"), F.lit(None).cast("double").alias("similarity"))
        near = self.spark.read.schema(_ANSWERS).parquet(f"{self.path}/answers").where(F.col("good") & F.col("epoch").isin(epochs))
        # What the first document of equal vectors repeats, its copies in the batch repeat too.
        firsts = state.where("digest is not null and not by_copy").groupBy("epoch", "digest").agg(F.min("doc").alias("query"))
        like = firsts.join(near, ["epoch", "query"]).select("epoch", "digest", "hit", "similarity")
        joined = state.join(like, ["epoch", "digest"], "left").where("by_url or by_copy or hit is not null")
        mine = ~F.col("by_url") & ~F.col("by_copy")
        return joined.select("doc", "epoch", by.alias("by"), F.when(mine, F.col("hit")).alias("hit"), F.when(mine, F.col("similarity")).alias("similarity"))

    def repeats(self, epoch: int) -> DataFrame:
        """What a staged batch repeats of the appended ones; see ``answers``."""
        self.ask(epoch)
        return self.answers([epoch])
