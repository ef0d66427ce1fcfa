"""Problem 9: mixing sources to target weights, by a time-varying curriculum.

Training time runs from 0 to 1.  A source's weight is a schedule w(t), linear
between its start and its end and integrating to its target share, so that the
whole mixture has the wanted shares.  With total size T, a source must have
delivered D(t) = T * integral of w from 0 to t by time t.  Copies of its
documents lie one after the other, in a seeded order, on its own axis of tokens;
the document that begins at token c is due at the time t with D(t) = c, found by
inverting the integral in closed form.  Positions are these times, and the
mixture is the range-sorted table of (position, source, document, copy).

A source gives at most ``max_repeats`` copies of each document.  T is the
largest size at which every source can give its share; where a target source
occurs nowhere, or the caps bind at another total, the shares are reached among
the sources that occur and are reported next to the wanted ones.

Token counts come from a public tokenizer, whole texts, all documents.  Running
sums within a source are taken over hash buckets in two steps, so that no source
is sorted or summed in a single task.

Defined results: documents without an id, text or source, of sources that are
not targets, or without tokens do not take part; targets with a null source,
share or cap, or a share or cap of zero, take nothing; equal documents count
each; an empty table gives an empty mixture and a report of zero shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.io import keep


@dataclass(frozen=True)
class MixParams:
    tokenizer: str = "/opt/tokenizers/byte_bpe_50k.json"
    seed: int = 7
    #: Weight at the end of training over the weight at its start, by source; 1 where none is given.
    drift: tuple[tuple[str, float], ...] = ()
    #: A bucket of the running sums holds about so many documents.
    bucket_rows: int = 100_000


def _token_counter(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for batch in it:
            texts = batch.column("text").to_pylist()
            counts = []
            for k in range(0, len(texts), 256):
                counts += [len(e.ids) for e in tokenizer.encode_batch_fast(texts[k : k + 256], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(counts, pa.int64())], names=["id", "source", "tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer: str = MixParams.tokenizer) -> DataFrame:
    """(id, source, tokens) of documents (id, source, text)."""
    documents = documents.where("id is not null and source is not null and text is not null").select("id", "source", "text")
    return documents.mapInArrow(_token_counter(tokenizer), "id long, source string, tokens long")


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, share, max_repeats, tokens, rows, quota) of every valid target.

    ``sizes`` (source, tokens, rows); ``share`` is the wanted share among the sources
    that occur, ``quota`` the tokens that the source is to give.
    """
    valid = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = valid.join(sizes, "source", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "rows": F.coalesce("rows", F.lit(0))})
    here = F.when(F.col("tokens") > 0, F.col("target_share")).otherwise(0.0)
    # One row per target: the table is as small as the list of sources.
    every = Window.partitionBy(F.lit(1))
    share = F.try_divide(here, F.sum(here).over(every))
    total = F.min(F.when(F.col("tokens") > 0, F.col("tokens") * F.col("max_repeats") / F.col("share"))).over(every)
    return joined.withColumn("share", F.coalesce(share, F.lit(0.0))).withColumn("quota", F.coalesce(F.col("share") * total, F.lit(0.0)))


def due(delivered: Column, drift: Column) -> Column:
    """The time in [0, 1] by which a share ``delivered`` of the quota is out.

    The weight runs linearly from a to a * drift with mean 1, so that the
    integral is a t + a (drift - 1) t^2 / 2; this is its inverse.
    """
    a = 2.0 / (1.0 + drift)
    half = a * (drift - 1.0) / 2.0
    root = F.sqrt(F.greatest(F.lit(0.0), a * a + 4.0 * half * delivered))
    return 2.0 * delivered / (a + root)


def mixture(documents: DataFrame, targets: DataFrame, p: MixParams = MixParams()) -> tuple[DataFrame, DataFrame]:
    """(mixture, report) of documents (id, source, text) and targets (source, target_share, max_repeats).

    mixture(position, source, id, copy, tokens): in training order by position;
    report(source, target_share, share, reached_share, tokens, documents,
    mean_repeats, max_copy): one row per target.
    """
    sized = keep(token_counts(documents, p.tokenizer).where("tokens > 0"), "p9-sizes")
    sizes = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    quotas = keep(plan(sizes, targets), "p9-plan")
    used = sized.join(quotas.where("quota > 0").select("source", F.col("tokens").alias("source_tokens"), F.col("rows").alias("source_rows"), "quota", "max_repeats"), "source")
    # Order within a copy: by a seeded hash; its leading part is the bucket.
    # A source has as many buckets as its documents fill, so that none grows with it.
    buckets = F.ceil(F.col("source_rows") / p.bucket_rows)
    placed = used.withColumn("h", F.xxhash64(F.lit(p.seed), "id")).withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * buckets).cast("int"))
    by_bucket = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = by_bucket.select("source", "bucket", (F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    inner = Window.partitionBy("source", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    based = placed.join(before, ["source", "bucket"]).withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    copies = F.sequence(F.lit(0), F.least(F.col("max_repeats") - 1, F.floor((F.col("quota") - 0.5) / F.col("source_tokens")).cast("int")))
    drawn = based.select("source", "id", "tokens", "quota", "start", "source_tokens", F.explode(copies).alias("copy"))
    drawn = drawn.withColumn("at", F.col("start") + F.col("copy") * F.col("source_tokens")).where("at + tokens / 2 <= quota")
    drift = F.lit(1.0)
    for source, ratio in p.drift:
        drift = F.when(F.col("source") == source, F.lit(float(ratio))).otherwise(drift)
    mixed = drawn.select(due(F.col("at") / F.col("quota"), drift).alias("position"), "source", "id", (F.col("copy") + 1).cast("int").alias("copy"), "tokens")
    mixed = keep(mixed, "p9-mixture")
    reached = mixed.groupBy("source").agg(F.sum("tokens").alias("drawn"), F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("documents"), F.max("copy").alias("max_copy"))
    every = Window.partitionBy(F.lit(1))
    report = quotas.select("source", "target_share", "share").join(reached, "source", "left").select(
        "source",
        "target_share",
        "share",
        F.coalesce(F.col("drawn") / F.sum("drawn").over(every), F.lit(0.0)).alias("reached_share"),
        F.coalesce("drawn", F.lit(0)).cast("long").alias("tokens"),
        F.coalesce("documents", F.lit(0)).cast("long").alias("documents"),
        F.coalesce(F.col("rows") / F.col("documents"), F.lit(0.0)).alias("mean_repeats"),
        F.coalesce("max_copy", F.lit(0)).cast("int").alias("max_copy"),
    )
    return mixed.orderBy("position", "source", "id", "copy"), report
