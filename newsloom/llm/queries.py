"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.io import table
from newsloom.llm import history_index as hi
from newsloom.llm import languages as lg
from newsloom.llm import leakage
from newsloom.llm import main_content as mc
from newsloom.llm import mixture as mx
from newsloom.llm import near_duplicates as nd
from newsloom.llm import repeated_lines as rl
from newsloom.llm import shared_spans as ss
from newsloom.llm import truncation as tr

Query = Callable[[SparkSession, str], DataFrame]

#: The similarity that TESTDATA.md states for problems 1 and 3.
NEAR = nd.Forest(threshold=0.6, shingle=3, min_words=20)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "raw_articles").select(F.col("raw_id").alias("id"), "title", "content")
    classes, links = nd.near_duplicates(records, NEAR)
    return nd.all_pairs(classes, links).select(F.col("a").alias("raw_id_a"), F.col("b").alias("raw_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """The class, the component and the number of links of every item with enough words."""
    records = table(spark, d, "raw_articles").select(F.col("raw_id").alias("id"), "title", "content")
    return nd.groups(*nd.near_duplicates(records, NEAR)).withColumnRenamed("id", "raw_id")


def _fields(spark: SparkSession, d: str) -> DataFrame:
    value = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("description", "content")))).alias("v")
    items = table(spark, d, "raw_articles").select(F.col("raw_id").alias("id"), F.col("source_slug").alias("source"), "source_name", "title", value)
    return items.select("id", "source", "source_name", "title", "v.field", "v.value")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return tr.cut_values(_fields(spark, d)).where("is_cut").select(F.col("id").alias("raw_id"), "field")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts each field."""
    return tr.cut_rates(tr.cut_values(_fields(spark, d)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    text = ("title", "content", "url")
    old = table(spark, d, "articles").select((F.col("id") * 2).alias("doc"), F.lit(0).alias("epoch"), *text)
    new = table(spark, d, "raw_articles").select((F.col("raw_id") * 2 + 1).alias("doc"), F.col("batch_no").alias("epoch"), *text)
    index = hi.HistoryIndex.create(old, hi.CellParams(threshold=0.6, shingle=3, min_words=20))
    index.stage(old.unionByName(new))
    index.append(0)
    batches = sorted(r["epoch"] for r in new.where("epoch is not null").select("epoch").distinct().collect())
    # One step a batch: each is asked against what came before it, then appended.
    for batch in batches:
        index.ask(batch)
        index.append(batch)
    index.close()
    return index.answers(batches).select(F.expr("(doc - 1) div 2").alias("raw_id"))


def _site_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_articles").select(F.col("raw_id").alias("id"), F.col("source_slug").alias("source"), "content")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rl.repeated_lines(_site_items(spark, d)).select(F.col("id").alias("raw_id"), "line_no")


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every item without the lines that its source repeats."""
    return rl.without_repeated_lines(_site_items(spark, d)).withColumnRenamed("id", "raw_id")


def p4_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of lines that stand together in many items of a source."""
    found = rl.frequent_sequences(_site_items(spark, d))
    return found.select("source", "length", F.array_join(F.transform("pattern", lambda k: F.hex(k)), " ").alias("pattern"), "support")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_articles").select(F.col("raw_id").alias("id"), F.col("language").alias("label"), "content")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return lg.wrong_labels(lg.languages(_labelled(spark, d))).withColumnRenamed("id", "raw_id")


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language of every content, and of its lines in others, with confidence."""
    return lg.languages(_labelled(spark, d)).withColumnRenamed("id", "raw_id")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    scrapers = table(spark, d, "sources").where("kind = 'scraper'").select(F.col("slug").alias("source_slug")).distinct()
    items = table(spark, d, "raw_articles").join(scrapers, "source_slug", "left_semi")
    return items.select(F.col("raw_id").alias("id"), "source_name", "title", "content")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mc.main_lines(_pages(spark, d)).withColumnRenamed("id", "raw_id")


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    """The main body of every scraped page."""
    return mc.main_text(_pages(spark, d)).withColumnRenamed("id", "raw_id")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_documents(spark, d), table(spark, d, "eval_items")).select("item_id", F.col("id").alias("doc_id")).distinct()


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every document without its leaked passages."""
    docs = _documents(spark, d)
    clean = leakage.without_leaks(docs, leakage.leaks(docs, table(spark, d, "eval_items")))
    return clean.withColumnRenamed("id", "doc_id")


#: News of the first source comes early in training, of the last one late.
DRIFT = mx.MixParams(drift=(("pinport-ledger", 0.5), ("lebriandheim-courier", 2.0)))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return mx.mixture(docs, table(spark, d, "mix_targets"), DRIFT)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture in training order."""
    return _mixed(spark, d)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Reached shares next to the wanted ones."""
    return _mixed(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    classes, spans = ss.shared_spans(_documents(spark, d))
    return nd.all_pairs(classes, spans.select("a", "b").distinct()).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    """For every document, how much of it stands elsewhere too."""
    return ss.shared_share(_documents(spark, d)).withColumnRenamed("id", "doc_id")


def p10_removals(spark: SparkSession, d: str) -> DataFrame:
    """The ranges to remove so that every shared stretch stands in one document of its component."""
    return ss.removals(_documents(spark, d)).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_rates": p2_rates, "p3_found": p3_found, "p4_found": p4_found, "p4_clean": p4_clean, "p4_sequences": p4_sequences, "p6_found": p6_found, "p6_text": p6_text, "p7_found": p7_found, "p7_languages": p7_languages, "p8_found": p8_found, "p8_clean": p8_clean, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_shared": p10_shared, "p10_removals": p10_removals}
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
ORACLES: dict[str, str] = {
    "p1_found": f"""WITH r AS (SELECT raw_id, {_WORDS.format("coalesce(title, '') || chr(10) || content")} AS w FROM raw_articles WHERE content IS NOT NULL AND len({_WORDS.format("content")}) >= 20),
s AS (SELECT DISTINCT raw_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT raw_id, w, unnest(range(1, len(w) - 1)) AS i FROM r)), n AS (SELECT raw_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.raw_id AS a, y.raw_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.raw_id < y.raw_id GROUP BY 1, 2)
SELECT a AS raw_id_a, b AS raw_id_b FROM p JOIN n na ON na.raw_id = a JOIN n nb ON nb.raw_id = b WHERE 10 * c >= 6 * (na.n + nb.n - c)""",
    "p4_found": r"""WITH l AS (SELECT raw_id, source_slug, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::BIGINT AS line_no FROM raw_articles WHERE content IS NOT NULL AND source_slug IS NOT NULL),
k AS (SELECT raw_id, source_slug, line_no, lower(array_to_string(regexp_extract_all(regexp_replace(line, '<[^>]*>', '', 'g'), '\p{L}+'), ' ')) AS k FROM l),
f AS (SELECT source_slug, k FROM k WHERE k <> '' GROUP BY 1, 2 HAVING count(DISTINCT raw_id) >= 6) SELECT raw_id, line_no FROM k JOIN f USING (source_slug, k)""",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)), ig AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i))
SELECT DISTINCT item_id, doc_id FROM dg JOIN ig USING (g)""",
}
