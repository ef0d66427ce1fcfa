"""Sentiment by a valence lexicon, as joins and array expressions.

A text is an array of sentences, a sentence an array of tokens.  Tokens meet the
lexicon, spelled out with its inflected forms as a small table, in a broadcast
join; only those that are in it are looked at further, each with the tokens
before it.  Sentences and texts are partial aggregates.

Defined results: null and empty texts are neutral with confidence 0; sentences
without a word do not count; rows with a null id are kept as one row each only if
the id is unique, as ids are expected to be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import lexicons as L
from newsloom.functions.columns import round4

TOKEN = "[A-Za-z']+|[!?]+"


def word_forms(polarity: dict[str, float] = L.POLARITY) -> dict[str, float]:
    """The lexicon with every inflected form; a form counts nine tenths of the word that the first fitting ending leads to."""
    forms: dict[str, tuple[int, float]] = {}
    for word, value in polarity.items():
        for rank, (ending, instead) in enumerate(L.ENDINGS):
            stem = word.removesuffix(instead)
            if word.endswith(instead) and len(stem) > 2 and rank < forms.get(stem + ending, (99, 0.0))[0]:
                forms[stem + ending] = (rank, 0.9 * value)
    return {form: value for form, (_, value) in sorted(forms.items())} | polarity


def lexicon_table(spark: SparkSession, polarity: dict[str, float] = L.POLARITY) -> DataFrame:
    """(word, polarity): some thousand rows whatever the texts are."""
    return spark.createDataFrame(list(word_forms(polarity).items()), "word string, polarity double")


def label_of(score: Column) -> Column:
    return F.when(score <= -0.5, "very_negative").when(score <= -0.1, "negative").when(score < 0.1, "neutral").when(score < 0.5, "positive").otherwise("very_positive")


def _literals(words: frozenset[str]) -> Column:
    return F.array(*(F.lit(w) for w in sorted(words)))


def sentiment(texts: DataFrame, polarity: dict[str, float] = L.POLARITY) -> DataFrame:
    """(id, score, label, confidence, positive, negative) of texts (id, text)."""
    ended = F.regexp_replace(F.coalesce("text", F.lit("")), r"([.!?])\s+", "$1\n")
    sentences = F.filter(F.transform(F.split(ended, "\n+"), lambda s: F.struct(s.alias("raw"), F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0)).alias("w"), F.regexp_extract_all(F.lower(s), F.lit(TOKEN), F.lit(0)).alias("low"))), lambda s: F.size(s["w"]) > 0)
    read = texts.select("id", sentences.alias("s"))
    sizes = read.select("id", F.size("s").alias("sentences"), F.aggregate("s", F.lit(0), lambda n, s: n + F.size(s["w"])).alias("words"))
    each = read.select("id", F.posexplode("s").alias("no", "s")).select("id", "no", "s.raw", "s.low", "s.w")
    # What a token needs of its sentence goes with it; the sentence itself does not.
    negation = lambda k: F.coalesce(F.array_contains(_literals(L.NEGATIONS), F.get("low", k)), F.lit(False))
    context = lambda w, k: F.struct(
        w.alias("word"),
        k.alias("k"),
        F.get("low", k - 1).alias("before"),
        (negation(k - 1) | negation(k - 2) | negation(k - 3)).alias("negated"),
    )
    turn = F.array_position(F.transform("low", lambda x: F.array_contains(_literals(L.CONTRASTS), x)), True)
    marks = F.length("raw") - F.length(F.replace("raw", F.lit("!"), F.lit("")))
    stress = F.least(F.lit(1.75), 1.0 + 0.25 * marks + 0.1 * F.contains("raw", F.lit("?")).cast("int"))
    judged = each.select("id", "no", turn.alias("turn"), stress.alias("stress"), "w", "low")
    tokens = judged.select("id", "no", "turn", "stress", F.explode(F.transform("w", context)).alias("t")).select("id", "no", "turn", "stress", "t.*")
    known = tokens.join(F.broadcast(lexicon_table(texts.sparkSession, polarity).withColumnRenamed("word", "known")), F.lower("word") == F.col("known"))
    factors = F.create_map(*(F.lit(x) for pair in L.INTENSITY.items() for x in pair))
    value = (
        F.col("polarity")
        * F.when(F.col("k") > 0, F.coalesce(F.element_at(factors, F.col("before")), F.lit(1.0))).otherwise(1.0)
        * F.when((F.length("word") > 2) & F.col("word").rlike("[A-Z]") & ~F.col("word").rlike("[a-z]"), 1.3).otherwise(1.0)
        * F.when(F.col("negated"), -0.75).otherwise(1.0)
        * F.when(F.col("turn") == 0, 1.0).when(F.col("k") + 1 < F.col("turn"), 0.5).otherwise(1.5)
    )
    felt = known.select("id", "no", F.greatest(F.lit(-2.0), F.least(F.lit(2.0), value * F.col("stress"))).alias("v"))
    of_sentence = felt.groupBy("id", "no").agg((F.sum("v") / F.sqrt(F.count(F.lit(1)) + 3.0)).alias("v"), F.count(F.lit(1)).alias("hits"), F.count_if(F.col("v") > 0).alias("positive"), F.count_if(F.col("v") < 0).alias("negative"))
    of_text = of_sentence.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("v", "hits", "positive", "negative")))
    joined = sizes.join(of_text, "id", "left")
    score = F.coalesce(F.tanh(1.6 * F.col("v") / F.col("sentences")), F.lit(0.0))
    density = F.least(F.lit(1.0), F.coalesce("hits", F.lit(0)) / F.greatest(F.lit(8.0), 0.08 * F.col("words")))
    sure = F.coalesce(F.least(F.lit(1.0), 0.35 * density + 0.65 * F.abs(score)), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("id", round4(score).alias("score"), label_of(score).alias("label"), round4(sure).alias("confidence"), zero("positive"), zero("negative"))


def sentiment_sql(table: str, key: str, text: str) -> str:
    """The same in SQL, with the lexicon expanded by a join of words and endings."""
    words = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in L.POLARITY.items())
    endings = ", ".join(f"({k}, '{e}', '{i}')" for k, (e, i) in enumerate(L.ENDINGS))
    factors = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in L.INTENSITY.items())
    listed = lambda ws: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(ws)) + "]"
    q4 = lambda x: f"floor(({x}) * 10000.0::DOUBLE + 0.5::DOUBLE + 1e-9::DOUBLE) / 10000.0::DOUBLE"
    return rf"""WITH base(word, p) AS (VALUES {words}), ends(r, e, i) AS (VALUES {endings}), fac(word, f) AS (VALUES {factors}),
forms AS (SELECT left(word, length(word) - length(i)) || e AS word, 0.9::DOUBLE * p AS p, r FROM base, ends WHERE suffix(word, i) AND length(word) - length(i) > 2),
lex AS (SELECT word, p FROM base UNION ALL SELECT word, arg_min(p, r) FROM forms WHERE word NOT IN (SELECT word FROM base) GROUP BY word),
sp AS (SELECT {key} AS id, string_split_regex(regexp_replace(coalesce({text}, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') AS s FROM {table}),
se AS (SELECT id, generate_subscripts(s, 1) AS no, unnest(s) AS raw FROM sp), tk AS (SELECT id, no, raw, regexp_extract_all(raw, '{TOKEN.replace("'", "''")}') AS w FROM se), ok AS (SELECT *, list_transform(w, lambda x: lower(x)) AS low FROM tk WHERE len(w) > 0),
sz AS (SELECT sp.id, count(ok.no) AS sentences, coalesce(sum(len(ok.w)), 0) AS words FROM sp LEFT JOIN ok ON sp.id = ok.id GROUP BY sp.id),
wd AS (SELECT id, no, raw, low, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM ok),
ft AS (SELECT id, no, greatest(-2.0::DOUBLE, least(2.0::DOUBLE, p * CASE WHEN k > 1 THEN coalesce(f, 1.0::DOUBLE) ELSE 1.0::DOUBLE END * CASE WHEN length(wd.word) > 2 AND regexp_matches(wd.word, '[A-Z]') AND NOT regexp_matches(wd.word, '[a-z]') THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END
 * CASE WHEN list_has_any(low[greatest(1, k - 3) : k - 1], {listed(L.NEGATIONS)}) THEN -0.75::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN turn IS NULL THEN 1.0::DOUBLE WHEN k < turn THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END
 * least(1.75::DOUBLE, 1.0::DOUBLE + 0.25::DOUBLE * (length(raw) - length(replace(raw, '!', ''))) + 0.1::DOUBLE * contains(raw, '?')::INT))) AS v
 FROM (SELECT *, list_position(list_transform(low, lambda x: list_contains({listed(L.CONTRASTS)}, x)), true) AS turn FROM wd) wd JOIN lex ON lower(wd.word) = lex.word LEFT JOIN fac ON fac.word = low[k - 1]),
sn AS (SELECT id, no, sum(v) / sqrt(count(*) + 3.0::DOUBLE) AS v, count(*) AS hits, count(CASE WHEN v > 0 THEN 1 END) AS pos, count(CASE WHEN v < 0 THEN 1 END) AS neg FROM ft GROUP BY 1, 2),
tx AS (SELECT id, sum(v) AS v, sum(hits) AS hits, sum(pos)::BIGINT AS positive, sum(neg)::BIGINT AS negative FROM sn GROUP BY 1),
sc AS (SELECT sz.id, coalesce(tanh(1.6::DOUBLE * v / sentences), 0.0::DOUBLE) AS score, least(1.0::DOUBLE, coalesce(hits, 0) / greatest(8.0::DOUBLE, 0.08::DOUBLE * words)) AS density, positive, negative FROM sz LEFT JOIN tx ON sz.id = tx.id)
SELECT id, {q4("score")} AS score, CASE WHEN score <= -0.5 THEN 'very_negative' WHEN score <= -0.1 THEN 'negative' WHEN score < 0.1 THEN 'neutral' WHEN score < 0.5 THEN 'positive' ELSE 'very_positive' END AS label,
{q4("coalesce(least(1.0::DOUBLE, 0.35::DOUBLE * density + 0.65::DOUBLE * abs(score)), 0.0::DOUBLE)")} AS confidence, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative FROM sc"""
