"""Scalar functions as Column expressions; nothing here leaves whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS_DIGITS = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{Nl}\p{No}]+"

# Categories that are written in several ways.
CATEGORY_ALIASES = {
    "tech": "technology", "sci": "science", "sci-tech": "technology", "biz": "business", "finance": "business", "money": "business", "markets": "business",
    "sports": "sport", "football": "sport", "arts": "culture", "entertainment": "culture", "world-news": "world", "international": "world", "global": "world",
    "politics-news": "politics", "government": "politics", "healthcare": "health", "medicine": "health", "environment": "climate", "climate-change": "climate",
}
# Names of languages and their codes.
LANGUAGE_ALIASES = {
    "english": "en", "eng": "en", "german": "de", "deutsch": "de", "ger": "de", "deu": "de", "french": "fr", "français": "fr", "francais": "fr", "fra": "fr", "fre": "fr",
    "spanish": "es", "español": "es", "espanol": "es", "spa": "es", "portuguese": "pt", "português": "pt", "portugues": "pt", "por": "pt",
    "italian": "it", "italiano": "it", "ita": "it", "dutch": "nl", "nederlands": "nl", "nld": "nl", "turkish": "tr", "tur": "tr", "arabic": "ar", "ara": "ar", "russian": "ru", "rus": "ru",
}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def round4(x: Column) -> Column:
    """Four decimals, halves up, by operations that are equal in every IEEE engine."""
    return F.floor(x * 10000.0 + 0.5 + 1e-9) / 10000.0


def percentage_change(before: Column, now: Column) -> Column:
    return F.when(before == 0, 100.0 * now).otherwise((now - before) / F.abs(before) * 100.0)


def normalize_for_hash(text: Column) -> Column:
    """Lower case, letters, digits and underscores, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def content_fingerprint(text: Column) -> Column:
    return F.sha2(normalize_for_hash(text), 256)


def stable_external_id(slug: Column, canonical_url: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", slug, canonical_url), 256), 1, 32)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(LETTERS_DIGITS)), F.lit(0)).cast("long")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS_DIGITS), F.lit(0))


def terms(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Words of two letters and more, without digits and stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    stop = F.array(*map(F.lit, stopwords)) if stopwords else None
    return F.filter(found, lambda w: (F.char_length(w) >= 2) & (~F.array_contains(stop, w) if stop is not None else F.lit(True)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


def like_pattern(text: str) -> str:
    """A LIKE pattern that finds a text as it is."""
    for c in ("\\", "%", "_"):
        text = text.replace(c, "\\" + c)
    return f"%{text}%"


def contains_text(column: Column, text: str) -> Column:
    return F.coalesce(F.lower(column).contains(text.lower()), F.lit(False))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def _alias(value: Column, aliases: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.element_at(table, value)


def normalize_category(text: Column) -> Column:
    slug = slugify(text)
    return F.when(slug == "", None).otherwise(F.coalesce(_alias(slug, CATEGORY_ALIASES), F.substring(slug, 1, 48)))


def normalize_language(text: Column) -> Column:
    """A two-letter code, by name, three-letter code or the part before a region; else null."""
    value = F.regexp_replace(F.lower(F.trim(text)), "_", "-")
    base = F.element_at(F.split(value, "-"), 1)
    known = F.coalesce(_alias(value, LANGUAGE_ALIASES), _alias(base, LANGUAGE_ALIASES))
    return F.coalesce(known, F.when(base.rlike("^[a-z]{2}$"), base))


def normalize_country(text: Column) -> Column:
    value = F.upper(F.trim(text))
    return F.when(value.rlike("^[A-Z]{2}$"), value).when(value.rlike("-[A-Z]{2}$"), F.regexp_extract(value, "-([A-Z]{2})$", 1))


def normalize_author(text: Column) -> Column:
    """The first name of a byline, without its prefix and the staff part."""
    bare = F.regexp_replace(F.trim(text), r"(?i)^(by|von|par|por|de|text|words)\s*:?\s+", "")
    parts = F.transform(F.split(bare, r"\s*[,;/|&]\s*|\s+(?:and|und|et|y|e)\s+"), lambda x: F.trim(x))
    good = F.filter(parts, lambda x: F.char_length(x).between(2, 200) & x.rlike(r"\p{L}") & ~F.lower(x).isin("staff", "editor", "newsroom", "agency") & ~x.contains("@"))
    return F.get(good, F.lit(0))


def url_domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")
