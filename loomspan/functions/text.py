"""Text expressions: predicates, masking, splitting, scores and keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of protected spans, in the order in which they are masked.
URL = r"https?://\S+"
EMAIL = r"[\w.%-]+@[\w.-]+\.[A-Za-z]{2,}"
CODE = r"\b(?:SKU|EAN|IP)\s*[:#-]?\s*[A-Z0-9-]{3,}\b|\b\d{8,14}\b"
UNIT = r"\b\d+(?:[.,]\d+)?\s?(?:mm|cm|m|kg|g|W|kW|V|A|mAh|°C|%)\b"
HTML_TAG = r"<[a-zA-Z!/][^>]*>"
LETTER = "A-Za-zÀ-ž"
TOKEN = r"__KEEP_[0-9]+__"

#: Java needs (?U) where the patterns mean all of Unicode.  An address begins where its run of characters does or the
#: one before it ended, so no run is searched from each of its places; a code or unit begins with what can be told at a glance.
PROTECTED = {"urls": f"(?U){URL}", "emails": r"(?U)(?:\G|(?<![\w.%-]))" + EMAIL.replace("+@", "++@"), "codes": rf"(?U)(?=[SEI\d])(?:{CODE})", "units": rf"(?iU)(?=\d){UNIT}"}
#: What a text must have for a kind to be searched at all.
_SIGNS = {"urls": lambda t: t.contains("://"), "emails": lambda t: t.contains("@"), "codes": lambda t: t.rlike(r"(?U)\d") | t.contains("SKU") | t.contains("EAN") | t.contains("IP"), "units": lambda t: t.rlike(r"(?U)\d")}


def is_html(text: Column) -> Column:
    return text.rlike(HTML_TAG)


def is_blank(text: Column) -> Column:
    """Null, empty, or white space of any kind only."""
    return text.isNull() | ~text.rlike(r"(?U)\S")


def has_words(text: Column) -> Column:
    """Whether letters are left once tokens of masked spans are gone."""
    return F.regexp_replace(text, TOKEN, " ").rlike(f"[{LETTER}]")


def _tokens(found: Column, start: Column) -> Column:
    return F.transform(found, lambda _, i: F.concat(F.lit("__KEEP_"), (i + start).cast("string"), F.lit("__")))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mask_one(kind: str) -> Callable[[Column], Column]:
    """From struct(text, kept) to the same with the spans of one more kind masked."""
    pattern, sign = PROTECTED[kind], _SIGNS[kind]

    def replaced(s: Column) -> Column:
        parts = F.zip_with(F.split(s["text"], pattern, -1), _tokens(s["found"], F.size(s["kept"])), lambda part, token: F.concat(part, F.coalesce(token, F.lit(""))))
        return F.struct(F.array_join(parts, "").alias("text"), F.concat(s["kept"], s["found"]).alias("kept"))

    def step(s: Column) -> Column:
        found = F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0))
        masked = bind(F.struct(s["text"].alias("text"), s["kept"].alias("kept"), found.alias("found")), replaced)
        return F.when(F.coalesce(sign(s["text"]), F.lit(True)), masked).otherwise(s)

    return step


def mask(text: Column, kinds: tuple[str, ...] = tuple(PROTECTED)) -> Column:
    """struct(text, kept): protected spans become ``__KEEP_n__``, n counting through all kinds; kept[n] is the span."""
    masked = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kept"))
    for kind in kinds:
        masked = bind(masked, _mask_one(kind))
    return masked


def unmask(text: Column, kept: Column) -> Column:
    """Spans put back in the order in which they were taken; a token that a later span holds is not restored twice."""
    numbers = F.transform(kept, lambda _, i: i)
    return F.aggregate(numbers, text, lambda so_far, i: F.replace(so_far, F.concat(F.lit("__KEEP_"), i.cast("string"), F.lit("__")), F.get(kept, i)))


def split_text(text: Column, most: int) -> Column:
    """Pieces of at most ``most`` characters, cut behind the last space that is not the first character, or hard."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{most}}}\z|.{{1,{most - 1}}} |.{{{most}}}"), F.lit(0))


def complexity(text: Column, is_markup: Column) -> Column:
    """0 to 1: length, tags, masked tokens and markup, weighted."""
    part = lambda x, full: F.least(x / F.lit(float(full)), F.lit(1.0))
    score = 0.45 * part(F.length(text), 1500) + 0.25 * part(F.regexp_count(text, F.lit(HTML_TAG)), 8)
    return F.least(score + 0.2 * part(F.regexp_count(text, F.lit(TOKEN)), 10) + F.when(is_markup, 0.2).otherwise(0.0), F.lit(1.0))


def normalize(text: Column) -> Column:
    """Stripped, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def same_normalized(a: Column, b: Column) -> Column:
    """Whether normal forms are equal; texts that begin with different words are told apart by these."""
    first = lambda x: F.lower(F.regexp_extract(x, r"(?U)\S+", 0))
    return (a == b) | ((first(a) == first(b)) & (normalize(a) == normalize(b)))


def letters(text: Column) -> Column:
    return F.length(F.array_join(F.regexp_extract_all(text, F.lit(f"[{LETTER}]+"), F.lit(0)), ""))


def has_letters(text: Column, least: int) -> Column:
    """Whether there are so many letters; no more of the text is read than has them."""
    return text.rlike(f"^(?:[^{LETTER}]*+[{LETTER}]){{{least}}}")


def cache_key(text: Column, source_lang: str, target_lang: str, provider: str, model: str) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(text, F.lit("")), F.lit(source_lang), F.lit(target_lang), F.lit(provider), F.lit(model)), 256)


def source_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def needs_review(text: Column, score: Column, rate: float) -> Column:
    """Whether a cached result is checked again: complex ones always, others by a fixed sample of their hash."""
    spot = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") % 10000 / F.lit(10000.0)
    return (score >= 0.6) | (F.lit(rate > 0) & (spot <= F.lit(float(rate))))


def strip_fence(raw: Column) -> Column:
    """The inside of a Markdown code fence, or the trimmed text."""
    bare = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    fence = r"(?is)^```(?:json)?\s*(.*?)\s*```$"
    return F.when(bare.rlike(fence), F.regexp_extract(bare, fence, 1)).otherwise(bare)


def token_estimate(chars: Column) -> Column:
    return F.floor(chars / F.lit(4))


def per_minute(amount: Column, seconds: Column) -> Column:
    """Rate with at least a tenth of a minute."""
    return amount / F.greatest(seconds / F.lit(60.0), F.lit(0.1))
