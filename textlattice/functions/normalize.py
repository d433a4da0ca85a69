"""Text normalisation as column expressions. Four cleaners exist, each with its own rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_MARK = "\u0001"


def clean_ascii(c: Column, keep: str = "") -> Column:
    """Drop all but ASCII letters and digits, and what ``keep`` names in a character class; then lower-case."""
    return F.lower(F.regexp_replace(c, f"[^a-zA-Z0-9{keep}]", ""))


def clean_unicode(c: Column, keep: str = "") -> Column:
    """Drop all but letters and digits of any script, then lower-case."""
    return F.lower(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}{keep}]", ""))


def clean_spanish(c: Column, keep: str = "") -> Column:
    """Lower-case first, then drop all but Spanish letters and digits."""
    return F.regexp_replace(F.lower(c), f"[^a-záéíóúüñ0-9{keep}]", "")


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, r"\s+"), "")


def clean_words(c: Column, cleaner=clean_ascii) -> Column:
    """The words that have something left when cleaned. White space is kept while the whole text is cleaned at once."""
    return words(cleaner(c, r"\s"))


def _lowered(found: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.array_join(found, " ")), " "), "")


def alnum_words(c: Column) -> Column:
    """Words made of letters and digits only, lower-cased; a word with punctuation is dropped whole."""
    return _lowered(F.regexp_extract_all(c, F.lit(r"(?<!\S)[\p{L}\p{N}]+(?!\S)"), F.lit(0)))


def alpha_words(c: Column) -> Column:
    return _lowered(F.regexp_extract_all(c, F.lit(r"(?<!\S)\p{L}+(?!\S)"), F.lit(0)))


def cli_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_']+|[.,!?;])"), F.lit(1))


def cli_join(tokens: Column) -> Column:
    return F.regexp_replace(F.array_join(tokens, " "), r"\s+([.,!?;])", "$1")


def tidy_spacing(c: Column) -> Column:
    for mark in (".", ",", "!", "?", "'"):
        c = F.replace(c, F.lit(f" {mark}"), F.lit(mark))
    return c


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sentence_parts(c: Column) -> Column:
    """The text cut after ``. ! ?`` followed by white space."""
    return F.split(F.regexp_replace(strip(c), r"([.!?])\s+", "$1" + SENTENCE_MARK), SENTENCE_MARK)


def sentence_texts(c: Column) -> Column:
    """Sentences without white space around them; blank parts are dropped."""
    return F.filter(F.transform(sentence_parts(c), strip), lambda s: s != "")


def is_title(c: Column) -> Column:
    """Each run of letters starts with a capital and goes on in small letters, and there is one."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{L}\p{Lu}") & ~c.rlike(r"(^|[^\p{L}])\p{Ll}")


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def hashed(*parts: Column | str) -> Column:
    """A number in [0, 2**32) from the parts, the same on any engine: all randomness comes from it."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
