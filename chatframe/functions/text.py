"""Column expressions over message text; each is row-local and runs in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: character classes and patterns -----------------------------
# (?U) makes \s and \S know white space of any script, not only the ASCII kind.
SPACES = r"(?U)\s+"
WORD = r"(?U)\S+"
LONG_WORD = r"(?U)\S\S"
# what \s knows with (?U); ends are trimmed by these, as a pattern would look at every character
SPACE_CHARACTERS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
URL = r"(?iU)https?://\S+|www\.\S+"
EMOJI = r"[\x{200d}\x{231a}\x{23cf}\x{23e9}\x{24c2}-\x{10ffff}]"

# ---- Fixed values: placeholders written by the exporting application ----------
MEDIA_PHRASES = (
    "<media omitted>", "image omitted", "video omitted", "audio omitted",
    "document omitted", "sticker omitted", "gif omitted",
)
DELETED_PHRASES = ("this message was deleted", "you deleted this message")
SKIPPED_MESSAGES = (
    "<media omitted>", "media omitted", "image omitted", "video omitted",
    "audio omitted", "document omitted", "sticker omitted",
    "this message was deleted", "you deleted this message",
    "messages are end-to-end encrypted", "null", "",
)


def round_half_even(value: Column, digits: int) -> Column:
    """Round as array libraries do: scale, round half to even, scale back."""
    return F.rint(value * F.lit(10.0**digits)) / F.lit(10.0**digits)


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("int")


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (text.contains(p) for p in phrases))


def is_media(message: Column) -> Column:
    low = F.lower(message)
    return low.contains("omitted") & contains_any(low, MEDIA_PHRASES)


def is_deleted(message: Column) -> Column:
    low = F.lower(message)
    return low.contains("deleted") & contains_any(low, DELETED_PHRASES)


def is_skippable(message: Column) -> Column:
    """Null, one of the exact placeholders, or at most two characters without spaces."""
    text = F.lower(strip(message))
    return (
        message.isNull()
        | text.isin(*SKIPPED_MESSAGES)
        | (F.char_length(F.replace(text, F.lit(" "), F.lit(""))) <= 2)
    )


def _may_have_url(low: Column) -> Column:
    return low.contains("http") | low.contains("www.")


def has_url(message: Column) -> Column:
    return _may_have_url(F.lower(message)) & message.rlike(URL)


def _has_non_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.char_length(text)


def emoji_runs(message: Column, single: bool = False) -> Column:
    """All emoji runs; adjacent emoji are one entry unless ``single``."""
    pattern = EMOJI if single else EMOJI + "+"
    found = F.regexp_extract_all(message, F.lit(pattern), F.lit(0))
    return F.when(_has_non_ascii(message), found).otherwise(F.array().cast("array<string>"))


def letters_of(message: Column) -> Column:
    """Lower-case, drop URLs and emoji, keep letters only, words one blank apart."""
    low = F.lower(message)
    low = F.when(_may_have_url(low), F.regexp_replace(low, URL, "")).otherwise(low)
    # asked of the message: ``low`` would be made once for the question and again for the answer
    low = F.when(_has_non_ascii(message), F.regexp_replace(low, EMOJI + "+", "")).otherwise(low)
    return F.trim(F.regexp_replace(low, "[^a-z]+", " "))


def words_of(cleaned: Column) -> Column:
    """Words of a cleaned message; an empty array for the empty message."""
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def ngrams_of(words: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring words, joined by a space."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - F.lit(n - 1), F.lit(0)))
    return F.transform(
        starts,
        lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + F.lit(k)) for k in range(1, n)]),
    )
