"""String functions of validation. Null counts as the empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Unicode counts as white space, and the tokens of a normalised text.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
TOK = r"[\p{L}\p{N}_]+(?:[./%-][\p{L}\p{N}_]+)*"
REPLACEMENT = "�"


#: All but printable ASCII and the blank: only texts that have it need composing, or have other white space.
OTHER = r"[^\x20-\x7e]"


def nfkc(text: Column) -> Column:
    """NFKC of a text that isn't null, by the ICU library that Spark comes with, so within the JVM.

    It knows Unicode 16; characters that are older come out as from Python's unicodedata.
    """
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def _single_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "  +", " "))


def _blanks(text: Column) -> Column:
    return F.translate(text, SPACES, " " * len(SPACES))


def collapse(text: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return _single_blanks(F.when(text.rlike(OTHER), _blanks(text)).otherwise(text))


def normalize_text(text: Column, compose: bool = True) -> Column:
    text = F.coalesce(text, F.lit(""))
    composed = nfkc(text) if compose else text
    return _single_blanks(F.when(text.rlike(OTHER), _blanks(F.lower(composed))).otherwise(F.lower(text)))


def tokens_of(normalized: Column) -> Column:
    """Tokens of a text that normalize_text has made."""
    return F.regexp_extract_all(normalized, F.lit(TOK), F.lit(0))


def char_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer length of two normalised texts; null if both are empty."""
    x, y = F.length(a), F.length(b)
    return F.try_divide(F.least(x, y).cast("double"), F.greatest(x, y).cast("double"))


def replacement_ratio(text: Column) -> Column:
    """Share of U+FFFD among the characters of the raw text; 0 for none."""
    text = F.coalesce(text, F.lit(""))
    gone = F.length(F.replace(text, F.lit(REPLACEMENT), F.lit("")))
    return F.coalesce(F.try_divide((F.length(text) - gone).cast("double"), F.length(text).cast("double")), F.lit(0.0))


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def normalize_cell(value: Column) -> Column:
    return F.coalesce(collapse(value.cast("string")), F.lit(""))


def output_path(relative_path: Column) -> Column:
    """Folder of a document's outputs: its path without the last suffix."""
    return F.regexp_replace(relative_path, r"(?<=[^/])\.[^./]+$", "")


def first_truthy(*values: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def error_text(kind: Column, message: Column) -> Column:
    return F.concat_ws(": ", kind, message)
