"""Text normalisation as built-in column expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, legal suffixes and address abbreviations that the linkage rules name.
STOP_WORDS = ("and", "the", "of", "for", "in", "on", "at", "to", "a", "an", "is", "by", "with")
LEGAL_WORDS = (
    "inc", "incorporated", "corp", "corporation", "ltd", "limited", "llc", "co", "company", "pvt", "private", "plc", "gmbh", "sa", "bv",
    "srl", "llp", "holdings", "group", "enterprises", "enterprise", "services", "solutions", "tech", "technologies", "international", "intl",
)
ADDRESS_WORDS = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place",
    "sq": "square", "hwy": "highway", "pkwy": "parkway", "ste": "suite", "apt": "apartment", "fl": "floor", "bldg": "building",
    "ctr": "center", "no": "number", "po box": "pobox",
}
#: Literals that the profile treats as missing.
NULL_WORDS = ("nan", "None", "<NA>", "")


@functools.cache
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Code points outside ASCII whose compatibility decomposition has ASCII in it: those with one such character as
    two aligned strings, those with several as a table.  Worked out from the Unicode data, not written down."""
    single, images, several = [], [], {}
    for c in range(0x80, 0x110000):
        image = unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()
        if len(image) == 1:
            single.append(chr(c))
            images.append(image)
        elif image:
            several[chr(c)] = image
    return "".join(single), "".join(images), several


def ascii_fold(x: Column) -> Column:
    """Compatibility-decompose and drop what is not ASCII.  ASCII values pass untouched; the few characters with
    images of several letters are looked up only in values that have one."""
    single, images, several = _fold_tables()
    table = F.create_map(*[F.lit(v) for pair in several.items() for v in pair])
    letters = F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))
    widened = F.array_join(F.transform(letters, lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    has = "[" + "".join(several) + "]"
    x2 = F.when(x.rlike(has), widened).otherwise(x)
    folded = F.regexp_replace(F.translate(x2, single, images), r"[^\x00-\x7F]+", "")
    return F.when(x.rlike(r"[^\x00-\x7F]"), folded).otherwise(x)


def _guarded(x: Column, none_word: bool) -> Column:
    empty = x.isNull() | ((x == "None") if none_word else F.lit(False))
    return F.when(empty, F.lit("")).otherwise(x)


def normal_text(x: Column, none_word: bool = True) -> Column:
    """Folded, lower-cased, ``&`` as a word, everything but a-z and 0-9 as single spaces.  Null, and with
    ``none_word`` the literal ``None``, give the empty string."""
    spelled = F.replace(F.lower(ascii_fold(_guarded(x, none_word))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def without_legal_words(norm: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(norm, rf"\b({'|'.join(LEGAL_WORDS)})\b", " "), " +", " "))


def normal_name(x: Column, none_word: bool = True) -> Column:
    """Normal text without legal-form words, wherever they stand."""
    return without_legal_words(normal_text(x, none_word))


def normal_address(x: Column) -> Column:
    """Normal text with abbreviations spelled out."""
    out = normal_text(x, none_word=False)
    for short, long in ADDRESS_WORDS.items():
        out = F.regexp_replace(out, rf"\b{short}\b", long)
    return F.trim(F.regexp_replace(out, " +", " "))


def tokens(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def raw_word_count(x: Column) -> Column:
    """Words of raw text, split at Unicode white space and the separators U+001C to U+001F."""
    return F.size(F.filter(F.split(x, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != ""))


def numbers(raw: Column) -> Column:
    """Whole-word digit runs of raw text, in order, with Unicode word boundaries."""
    x = F.coalesce(raw, F.lit(""))
    return F.regexp_extract_all(x, F.lit(r"(?<![\p{L}\p{N}_])\p{Nd}+(?![\p{L}\p{N}_])"), F.lit(0))
