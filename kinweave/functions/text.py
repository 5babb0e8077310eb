"""Normalisation of names and addresses.

Built-in functions do all but two things: Devanagari transliteration is a state
machine, and NFKD folding beyond Latin letters has no built-in. Both run as
Arrow UDFs that are handed null for every row without such characters.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Contractions of names and addresses, and tokens that a core name leaves out.
NAME_WORDS = {"incorporated": "inc", "corporation": "corp", "limited": "ltd", "private": "pvt", "company": "co"}
ADDRESS_WORDS = {
    "road": "rd", "street": "st", "avenue": "ave", "drive": "dr", "boulevard": "blvd", "lane": "ln", "court": "ct",
    "place": "pl", "square": "sq", "highway": "hwy", "apartment": "apt", "apartments": "apt", "building": "bldg",
    "floor": "fl", "suite": "ste", "north": "n", "south": "s", "east": "e", "west": "w", "post": "po",
}
LEGAL_TOKENS = ["inc", "incorporated", "llc", "llp", "lp", "ltd", "limited", "corp", "corporation", "co", "company", "pvt", "private", "plc", "pllc"]

# Unicode blocks by script, and Devanagari letters in Latin.
SCRIPTS = {
    "devanagari": (0x0900, 0x097F), "bengali": (0x0980, 0x09FF), "gurmukhi": (0x0A00, 0x0A7F), "gujarati": (0x0A80, 0x0AFF),
    "oriya": (0x0B00, 0x0B7F), "tamil": (0x0B80, 0x0BFF), "telugu": (0x0C00, 0x0C7F), "kannada": (0x0C80, 0x0CFF),
    "malayalam": (0x0D00, 0x0D7F), "latin_accent": (0x00C0, 0x024F),
}
DEVANAGARI_VOWELS = {
    0x0904: "a", 0x0905: "a", 0x0906: "aa", 0x0907: "i", 0x0908: "ii", 0x0909: "u", 0x090A: "uu", 0x090B: "ri", 0x090C: "lri",
    0x090D: "ae", 0x090E: "e", 0x090F: "e", 0x0910: "ai", 0x0911: "o", 0x0912: "o", 0x0913: "o", 0x0914: "au", 0x0960: "rri",
    0x0961: "lli", 0x0962: "l", 0x0963: "l",
}
DEVANAGARI_SIGNS = {
    0x093E: "aa", 0x093F: "i", 0x0940: "ii", 0x0941: "u", 0x0942: "uu", 0x0943: "ri", 0x0944: "rri", 0x0945: "ae", 0x0946: "e",
    0x0947: "e", 0x0948: "ai", 0x0949: "o", 0x094A: "o", 0x094B: "o", 0x094C: "au", 0x094D: "",
}
DEVANAGARI_CONSONANTS = {
    0x0915: "k", 0x0916: "kh", 0x0917: "g", 0x0918: "gh", 0x0919: "ng", 0x091A: "ch", 0x091B: "chh", 0x091C: "j", 0x091D: "jh",
    0x091E: "ny", 0x091F: "t", 0x0920: "th", 0x0921: "d", 0x0922: "dh", 0x0923: "n", 0x0924: "t", 0x0925: "th", 0x0926: "d",
    0x0927: "dh", 0x0928: "n", 0x092A: "p", 0x092B: "ph", 0x092C: "b", 0x092D: "bh", 0x092E: "m", 0x092F: "y", 0x0930: "r",
    0x0931: "r", 0x0932: "l", 0x0933: "l", 0x0934: "l", 0x0935: "v", 0x0936: "sh", 0x0937: "sh", 0x0938: "s", 0x0939: "h",
    0x0958: "q", 0x0959: "kh", 0x095A: "g", 0x095B: "z", 0x095C: "r", 0x095D: "rh", 0x095E: "f", 0x095F: "y",
}
DEVANAGARI_OTHERS = {0x0900: "", 0x0901: "n", 0x0902: "n", 0x0903: "h", 0x093D: "", 0x0964: " ", 0x0965: " ", 0x0970: "."} | {0x0966 + d: str(d) for d in range(10)}

_SYLLABLE = re.compile("([" + "".join(map(chr, DEVANAGARI_CONSONANTS)) + "])([" + "".join(map(chr, DEVANAGARI_SIGNS)) + "]?)")
_PLAIN_DEVANAGARI = DEVANAGARI_VOWELS | DEVANAGARI_SIGNS | DEVANAGARI_OTHERS


def transliterate(text: str) -> str:
    """Devanagari in Latin letters: a consonant carries an ``a`` unless a vowel sign or virama follows."""

    def syllable(m: re.Match) -> str:
        return DEVANAGARI_CONSONANTS[ord(m[1])] + (DEVANAGARI_SIGNS[ord(m[2])] if m[2] else "a")

    return _SYLLABLE.sub(syllable, text).translate(_PLAIN_DEVANAGARI)


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _single_letters() -> tuple[str, str]:
    """Latin letters with one base letter, from the Unicode tables, and those base letters."""
    pairs = [(chr(c), fold(chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(c, f) for c, f in pairs if len(f) == 1]
    return "".join(c for c, _ in pairs), "".join(f for _, f in pairs)


_LETTERS, _BASES = _single_letters()


@F.pandas_udf(StringType())
def _fold_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold(transliterate(t)))


def strip_accents(x: Column) -> Column:
    """transliterated and folded; null stays null."""
    beyond = x.rlike(f"[^\\x00-\\x7F{_LETTERS}]")
    return F.when(beyond, _fold_udf(F.when(beyond, x))).otherwise(F.translate(x, _LETTERS, _BASES))


@F.pandas_udf(StringType())
def _decompose_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold(t))


def folded(x: Column) -> Column:
    """lower case without combining marks, other scripts kept; null as empty. Only texts beyond Latin letters go through Python."""
    x = F.coalesce(x, F.lit(""))
    beyond = x.rlike(f"[^\\x00-\\x7F{_LETTERS}]")
    return F.lower(F.when(beyond, _decompose_udf(F.when(beyond, x))).otherwise(F.translate(x, _LETTERS, _BASES)))


def script(x: Column) -> Column:
    """the block of most non-ASCII characters, ties to the first seen; ``latin`` without any."""
    chars = F.filter(F.split(F.coalesce(x, F.lit("")), ""), lambda c: c.rlike(r"[^\x00-\x7F]"))
    names = F.transform(chars, lambda c: F.coalesce(*[F.when(c.rlike(f"[\\x{{{lo:04X}}}-\\x{{{hi:04X}}}]"), name) for name, (lo, hi) in SCRIPTS.items()], F.lit("other")))
    counted = F.transform(F.array_distinct(names), lambda n: F.struct((-F.size(F.filter(names, lambda m: m == n))).alias("k"), F.array_position(names, n).alias("at"), n.alias("name")))
    return F.when(F.size(names) == 0, "latin").otherwise(F.array_min(counted)["name"])


def clean(x: Column) -> Column:
    """Accents off, lower case, ``&`` as a word, other punctuation and runs of space as one space."""
    x = F.lower(strip_accents(F.coalesce(x, F.lit(""))))
    x = F.regexp_replace(F.replace(x, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}_\s]+", " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def map_words(words: Column, contractions: dict[str, str]) -> Column:
    """Whole words contracted."""
    table = F.create_map(*[F.lit(v) for pair in contractions.items() for v in pair])
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(table, t), t))


def sorted_tokens(words: Column) -> Column:
    return F.array_join(F.array_sort(words), " ")


def strip_leading_zeros(x: Column) -> Column:
    """``019`` is ``19`` and ``0`` stays."""
    return F.regexp_replace(x, "^0+([0-9])", "$1")


def postal_code(x: Column) -> Column:
    """six digits win over five; digits next to digits don't count."""
    six, five = (F.regexp_extract(x, p, 1) for p in (r"(?<!\d)(\d{6})(?!\d)", r"(?<!\d)(\d{5})(?:-\d{4})?(?!\d)"))
    return F.coalesce(F.nullif(six, F.lit("")), F.nullif(five, F.lit("")))


def house_number(x: Column) -> Column:
    """F16: leading digits with at most one lower-case letter, matched on the text as given."""
    return F.nullif(F.lower(F.regexp_extract(x, r"^\s*(\d+[a-z]?)\b", 1)), F.lit(""))


def quick_norm(x: Column) -> Column:
    """the profile's light normalisation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^0-9a-z\s]+", " "), r"\s+", " "))


def serialize(name: Column, address: Column) -> Column:
    """one text for a pair model."""
    return F.concat(F.lit("name: "), F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit(" address: "), F.lower(F.trim(F.coalesce(address, F.lit("")))))


def id_number(x: Column) -> Column:
    """``S2-17`` as ``2 * 10^10 + 17``."""
    return F.substring(x, 2, 1).cast("long") * F.lit(10_000_000_000) + x.substr(F.lit(4), F.length(x)).cast("long")


def normalize_records(raw: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``entity_id, business_name, business_address, country, source`` to the normalised columns."""
    name, address = (F.coalesce(c, F.lit("")) for c in ("business_name", "business_address"))
    base = raw.select("entity_id", "country", "source", *extra, name.alias("name_original"), address.alias("address_original"), map_words(tokens(clean(F.col("business_name"))), NAME_WORDS).alias("name_tokens"), map_words(tokens(clean(F.col("business_address"))), ADDRESS_WORDS).alias("address_tokens"))
    core = F.filter("name_tokens", lambda t: ~t.isin(LEGAL_TOKENS))
    return base.withColumns({
        "name_script": script(F.col("name_original")), "name_normalized": F.array_join("name_tokens", " "), "name_compact": F.array_join("name_tokens", ""),
        "name_sorted_tokens": sorted_tokens(F.col("name_tokens")), "name_core": F.array_join(core, " "),
        "address_normalized": F.array_join("address_tokens", " "), "address_compact": F.array_join("address_tokens", ""),
        "address_sorted_tokens": sorted_tokens(F.col("address_tokens")), "postal_code": postal_code(F.col("address_original")), "house_number": house_number(F.col("address_original")),
    })
