"""One plain form for text that reads alike but differs in its characters.

The plain form of a text comes of, in this order: removal of default-ignorable and control
characters, compatibility normalisation to composed characters, ordinary spaces and hyphens, and
look-alike letters put back into the alphabet of their word.  The key for comparisons is the plain
form with full case folding, one more normalisation, and single spaces.

Text in ASCII is finished by JVM expressions; the rest goes to Python in Arrow batches, where every
distinct value of a batch is normalised once.  Nothing is shuffled, so a value that holds a third of
all rows costs no more than any other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other alphabets and the Latin letters they look like.
LOOKALIKE_CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԌG ԚQ ԜW аa вb еe ѕs іi јj кk мm нh оo рp сc тt уy хx үy һh ԁd ԛq ԝw ӏl ѵv"
LOOKALIKE_GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa βb γy εe ηn ιi κk νv οo ρp τt υu χx ωw ϲc ϳj"
LOOKALIKE_OTHER = "ՕO ՍU ՏS օo սu հh ցg ıi ɑa ɡg ɩi ʋv"
LOOKALIKE_CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎥI ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏒR ᏚS ᏕS ᎢT ᏙV ᎳW ᏃZ ꭼe ꭰd ꮋh ꭻj ꮶk ꮮl ꮇm ꮲp ꭱr ꮪs ꭲt ꮩv ꮃw ꮓz ꮯc ꭺa"
LOOKALIKE_LISU = "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
#: Small capitals, by their names; they are a notation for Latin letters.
SMALL_CAPITALS = {c: name[-1].lower() for c in map(chr, [*range(0x250, 0x2B0), *range(0x1D00, 0x1D30), *range(0xA730, 0xA732)]) if (name := unicodedata.name(c, "")).startswith("LATIN LETTER SMALL CAPITAL ") and name[-2] == " "}
# Default-ignorable code points of the Unicode standard.
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"

_OTHERS = {pair[0]: pair[1] for group in (LOOKALIKE_OTHER, LOOKALIKE_CHEROKEE, LOOKALIKE_LISU) for pair in group.split()} | SMALL_CAPITALS
TO_LATIN = {pair[0]: pair[1] for group in (LOOKALIKE_CYRILLIC, LOOKALIKE_GREEK) for pair in group.split()} | _OTHERS
FROM_LATIN = {"CYRILLIC": {p[1]: p[0] for p in reversed(LOOKALIKE_CYRILLIC.split())}, "GREEK": {p[1]: p[0] for p in reversed(LOOKALIKE_GREEK.split())}}

_INVISIBLE = re.compile(f"[{IGNORABLE}\x00-\x08\x0e-\x1f\x7f\x80-\x84\x86-\x9f]")
_SPACE = re.compile("[\t\n\x0b\x0c\r\x85\xa0  -     　]")
_HYPHEN = re.compile("[‐‑‒⁃−]")
_WIDE_PUNCTUATION = re.compile("[！-／：-＠［-｀｛-｠]+")
_EAST = re.compile("[⺀-⿟々-〇ぁ-ヿㇰ-ㇿ㐀-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff]")
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
#: Letters that may stand for those of another alphabet; words without any are left alone.
_FOREIGN = re.compile("[" + re.escape("".join(_OTHERS)) + "\u0370-\u052f\u1c80-\u1c8f\u1d26-\u1d2b\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f]")
_ASCII_PLAIN = "^[\\x20-\\x7e]*$"


@lru_cache(maxsize=65536)
def script(letter: str) -> str:
    """The alphabet of a letter, by the first word of its name; look-alikes of smaller alphabets and notations count as OTHER."""
    if letter in _OTHERS:
        return "OTHER"
    return unicodedata.name(letter, "?").split(" ", 1)[0].split("-", 1)[0]


def _as(letter: str, kind: str, home: str) -> str | None:
    """A letter of one alphabet in another one, if it has a look-alike there."""
    latin = letter if kind == "LATIN" else TO_LATIN.get(letter)
    return latin if home == "LATIN" or latin is None else FROM_LATIN[home].get(latin)


def _unmixed(m: re.Match) -> str:
    """A word in one alphabet, if each of its foreign letters has a look-alike there; else the word as it is.

    The alphabet is that of the letters that none else can stand for, then that of the greater number, then Latin.
    """
    word = m[0]
    if word.isascii() or not _FOREIGN.search(word):
        return word
    parts = [unicodedata.normalize("NFD", c) for c in word]
    scripts = [script(p[0]) for p in parts]
    kinds = set(scripts)
    if kinds == {"OTHER"} and len(word) > 1 and all(p[0] in SMALL_CAPITALS for p in parts):
        kinds.add("LATIN")
    if len(kinds) < 2 or not kinds & {"CYRILLIC", "GREEK", "OTHER"}:
        return word

    def weight(kind: str) -> tuple[int, int, int]:
        mine = [p[0] for p, s in zip(parts, scripts, strict=True) if s == kind]
        swap = FROM_LATIN["CYRILLIC"] | FROM_LATIN["GREEK"] if kind == "LATIN" else TO_LATIN
        return sum(c not in swap for c in mine), len(mine), kind == "LATIN"

    for home in sorted(kinds & {"LATIN", "CYRILLIC", "GREEK"}, key=weight, reverse=True):
        made = [p if s == home or s not in ("LATIN", "CYRILLIC", "GREEK", "OTHER") else (to + p[1:] if (to := _as(p[0], s, home)) else None) for p, s in zip(parts, scripts, strict=True)]
        if None not in made:
            return unicodedata.normalize("NFC", "".join(made))
    return word


def _ordinary(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def plain_form(text: str | None) -> str | None:
    """The plain form.  Null stays null, empty stays empty; case, ordinary spaces and punctuation are kept.

    Full-width punctuation stays in text that is written with Han characters or kana.
    """
    if text is None or text.isascii() and not _INVISIBLE.search(text) and not _SPACE.search(text):
        return text
    text = _HYPHEN.sub("-", _SPACE.sub(" ", _INVISIBLE.sub("", text)))
    if _EAST.search(text):
        at, parts = 0, []
        for m in _WIDE_PUNCTUATION.finditer(text):
            parts += [_ordinary(text[at : m.start()]), m[0]]
            at = m.end()
        text = "".join([*parts, _ordinary(text[at:])])
    else:
        text = _ordinary(text)
    return _WORD.sub(_unmixed, text) if _FOREIGN.search(text) else text


def _folded(plain: str) -> str:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", plain).casefold())
    return " ".join(_HYPHEN.sub("-", folded).split())


def match_key(text: str | None) -> str | None:
    """Equal for texts that read alike: plain form, full case folding, single spaces, trimmed."""
    return None if text is None else _folded(plain_form(text))


def _once(values: pd.Series, f) -> pd.Series:
    """f of every distinct value, taken back to the rows."""
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    made = pd.Series([f(x) for x in distinct] + [None], dtype=object)
    return made.take(codes % len(made)).reset_index(drop=True) if len(values) else values


@F.pandas_udf(T.StringType())
def _plain_batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in parts:
        yield _once(x, plain_form)


@F.pandas_udf(T.StructType([T.StructField("plain", T.StringType()), T.StructField("key", T.StringType())]))
def _both_batches(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for x in parts:
        plain = _once(x, plain_form)
        yield pd.DataFrame({"plain": plain, "key": _once(plain, _folded)})


def plain_column(text: Column) -> Column:
    return F.when(text.rlike(_ASCII_PLAIN), text).otherwise(_plain_batches(F.when(~text.rlike(_ASCII_PLAIN), text)))


def normalise(df: DataFrame, column: str, plain: str = "plain", key: str | None = "key") -> DataFrame:
    """df with the plain form and the comparison key of a text column.

    Any other column is kept; columns called as the results are replaced.  Repeated rows stay.  Null text has
    null results; text of any length is normalised whole.  Pass key=None where only the plain form is wanted.
    One scan, in which only the text that is not ASCII alone goes to Python, once for both results.
    """
    text = F.col(f"`{column}`")
    simple = text.rlike(_ASCII_PLAIN)
    if not key:
        return df.withColumn(plain, plain_column(text))
    made = df.withColumn("__both", _both_batches(F.when(~simple, text)))
    own = {plain: F.when(simple, text).otherwise(F.col("__both.plain")), key: F.when(simple, F.lower(F.trim(F.regexp_replace(text, " +", " ")))).otherwise(F.col("__both.key"))}
    return made.withColumns(own).drop("__both")


def disguised(df: DataFrame, column: str) -> DataFrame:
    """The rows whose text is not in plain form, with that form in `plain`.  ASCII rows never reach Python."""
    text = F.col(f"`{column}`")
    return df.filter(~text.rlike(_ASCII_PLAIN)).withColumn("plain", _plain_batches(text)).filter(F.col("plain") != text)
