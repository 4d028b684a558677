"""Naming templates compiled to Columns, and the cleaning of names.

A template is text with `{field}` (or `{field:02d}` for two digits) and, in the advanced form, `{{ field }}`, with filters
`upper`, `lower` and `trim`, and `{% if field %}..{% else %}..{% endif %}`, nested at will, with `not`.  It is compiled once, when the
plan is built.  Unknown fields of a plain template are empty; an advanced one that names an unknown field names nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.paths import let

# Templates by kind.
TEMPLATES = {"Movie": "{title} ({year})", "TvShow": "{title} - S{s:02d}E{e:02d} - {ep_name}", "Strm": "{title} - S{s:02d}E{e:02d} - {ep_name}", "Music": "{artist} - {album} - {title}", "Novel": "{author} - {title}"}
# The fields of plain templates.
FIELDS = ["title", "year", "season", "episode", "s", "e", "ep_name", "episode_name", "artist", "album", "author", "media_suffix", "ext", "parse_source", "source_provider", "provider", "media_id", "tmdbid", "bgmid"]
#: Fields that only advanced templates know.
MORE_FIELDS = ["resolution", "codec", "source", "release_group", "scraped_title", "is_tv"]
_PLAIN_FIELD = re.compile(r"\{(\w+(?::02d)?)\}")
_PIECE = re.compile(r"\{\{-?\s*(?P<field>\w+)(?P<filters>(?:\s*\|\s*\w+)*)\s*-?\}\}|\{%-?\s*(?P<tag>if|elif|else|endif)\s*(?P<test>[^%]*?)\s*-?%\}|\{#.*?#\}", re.S)
_FILTERS = {"upper": F.upper, "lower": F.lower, "trim": F.trim}


def two_digits(number: Column) -> Column:
    return F.when(number.isNotNull(), F.format_string("%02d", number.cast("int")))


def names_ext(template: str) -> bool:
    return "{ext}" in template or "{{ext" in template or "{{ ext" in template


def is_advanced(template: str) -> bool:
    return any(mark in template for mark in ("{{", "{%", "{#"))


def render(template: str, fields: dict[str, Column], keep_suffix: bool = False) -> Column:
    """The text of a template; missing and null fields are empty.  Null if an advanced template names an unknown field.

    keep_suffix: adds ` - {media_suffix}`, before an `ext` of an advanced template, where the template doesn't name it and the
    field isn't empty.
    """
    text = lambda name: F.coalesce(fields[name].cast("string"), F.lit("")) if name in fields else F.lit("")
    suffix = F.when(text("media_suffix") != "", F.concat(F.lit(" - "), text("media_suffix"))).otherwise("")
    if is_advanced(template):
        return _advanced(template, text, suffix if keep_suffix and "media_suffix" not in template else None)
    parts, at = [], 0
    for m in _PLAIN_FIELD.finditer(template):
        name = m[1].removesuffix(":02d")
        parts += [F.lit(template[at : m.start()]), text(name) if name in FIELDS else F.lit("")]
        at = m.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts, suffix) if keep_suffix and "{media_suffix}" not in template else F.concat(*parts)


def _advanced(template: str, text: Callable[[str], Column], suffix: Column | None) -> Column:
    known, pieces, at = {*FIELDS, *MORE_FIELDS}, [], 0
    for m in _PIECE.finditer(template):
        pieces += [template[at : m.start()], m]
        at = m.end()
    pieces.append(template[at:])
    unknown, placed = False, suffix is None

    def test(condition: str) -> Column:
        nonlocal unknown
        negated = condition.startswith("not ")
        name = condition.removeprefix("not ").strip()
        unknown |= name not in known
        return text(name) == "" if negated else text(name) != ""

    def block(i: int) -> tuple[Column, int]:
        """The text from a piece on, up to the tag that ends its block."""
        nonlocal unknown, placed
        out: list[Column] = [F.lit("")]
        while i < len(pieces):
            piece = pieces[i]
            if isinstance(piece, str):
                out.append(F.lit(piece))
            elif piece["field"]:
                unknown |= piece["field"] not in known
                value = text(piece["field"])
                for name in re.findall(r"\w+", piece["filters"]):
                    unknown |= name not in _FILTERS
                    value = _FILTERS.get(name, lambda c: c)(value)
                if piece["field"] == "ext" and not placed:
                    out.append(suffix)
                    placed = True
                out.append(value)
            elif piece["tag"] == "if":
                condition, (yes, i) = test(piece["test"]), block(i + 1)
                chain = F.when(condition, yes)
                no: Column = F.lit("")
                while i < len(pieces) and pieces[i]["tag"] != "endif":
                    tag = pieces[i]
                    if tag["tag"] == "elif":
                        condition, (yes, i) = test(tag["test"]), block(i + 1)
                        chain = chain.when(condition, yes)
                    else:
                        no, i = block(i + 1)
                out.append(chain.otherwise(no))
            elif piece["tag"]:
                return F.concat(*out), i
            i += 1
        return F.concat(*out), i

    made, _ = block(0)
    if not placed:
        made = F.concat(made, suffix)
    return F.lit(None).cast("string") if unknown else made


def clean_name(name: Column) -> Column:
    """Without empty brackets, dangling dashes, empty season marks, double dots and junk at the ends; null if nothing is left."""
    return let(name, _cleaned)


def _cleaned(name: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\(\s*\)", ""), r"\[\s*\]", ""), "  +", " ")
    for _ in range(3):
        for pattern, to in ((r"\s+-\s+", " - "), (r"\s+-\s*$", ""), (r"^\s*-\s+", ""), ("  +", " ")):
            out = F.regexp_replace(out, pattern, to)
    out = F.trim(F.replace(F.regexp_replace(out, r"(^|[^A-Za-z0-9])S(E\d{2}\b)", "$1$2"), F.lit(".."), F.lit(".")))
    return F.nullif(F.regexp_replace(out, r"[\s.]+$|^[\s.]+", ""), F.lit(""))


def safe_name(name: Column, collapse: bool = True) -> Column:
    """Characters that file systems refuse as underscores, and single spaces if asked for."""
    out = F.translate(name, '<>:"/\\|?*', "_________")
    return F.trim(F.regexp_replace(out, r"\s+", " ")) if collapse else F.trim(out)
