"""Identification of titles, seasons, episodes, years and media tags from file names, as Columns.

The forms of a name are tried in a fixed order and the first that matches gives all its fields.  Everything is a
built-in expression, so the whole step is one projection inside generated code.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.paths import let

# Words dropped from names wherever they occur, in this order.
NOISE_WORDS = ["ColorTV", "WEBDL", "HDS", "FRDS", "BeAst", "HDCTV", "OurTV", "AoE", "字幕侠", "片源网", "人人影视", "射手网"]
# The tags of release names.
RESOLUTION = r"\b(1080[pi]|2160[pi]|720[pi]|4[UK])\b"
CODEC = r"\b(H\.?26[45]|HEVC|AV1|x26[45]|x264)\b"
SOURCE = r"\b(WEB-?DL|BluRay|Remux|HDTV|CAM|WEBRip|BDRip|BRRip)\b"
AUDIO = r"\b(AAC|FLAC|DTS|Atmos|DD5\.?1)\b"
GROUP = r"-([A-Za-z0-9]+)$"
# The forms of a name, with the groups that hold title, season and episode, and the confidence of the form.
FORMS = {
    "sxxexx": (r"(.+?)[.\s_-]+S(\d{1,2})\s*E(\d{1,3})", (1, 2, 3), 0.96),
    "nxnn": (r"(.+?)[.\s_-]+(\d{1,2})x(\d{1,3})", (1, 2, 3), 0.95),
    "bracket_zh": (r".*\[([^\[\]]+?)\s*第(\d{1,2})季\].*?\[(\d{1,3})\](?:[.\[\s_-]|$)", (1, 2, 3), 0.97),
    "bracket_en": (r".*\[([^\[\]]+?)\s+(\d{1,2})(?:st|nd|rd|th)\s+Season\].*?\[(\d{1,3})\](?:[.\[\s_-]|$)", (1, 2, 3), 0.97),
}
MOVIE = r"(.+?)[.\s_-]+(\d{4})"
MOVIE_CONFIDENCE, FALLBACK_CONFIDENCE = 0.92, 0.55
YEAR = r"(?:^|[.\s_\-\[\(])(\d{4})(?:$|[.\s_\-\]\)])"
YEARS = (1900, 2030)


def _i(pattern: str) -> str:
    return f"(?iu){pattern}"


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def drop_noise(name: Column, words: list[str] | None = None) -> Column:
    """The name without the noise words (own ones first), as substrings in any case, with single spaces."""
    every = [*(words or []), *NOISE_WORDS]
    return tidy(reduce(lambda x, w: F.regexp_replace(x, _i(re.escape(w)), " "), every, name))


def clean_title(text: Column) -> Column:
    """Trimmed, without dots, dashes, underscores and spaces at its end, with single spaces."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"[.\-_ ]+$", ""), r"\s+", " ")


def in_years(text: Column) -> Column:
    year = _or_null(text).try_cast("int")
    return F.when(year.between(*YEARS), year)


def year_in(name: Column) -> Column:
    """The first four digits that stand between delimiters, if they are a year."""
    return in_years(F.regexp_extract(name, YEAR, 1))


def media_tags(name: Column) -> dict[str, Column]:
    """The first tag of each class.  A group at the end of the name is no other tag, unless it is part of one."""
    group = F.when(~name.rlike(_i(r"\bWEB-DL$")), _or_null(F.regexp_extract(name, GROUP, 1)))
    body = F.when(group.isNotNull(), F.regexp_replace(name, GROUP, "")).otherwise(name)
    codec = F.upper(_or_null(F.regexp_extract(body, _i(CODEC), 1)))
    return {
        "resolution": F.upper(_or_null(F.regexp_extract(body, _i(RESOLUTION), 1))),
        "codec": F.when(codec == "HEVC", "H.265").otherwise(codec),
        "source": _or_null(F.regexp_extract(body, _i(SOURCE), 1)),
        "audio": _or_null(F.regexp_extract(body, _i(AUDIO), 1)),
        "release_group": group,
    }


def identify(name: Column) -> Column:
    """A struct of what a file name without its extension says; null for a null name.

    raw_title, year, season, episode, resolution, codec, source, release_group, media_suffix, form, confidence.
    """
    return F.when(name.isNotNull(), let(drop_noise(name), lambda cleaned: let(F.struct(*[c.alias(t) for t, c in media_tags(cleaned).items()]), lambda tags: _by_form(cleaned, tags))))


def kind_after(kind: Column, named: Column) -> Column:
    """Items whose name gives a season or an episode are episodes, whatever their kind was."""
    return F.when(named["season"].isNotNull() | named["episode"].isNotNull(), "TvShow").otherwise(kind)


def reasons(named: Column) -> Column:
    """What in a name led to its reading, in order."""
    # The texts of the reasons.
    told = lambda form, *more: F.when(named["form"] == form, F.array_compact(F.array(*more)))
    said = lambda text, c: F.when(c.isNotNull(), F.concat(F.lit(text), c.cast("string")))
    year, resolution, codec, source = said("detected year ", named["year"]), said("detected resolution tag ", named["resolution"]), said("detected codec tag ", named["codec"]), said("detected source tag ", named["source"])
    return F.coalesce(
        told("sxxexx", F.lit("matched TV pattern SxxExx"), year, resolution, codec), told("nxnn", F.lit("matched TV pattern xxXyy"), year, source),
        told("bracket_zh", F.lit("matched bracketed Chinese season/episode pattern"), said("detected release group ", named["release_group"])), told("bracket_en", F.lit("matched bracketed English season/episode pattern"), resolution),
        told("movie", F.lit("matched movie title + year pattern"), said("validated year ", named["year"]), source),
        told("fallback", F.lit("fallback parse after stripping known media tags"), F.lit("no season/episode or title-year anchor matched")),
    )


def _by_form(cleaned: Column, tags: Column) -> Column:
    suffix = _or_null(F.concat_ws(".", *[tags[t] for t in ("resolution", "source", "codec", "audio", "release_group")]))
    part = lambda pattern, group: F.regexp_extract(cleaned, _i(pattern), group)
    field = lambda title, year, season, episode, suffix_, form, confidence: F.struct(title.alias("raw_title"), year.cast("int").alias("year"), season.alias("season"), episode.alias("episode"), suffix_.alias("media_suffix"), F.lit(form).alias("form"), F.lit(confidence).cast("float").alias("confidence"))
    none = F.lit(None).cast("int")
    movie_year = in_years(F.regexp_extract(cleaned, MOVIE, 2))
    found = F.when(F.lit(False), None)
    for form, (pattern, (t, s, e), confidence) in FORMS.items():
        found = found.when(cleaned.rlike(_i(pattern)), field(clean_title(part(pattern, t)), year_in(cleaned), part(pattern, s).try_cast("int"), part(pattern, e).try_cast("int"), suffix, form, confidence))
    movie_suffix = F.when(F.trim(F.regexp_extract(cleaned, f"{MOVIE}(.*)$", 3)) != "", suffix)
    found = found.when(movie_year.isNotNull(), field(clean_title(F.regexp_extract(cleaned, MOVIE, 1)), movie_year, none, none, movie_suffix, "movie", MOVIE_CONFIDENCE))
    stripped = reduce(lambda x, p: F.regexp_replace(x, p, " "), [_i(RESOLUTION), _i(CODEC), _i(SOURCE), _i(AUDIO), r"-[A-Za-z0-9]+$"], cleaned)
    found = found.otherwise(field(tidy(stripped), year_in(cleaned), none, none, suffix, "fallback", FALLBACK_CONFIDENCE))
    order = ["raw_title", "year", "season", "episode", "resolution", "codec", "source", "release_group", "media_suffix", "form", "confidence"]
    return let(found, lambda f: F.struct(*[(tags[c] if c in ("resolution", "codec", "source", "release_group") else f[c]).alias(c) for c in order]))
