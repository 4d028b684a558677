"""Forms of titles for lookups, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.paths import let

# Words left out of lookups, and folder names that say nothing.
QUERY_NOISE = ["1080p", "720p", "2160p", "4k", "webrip", "web-dl", "bluray", "brrip", "x264", "x265", "h264", "h265", "hevc", "aac", "dts", "hdr", "dv"]
NO_HINT = r"^(?:season 0?[12]|s0?[12]|s[0-9]{0,5})$"


def query_form(title: Column) -> Column:
    """Dots and underscores as spaces, each pair of spaces halved once, trimmed."""
    return F.trim(F.replace(F.replace(F.replace(title, F.lit("."), F.lit(" ")), F.lit("_"), F.lit(" ")), F.lit("  "), F.lit(" ")))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def without_noise(title: Column) -> Column:
    return F.array_join(F.filter(_words(query_form(title)), lambda w: ~F.lower(w).isin(QUERY_NOISE)), " ")


def identity_form(title: Column) -> Column:
    """Without noise, years from 1900 to 2099 and marks like s01e02."""
    return F.array_join(F.filter(_words(without_noise(title)), lambda w: ~w.rlike("^(?:19|20)[0-9]{2}$") & ~F.lower(w).rlike("^s[0-9]{2}e[0-9]{2}$")), " ")


def distinct_ignoring_case(texts: Column) -> Column:
    """The trimmed texts that aren't empty, the first of those that differ in case only, in order."""
    trimmed = F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x != "")
    return let(trimmed, lambda t: let(F.transform(t, F.lower), lambda keys: F.filter(t, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def variants(title: Column) -> Column:
    """The forms under which a title is looked up, the most literal first; none for a blank or null title."""
    text = F.trim(F.coalesce(title, F.lit("")))
    bare, identity = without_noise(text), identity_form(text)
    return distinct_ignoring_case(F.array(text, query_form(text), bare, query_form(bare), identity, query_form(identity)))


def folder_hints(folders: Column) -> Column:
    """The names of folders (the nearest first) that may be titles."""
    named = F.filter(F.transform(folders, query_form), lambda x: (x != "") & ~F.lower(x).rlike(NO_HINT))
    return distinct_ignoring_case(named)


def query_plan(title: Column, evidence: Column, folders: Column) -> Column:
    """All forms to look an item up by: those of its title, of titles seen in its content, and of its folders."""
    none = F.array().cast("array<string>")
    every = F.concat(variants(title), F.flatten(F.transform(F.coalesce(evidence, none), variants)), F.flatten(F.transform(folder_hints(F.slice(F.coalesce(folders, none), 1, 4)), variants)))
    return distinct_ignoring_case(every)


def artist_and_title(raw: Column) -> Column:
    """Structs of artist and title: by each kind of dash that parts the text, else the first word and the rest, else the text twice."""
    text = query_form(raw)
    dashes = [" - ", " – ", " — "]
    cuts = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(d)), F.struct(F.trim(F.substring_index(text, d, 1)).alias("artist"), F.trim(F.substring(text, F.instr(text, d) + len(d), F.length(text))).alias("title"))) for d in dashes]))
    cuts = F.filter(cuts, lambda c: (c["artist"] != "") & (c["title"] != ""))
    words = _words(text)
    halves = F.struct(F.get(words, F.lit(0)).alias("artist"), F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), " ").alias("title"))
    return F.when(F.size(cuts) > 0, cuts).when(F.size(words) >= 2, F.array(halves)).otherwise(F.array(F.struct(text.alias("artist"), text.alias("title"))))


def match_form(title: Column) -> Column:
    return F.lower(query_form(without_noise(title)))


def percent_encoded(text: Column) -> Column:
    """Every byte but letters, digits and `-_.~` as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def xml_escaped(text: Column) -> Column:
    out = text
    for raw, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        out = F.replace(out, F.lit(raw), F.lit(f"&{name};"))
    return out


def json_in(text: Column) -> Column:
    """The JSON object in an answer: of the first block marked as JSON, else from the first brace to the last; empty without any."""
    marked = F.regexp_extract(text, r"(?s)```json(.*?)```", 1)
    return F.when(text.rlike(r"(?s)```json.*?```"), F.trim(F.regexp_replace(marked, r"^\s+|\s+$", ""))).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))


def human_bytes(count: Column) -> Column:
    """A number of bytes in the greatest unit that it fills, with one digit."""
    size = count.cast("double")
    out = F.when(size < 1024, F.concat(count.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        scaled = F.format_string(f"%.1f {unit}", size / 1024**i)
        out = out.when(size < 1024 ** (i + 1), scaled) if unit != "TB" else out.otherwise(scaled)
    return F.when(count.isNotNull(), out)


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(max(most - 1, 0))), F.lit("…"))).otherwise(text)
