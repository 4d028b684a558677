"""Filling gaps of what a file name says from the names of the folders above it, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.identify import in_years, tidy
from corvane.functions.paths import let

# Forms of names that stand for no title, and marks that follow one.
NO_TITLE_FOLDER = r"(?i)^(?:season\s*\d{1,2}|s\d{1,2}|e\d{1,3}|ep?\d{1,3}|complete|\d{4}|\d{1,3})$"
TRAILING_TAGS = r"(?i)[\s._-]*(?:[\(\[]?\d{4}[\)\]]?)?(?:[\s._-]+(?:4k|2160p|1080p|720p|hdr|dv|dovi|高码|低码|web-?dl|bluray|remux|h265|x265|x264|aac|dts|atmos))+\s*$"
YEAR_AT_END = r"\s*[\(\[](\d{4})[\)\]]\s*$"
SEASONS_AT_END = r"(?i)\s+\d+(?:-\d+)?季(?:全集)?(?:\(\d+\))?\s*$"
ONLY_TAGS = r"(?i)^[\d\s\.\-_\(\)]*(?:hq|hdr|dv|dovi|web-?dl|bluray|remux|x26[45]|h\.?26[45]|aac|dts|atmos|2160p|1080p|720p)+[\d\s\.\-_\(\)]*$"
# one pattern for bare marks and numbers, marks with anything behind them, and names that begin with a season and an episode
PLACEHOLDER = r"(?i)^(?:(?:s\d{1,2}(?:e\d{1,3})?|e\d{1,3}|ep?\d{1,3}|\d{1,3})(?:\s*\(\d+\))?|(?:s\d{1,2}e\d{1,3}|e\d{1,3}|ep?\d{1,3})(?:[\s._-]+.*)?|s\d{1,2}e\d.*)$"
SEASON_EPISODE = r"(?i)^S(\d{1,2})E(\d{1,3})(?:[\s._-].*|\s*\(\d+\))?$"
EPISODE_ONLY = r"(?i)^(?:E|EP)?(\d{1,3})(?:[\s._-].*|\s*\(\d+\))?$"
SEASON_FOLDER = r"(?i)Season\s*(\d{1,2})|S(\d{1,2})\s*$"
YEAR_FOLDER = r"[\[(\s](\d{4})[\])\s]"


def noisy(title: Column) -> Column:
    """Titles that say nothing: tags only, those that begin with 202, or ASCII with three letters and digits at most."""
    text = F.trim(title)
    short = text.rlike(r"^[\x00-\x7f]*$") & (F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")) <= 3)
    return text.startswith("202") | text.rlike(ONLY_TAGS) | short


def placeholder(title: Column) -> Column:
    """Titles to be replaced by that of a folder: empty, episode marks, bare numbers, or noise."""
    text = F.trim(title)
    return (text == "") | text.rlike(PLACEHOLDER) | noisy(text)


def plain_title(name: Column) -> Column:
    """A folder's or file's name as a title: without fillers, tags, years and season packs; null if it names none."""
    bare = F.regexp_replace(F.trim(name), r"(?<=\p{IsHan})[A-Za-z](?=\p{IsHan})", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, TRAILING_TAGS, ""), YEAR_AT_END, ""), SEASONS_AT_END, "")
    names_one = ~name.startswith(".") & ~F.trim(name).rlike(NO_TITLE_FOLDER)
    return F.when(names_one, let(tidy(F.regexp_replace(bare, "[._]+", " ")), lambda text: F.when((text != "") & ~noisy(text), text)))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def infer(title: Column, year: Column, season: Column, episode: Column, confidence: Column, folders: Column) -> Column:
    """A struct of raw_title, year, season, episode, confidence and from_folder (whether the title is a folder's).

    folders: names of the folders above, the nearest first; three are looked at for season and year, two for the title.
    What is known stays; each inference raises the confidence to its own at least.
    """
    text = F.trim(title)
    both, alone = text.rlike(SEASON_EPISODE), text.rlike(EPISODE_ONLY)
    number = lambda pattern, group: F.regexp_extract(text, pattern, group).try_cast("int")
    open_ = episode.isNull()
    season1 = F.when(open_ & both, F.coalesce(season, number(SEASON_EPISODE, 1))).otherwise(season)
    episode1 = F.when(open_ & both, number(SEASON_EPISODE, 2)).when(open_ & alone, number(EPISODE_ONLY, 1)).otherwise(episode)
    marks = ~(season1.eqNullSafe(season) & episode1.eqNullSafe(episode))
    title1 = F.coalesce(plain_title(title), title)
    three = F.slice(folders, 1, 3)
    season_of = lambda d: F.coalesce(F.nullif(F.regexp_extract(d, SEASON_FOLDER, 1), F.lit("")), F.nullif(F.regexp_extract(d, SEASON_FOLDER, 2), F.lit(""))).try_cast("int")
    found_season = F.when(season1.isNull(), _first(F.transform(three, season_of)))
    found_year = F.when(year.isNull(), _first(F.transform(three, lambda d: in_years(F.regexp_extract(d, YEAR_FOLDER, 1)))))
    found_title = F.when(let(title1, placeholder), _first(F.transform(F.slice(folders, 1, 2), plain_title)))
    raised = lambda known, least: F.when(known, F.lit(least).cast("float")).otherwise(F.lit(0.0).cast("float"))
    sure = F.greatest(confidence, raised(marks, 0.72), raised(found_season.isNotNull(), 0.84), raised(found_year.isNotNull(), 0.8), raised(found_title.isNotNull(), 0.76))
    return F.struct(
        F.coalesce(found_title, title1).alias("raw_title"), F.coalesce(year, found_year).alias("year"), F.coalesce(season1, found_season).alias("season"),
        episode1.alias("episode"), sure.alias("confidence"), found_title.isNotNull().alias("from_folder"),
    )
