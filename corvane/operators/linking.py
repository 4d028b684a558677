"""Lookups: caches, ordered sources, candidates, companions and ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import titles
from corvane.functions.paths import ancestor_paths, beginnings, parent, stem

# Points of a candidate.
EXACT_TITLE, PART_TITLE, SAME_YEAR, NEAR_YEAR, OTHER_YEAR = 1.2, 0.7, 0.45, 0.12, -0.25
SERIES_ID, SAME_SEASON, SAME_EPISODE, SEEN_EXACT, SEEN_PART, HIGH_RATING = 0.08, 0.18, 0.22, 0.48, 0.18, 0.05


def newest(entries: DataFrame, key: list[str], at: str = "updated_at") -> DataFrame:
    """The last entry of each key; of equal times the greatest in the other columns."""
    rest = [c for c in entries.columns if c not in (*key, at)]
    return entries.groupBy(*key).agg(F.max(F.struct(at, *rest)).alias("r")).select(*key, "r.*")


def alive(entries: DataFrame, now: Column, days: int, at: str = "updated_at") -> DataFrame:
    """Entries not older than so many days; entries without a time stay, and 0 days keep all."""
    return entries if days == 0 else entries.filter(F.col(at).isNull() | (now - F.col(at) <= days * 86400))


def with_cache(items: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items with the cached columns, items without an entry).

    Items without an entry keep their row, with nulls; of several entries of a key one counts, the greatest, so no row multiplies.
    """
    rest = [c for c in cache.columns if c not in key]
    once = cache.groupBy(*key).agg(F.max(F.struct(*rest)).alias("r")).select(*key, "r.*") if rest else cache.select(*key).distinct()
    return items.join(once, key, "left"), items.join(cache.select(*key).distinct(), key, "left_anti")


def cache_key(*parts: Column) -> Column:
    """The text by which an item is found in a cache: its parts, with nothing for nulls, between colons."""
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def cached_else_live(cached: DataFrame | None, live: DataFrame, root: str, fresh: bool) -> DataFrame:
    """A cached listing if there is one and it is fresh, else the live one; of a single file (its path being the root) only that."""
    rows = cached if cached is not None and fresh else live
    return rows.filter((F.col("path") == root) | F.col("path").startswith(root.rstrip("/") + "/"))


def first_source(answers: DataFrame, key: str, source: str, chain: list[str]) -> DataFrame:
    """The answer of the first source in the chain that has one, for each key; sources outside the chain are left out."""
    place = F.array_position(F.array(*[F.lit(c) for c in chain]), F.col(source))
    rest = [c for c in answers.columns if c != key]
    return answers.withColumn("__p", place).filter("__p > 0").groupBy(key).agg(F.min(F.struct("__p", *rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def candidate_score(title: Column, year: Column, season: Column, kind: Column, seen: Column, cand_title: Column, cand_original: Column, cand_year: Column, cand_id: Column, rating: Column, episode: Column | None = None, cand_season: Column | None = None, cand_episode: Column | None = None) -> Column:
    """How well a candidate fits an item (FLOAT).  seen: titles found in the item's content, of which the first exact one ends the count.

    For episodes, season and episode may be given on both sides.
    """
    own, theirs, original = titles.match_form(title), titles.match_form(cand_title), F.coalesce(titles.match_form(cand_original), F.lit(""))
    named = F.when((own != "") & ((theirs == own) | (original == own)), EXACT_TITLE).when((own != "") & (F.contains(theirs, own) | F.contains(own, theirs) | (original != "") & F.contains(original, own)), PART_TITLE).otherwise(0.0)
    dated = F.when(year.isNull() | cand_year.isNull(), 0.0).when(year == cand_year, SAME_YEAR).when(F.abs(year - cand_year) == 1, NEAR_YEAR).otherwise(OTHER_YEAR)
    serial = F.when((kind == "TvShow") & season.isNotNull() & cand_id.isNotNull(), SERIES_ID).otherwise(0.0)
    if cand_season is not None:
        serial = serial + F.when((kind == "TvShow") & (season == cand_season), SAME_SEASON).otherwise(0.0)
    if episode is not None and cand_episode is not None:
        serial = serial + F.when((kind == "TvShow") & (episode == cand_episode), SAME_EPISODE).otherwise(0.0)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("done"))

    def fold(acc: Column, text: Column) -> Column:
        form = titles.match_form(text)
        exact = (form == theirs) | (form == original)
        part = F.contains(theirs, form) | F.contains(form, theirs) | (original != "") & F.contains(original, form)
        gain = F.when(acc["done"] | (form == ""), 0.0).when(exact, SEEN_EXACT).when(part, SEEN_PART).otherwise(0.0)
        return F.struct((acc["sum"] + F.coalesce(gain, F.lit(0.0))).alias("sum"), (acc["done"] | F.coalesce((form != "") & exact, F.lit(False))).alias("done"))

    shown = F.aggregate(F.coalesce(seen, F.array().cast("array<string>")), start, fold)["sum"]
    return (F.coalesce(named, F.lit(0.0)) + dated + serial + shown + F.when(rating >= 7.0, HIGH_RATING).otherwise(0.0)).cast("float")


def lookups(items: DataFrame, catalogue: DataFrame, most: int = 5) -> DataFrame:
    """Candidates (item columns, c_* columns, score, rank, gap) of items by any form of their title, the best `most` of each.

    items: id, title, year, season, media_type, seen.  catalogue: id, title, original, year, rating.  An item meets a title
    through an equi-join on the form; the year, where both are known, may be off by one.  gap is the lead over the next.
    Equal questions are asked once: items meet the answers by their question, so a title that many items hold is compared once.
    """
    question = ["title", "year", "season", "media_type", "seen"]
    marked = items.withColumn("q", F.unhex(F.md5(F.to_json(F.struct(*question)).cast("binary"))))
    once = marked.groupBy("q").agg(*[F.first(c).alias(c) for c in question])
    asked = once.withColumn("form", F.explode(F.array_distinct(F.transform(titles.variants(F.col("title")), titles.match_form)))).filter("form <> ''")
    named = catalogue.select(*[F.col(c).alias(f"c_{c}") for c in catalogue.columns]).withColumn("form", F.explode(F.array_distinct(F.array_compact(F.array(titles.match_form(F.col("c_title")), titles.match_form(F.col("c_original"))))))).filter("form <> ''")
    met = asked.join(named, "form").filter("year is null or c_year is null or abs(year - c_year) <= 1").drop("form")
    # what has no id is one by its title and year
    met = met.withColumn("c_key", F.coalesce(F.concat(F.lit("id:"), F.col("c_id").cast("string")), F.concat(F.lit("title:"), F.col("c_title"), F.lit(":"), F.coalesce("c_year", F.lit(0)).cast("string")))).dropDuplicates(["q", "c_key"])
    scored = met.withColumn("score", candidate_score(*[F.col(c) for c in ("title", "year", "season", "media_type", "seen", "c_title", "c_original", "c_year", "c_id", "c_rating")]))
    w = W.partitionBy("q").orderBy(F.desc("score"), F.col("c_id").asc_nulls_last(), "c_key")
    best = scored.withColumn("rank", F.row_number().over(w)).withColumn("gap", (F.col("score") - F.lead("score").over(w)).cast("float")).filter(F.col("rank") <= most)
    return marked.join(best.drop(*question, "c_key"), "q").drop("q")


def companions(files: DataFrame, others: DataFrame) -> DataFrame:
    """(id, companion): others (path) in a file's folder named like it, its stem being followed by nothing, a dot or a dash.

    The join is on folder and on each beginning of the other's name that may be a stem, so it stays an equi-join.
    """
    name = stem(F.col("path"))
    cut = others.select(F.col("path").alias("companion"), parent(F.col("path")).alias("dir"), F.explode(beginnings(name)).alias("stem"))
    return files.select("id", parent(F.col("path")).alias("dir"), name.alias("stem"), "path").join(cut, ["dir", "stem"]).filter("path <> companion").select("id", "companion")


def nearest_above(items: DataFrame, folders: DataFrame, most: int) -> DataFrame:
    """Items with the columns of the nearest folder above them that is listed, at most so many levels up, and its depth (0: own folder).

    Items are joined once for each level by equality; items without such a folder have no row.  folders: dir and others.
    """
    above = items.select("*", F.posexplode(F.slice(ancestor_paths(F.col("path")), 1, most)).alias("depth", "dir"))
    met = above.join(folders, "dir")
    rest = [c for c in met.columns if c not in ("id", "depth")]
    return met.groupBy("id").agg(F.min(F.struct("depth", *rest)).alias("r")).select("id", "r.*")
