"""Plans for folders and subtitles that go with renamed files, and the search for files that belong to others.

Folders are known by the paths of the files in them.  Joins on folders are by equality: ancestors are unfolded for
each distinct folder, not for each file, so a folder that holds a third of all files is unfolded once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import templates
from corvane.functions.paths import ancestor_paths, beginnings, extension, file_name, parent, raw_extension, stem

# Extensions of subtitles (renamed with their file; read as text), and names of season folders.
SUBTITLES = ["srt", "ass", "ssa", "sub", "idx", "vtt"]
TEXT_SUBTITLES = ["srt", "ass", "ssa", "vtt"]
SEASON_NAME = r"(?i)^(?:S\d{1,2}|Season\s+\d{1,2})$"
SHOW_SIDECAR = "tvshow.nfo"


def season_parents(files: DataFrame) -> DataFrame:
    """(dir): folders that hold a folder named like a season."""
    folders = files.select(parent(F.col("path")).alias("dir")).distinct()
    every = folders.select(F.explode(F.concat(F.array("dir"), ancestor_paths(F.col("dir")))).alias("dir")).distinct()
    return every.filter(F.trim(file_name(F.col("dir"))).rlike(SEASON_NAME)).select(parent(F.col("dir")).alias("dir")).distinct()


def folder_plans(items: DataFrame) -> DataFrame:
    """(old_path, new_path): one plan for each folder whose name isn't the one its items want.

    items: id, path, media_type, title, year, season.  Episodes want a folder of their season in one of their title; films one of
    their title and year, unless a folder beside theirs is named like a season.  Of several wishes for a folder the one of the
    smallest id counts, and of one item the season before the title.  Items without the names, and folders at the root, want nothing.
    """
    path, title = F.col("path"), templates.safe_name(F.col("title"))
    own, above = parent(path), parent(parent(path))
    series, film = F.col("media_type").isin("TvShow", "Strm"), F.col("media_type") == "Movie"
    year = F.when(F.col("year").isNotNull(), F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")"))).otherwise("")
    wish = lambda folder, name, film_: F.struct(folder.alias("old_path"), F.nullif(templates.safe_name(name), F.lit("")).alias("name"), F.lit(film_).alias("film"))
    named = F.nullif(title, F.lit(""))
    wishes = F.array(
        F.when(series & F.col("season").isNotNull(), wish(own, F.concat(F.lit("Season "), templates.two_digits(F.col("season"))), False)),
        F.when(series & named.isNotNull(), wish(above, named, False)),
        F.when(film & named.isNotNull(), wish(own, F.concat(named, year), True)),
    )
    asked = items.select("id", F.posexplode(F.array_compact(wishes)).alias("k", "w")).select("id", "k", "w.*").filter((F.col("name").isNotNull()) & (file_name(F.col("old_path")) != "") & (file_name(F.col("old_path")) != F.col("name")))
    seasons = season_parents(items).withColumnRenamed("dir", "above")
    films = asked.filter("film").withColumn("above", parent(F.col("old_path"))).join(seasons, "above", "left_anti").drop("above")
    first = asked.filter("not film").unionByName(films).groupBy("old_path").agg(F.min(F.struct("id", "k", "name")).alias("m"))
    return first.select("old_path", F.concat(parent(F.col("old_path")), F.lit("/"), F.col("m.name")).alias("new_path"))


def attached(plans: DataFrame, folders: DataFrame) -> DataFrame:
    """Plans (id, old_path, new_path) with folder_plans: those of the folders above their file, the deepest first; and the plans of
    folders above no planned file, with a null id and the folder as both paths."""
    dirs = plans.select(parent(F.col("old_path")).alias("dir")).distinct()
    above = dirs.select("dir", F.explode(F.concat(F.array("dir"), ancestor_paths(F.col("dir")))).alias("at"))
    met = above.join(folders.select(F.col("old_path").alias("at"), F.col("new_path").alias("to")), "at")
    depth = -F.size(F.split("at", "/"))
    by_dir = met.groupBy("dir").agg(F.array_sort(F.collect_set(F.struct(depth.alias("depth"), F.col("at").alias("old_path"), F.col("to").alias("new_path")))).alias("f"))
    by_dir = by_dir.select("dir", F.transform("f", lambda x: F.struct(x["old_path"].alias("old_path"), x["new_path"].alias("new_path"))).alias("folder_plans"))
    none = F.array().cast("array<struct<old_path:string,new_path:string>>")
    held = plans.withColumn("dir", parent(F.col("old_path"))).join(by_dir, "dir", "left").select("id", "old_path", "new_path", F.coalesce("folder_plans", none).alias("folder_plans"))
    used = met.select(F.col("at").alias("old_path")).distinct()
    alone = folders.join(used, "old_path", "left_anti")
    own = F.array(F.struct("old_path", "new_path"))
    return held.unionByName(alone.select(F.lit(None).cast(dict(plans.dtypes)["id"]).alias("id"), "old_path", F.col("old_path").alias("new_path"), own.alias("folder_plans")))


def subtitle_plans(plans: DataFrame, files: DataFrame) -> DataFrame:
    """(id, old_path, new_path): the subtitles that are named like a planned file, with its new name and what follows the old one.

    plans: id, old_path, new_path, the new path ending with the old extension.  files: path.
    """
    subs = files.select(F.col("path").alias("sub")).distinct().filter(extension(F.col("sub")).isin(SUBTITLES)).select("sub", parent(F.col("sub")).alias("dir"), F.explode(beginnings(stem(F.col("sub")))).alias("stem"))
    old, ext = F.col("old_path"), raw_extension(F.col("old_path"))
    name = F.when(ext != "", F.expr("left(new_path, length(new_path) - length(ext) - 1)")).otherwise(F.col("new_path"))
    rows = plans.withColumn("ext", ext).select("id", parent(old).alias("dir"), stem(old).alias("stem"), name.alias("to"))
    rest = F.expr("substring(sub, length(dir) + 2 + length(stem))")
    return rows.join(subs, ["dir", "stem"]).select("id", F.col("sub").alias("old_path"), F.concat("to", rest).alias("new_path"))


def external_subtitles(items: DataFrame, files: DataFrame) -> DataFrame:
    """(id, subtitle): the text subtitles named like a file, or, without any, the only one of its folder.

    The only one of a folder is found by an aggregate, so a folder full of subtitles is never gathered.
    """
    subs = files.select(F.col("path").alias("subtitle")).distinct().filter(extension(F.col("subtitle")).isin(TEXT_SUBTITLES)).withColumn("dir", parent(F.col("subtitle")))
    rows = items.select("id", parent(F.col("path")).alias("dir"), stem(F.col("path")).alias("stem"))
    named = rows.join(subs.select("subtitle", "dir", F.explode(beginnings(stem(F.col("subtitle")))).alias("stem")), ["dir", "stem"]).select("id", "subtitle").distinct()
    single = subs.groupBy("dir").agg(F.count("*").alias("n"), F.min("subtitle").alias("subtitle")).filter("n = 1").drop("n")
    rest = rows.join(named.select("id").distinct(), "id", "left_anti").join(single, "dir").select("id", "subtitle")
    return named.unionByName(rest.distinct())


def sidecars(items: DataFrame, files: DataFrame, most: int = 2) -> DataFrame:
    """(id, sidecar, level): the metadata file of each item: one named like it (level 0), that of the show in its folder (1), or in one of
    the `most` folders above (2 and on).  Items without any have no row."""
    own = items.select("id", F.concat(parent(F.col("path")), F.lit("/"), stem(F.col("path")), F.lit(".nfo")).alias("sidecar"), F.lit(0).alias("level"))
    folders = items.select("id", parent(F.col("path")).alias("dir"))
    known = files.select(F.col("path").alias("sidecar")).distinct()
    shows = known.filter(file_name(F.col("sidecar")) == SHOW_SIDECAR)
    dirs = folders.select("dir").distinct()
    chain = dirs.select("dir", F.posexplode(F.slice(F.concat(F.array("dir"), ancestor_paths(F.col("dir"))), 1, most + 1)).alias("k", "at"))
    nearest = chain.select("dir", (F.col("k") + 1).alias("level"), F.concat("at", F.lit(f"/{SHOW_SIDECAR}")).alias("sidecar")).join(shows, "sidecar").groupBy("dir").agg(F.min(F.struct("level", "sidecar")).alias("m"))
    found = own.join(known, "sidecar").select("id", "level", "sidecar").unionByName(folders.join(nearest, "dir").select("id", "m.level", "m.sidecar"))
    return found.groupBy("id").agg(F.min(F.struct("level", "sidecar")).alias("m")).select("id", "m.sidecar", "m.level")


def rename_conflicts(plans: DataFrame, subtitles: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, conflicts): what stands against each plan: `target_wanted`, `target_exists`, `subtitle_wanted`, `subtitle_exists`.

    A target is wanted if another plan or subtitle has it too; it exists if a file is there that no plan moves away.  Plans
    without conflicts have an empty list.  plans and subtitles: id, old_path, new_path.  existing: path.
    """
    moves = plans.filter("old_path <> new_path").select("id", "new_path", F.lit("target").alias("what")).unionByName(subtitles.select("id", "new_path", F.lit("subtitle").alias("what")))
    stays = existing.select(F.col("path").alias("new_path")).distinct().join(plans.select(F.col("old_path").alias("new_path")).distinct(), "new_path", "left_anti").withColumn("there", F.lit(True))
    judged = moves.groupBy("new_path").agg(F.count("*").alias("n")).join(stays, "new_path", "left")
    bad = moves.join(judged.filter("n > 1 or there"), "new_path")
    said = F.array_compact(F.array(F.when(F.col("n") > 1, F.concat("what", F.lit("_wanted"))), F.when(F.col("there"), F.concat("what", F.lit("_exists")))))
    by_plan = bad.select("id", F.explode(said).alias("c")).groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("conflicts"))
    return plans.select("id").distinct().join(by_plan, "id", "left").select("id", F.coalesce("conflicts", F.array().cast("array<string>")).alias("conflicts"))
