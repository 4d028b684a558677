"""Plans of renames and moves, their conflicts, and reports over them.  Plans are data: nothing is moved here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import templates, titles
from corvane.functions.paths import file_name, let, parent, raw_extension
from corvane.session import cut

# Folders of the kinds.
ROOTS = {"Movie": "Movies", "TvShow": "TV Shows", "Strm": "TV Shows", "Music": "Music", "Novel": "Books"}


def rename_plan(items: DataFrame, by_kind: dict[str, str] = templates.TEMPLATES, keep_suffix: bool = False, season_offset: int = 0) -> DataFrame:
    """(id, old_path, new_path) of items whose templated name is new and not empty.

    items: id, path, media_type and any of the fields that templates name; season and episode are given two digits, and
    season_offset is added to the season, which is 0 at least.  Kinds without a template are named like films.  A template that names
    `ext` gives the whole name, others get the file's extension.
    """
    fields = {c: F.col(f"`{c}`") for c in items.columns}
    fields |= {n: templates.two_digits(F.col(c)) for c, names in (("episode", ("episode", "e")),) if c in items.columns for n in names}
    if "season" in items.columns:
        fields |= {n: templates.two_digits(F.when(F.col("season").isNotNull(), F.greatest(F.col("season") + season_offset, F.lit(0)))) for n in ("season", "s")}
    ext = raw_extension(F.col("path"))
    dotted = F.when(ext != "", F.concat(F.lit("."), ext)).otherwise("")
    fields |= {"ext": dotted, "is_tv": F.when(F.col("media_type") == "TvShow", "true")}
    name, whole = F.lit(None).cast("string"), F.lit(False)
    if "Movie" in by_kind:
        name, whole = templates.render(by_kind["Movie"], fields, keep_suffix), F.lit(templates.names_ext(by_kind["Movie"]))
    for kind, template in by_kind.items():
        name = F.when(F.col("media_type") == kind, templates.render(template, fields, keep_suffix)).otherwise(name)
        whole = F.when(F.col("media_type") == kind, templates.names_ext(template)).otherwise(whole)
    made = F.concat(templates.clean_name(name), F.when(whole, "").otherwise(dotted))
    target = F.concat(parent(F.col("path")), F.lit("/"), made)
    # exploding a list of one or none filters without a second copy of the expression
    kept = let(target, lambda t: F.when(t.isNotNull() & (t != F.col("path")), F.array(t)).otherwise(F.array().cast("array<string>")))
    return items.select("id", F.col("path").alias("old_path"), F.explode(kept).alias("new_path"))


def conflicts(plans: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Plans with the number of others that want their target, and whether it exists and is not moved away itself.

    Targets are counted in an aggregate and joined back, so a target wanted by very many is no hot window.  The plans are
    read three times, so they are checkpointed.
    """
    plans = cut(plans)
    wanted = plans.groupBy("new_path").agg(F.count("*").alias("wanted"))
    out = plans.join(wanted, "new_path")
    if existing is None:
        return out.withColumn("occupied", F.lit(False))
    stays = existing.select(F.col("path").alias("new_path")).join(plans.select(F.col("old_path").alias("new_path")), "new_path", "left_anti").distinct()
    return out.join(stays.withColumn("occupied", F.lit(True)), "new_path", "left").withColumn("occupied", F.coalesce("occupied", F.lit(False)))


def target_folder(root: str, kind: Column, title: Column, season: Column, artist: Column) -> Column:
    """The folder an item belongs to: by kind, title (or artist and title), and season."""
    base = F.lit("Other")
    for k, name in ROOTS.items():
        base = F.when(kind == k, name).otherwise(base)
    safe = lambda c: F.nullif(templates.safe_name(c, collapse=False), F.lit(""))
    return F.concat_ws("/", F.lit(root), base, F.when(kind == "Music", safe(artist)), F.coalesce(safe(title), F.lit("Unknown")), _season_folder(kind, season))


def _season_folder(kind: Column, season: Column) -> Column:
    return F.when((kind == "TvShow") & season.isNotNull(), F.concat(F.lit("Season "), templates.two_digits(season)))


def organize_plan(items: DataFrame, root: str, link: str = "none", mode: str = "archive") -> DataFrame:
    """(id, old_path, new_path, action) of items that belong elsewhere; link: none, hard or sym.

    mode: `archive` sorts into folders below the root, `local` into a folder of the title beside the file (items without a
    title stay), `rename` leaves all where they are.
    """
    action = {"none": "Move", "hard": "HardLink", "sym": "SymLink"}[link]
    path, kind = F.col("path"), F.col("media_type")
    folder = {
        "archive": lambda: target_folder(root, kind, F.col("title"), F.col("season"), F.col("artist")),
        "local": lambda: F.when(F.col("title").isNotNull(), F.concat_ws("/", parent(path), templates.safe_name(F.col("title"), collapse=False), _season_folder(kind, F.col("season")))),
        "rename": lambda: parent(path),
    }[mode]()
    target = F.concat(folder, F.lit("/"), file_name(path))
    return items.select("id", path.alias("old_path"), target.alias("new_path"), F.lit(action).alias("action")).filter("new_path <> old_path")


def organize_conflicts(plans: DataFrame, existing: DataFrame, sidecars: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """(id, conflicts): `target_wanted` by another plan, `target_exists`, `sidecar_exists` and `image_exists` on disk.

    plans: id, old_path, new_path.  existing: path.  sidecars: id of the plans that write one beside their target.  images: (id,
    name) of the images that a plan puts into its target's folder.
    """
    there = existing.select(F.col("path").alias("at")).distinct()
    target = F.col("new_path")
    wanted = plans.groupBy("new_path").agg(F.count("*").alias("n")).filter("n > 1").select("new_path")
    found = [plans.join(wanted, "new_path", "left_semi").select("id", F.lit("target_wanted").alias("c")), plans.filter("new_path <> old_path").join(there, target == F.col("at"), "left_semi").select("id", F.lit("target_exists").alias("c"))]
    if sidecars is not None:
        beside = plans.join(sidecars.select("id").distinct(), "id", "left_semi").select("id", F.concat(F.regexp_replace(target, r"(?<=[^/])\.[^./]*$", ""), F.lit(".nfo")).alias("at"))
        found.append(beside.join(there, "at", "left_semi").select("id", F.lit("sidecar_exists").alias("c")))
    if images is not None:
        put = plans.join(images.select("id", "name"), "id").select("id", F.concat(parent(target), F.lit("/"), F.col("name")).alias("at"))
        found.append(put.join(there, "at", "left_semi").select("id", F.lit("image_exists").alias("c")))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    by_plan = every.groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("conflicts"))
    return plans.select("id").distinct().join(by_plan, "id", "left").select("id", F.coalesce("conflicts", F.array().cast("array<string>")).alias("conflicts"))


def image_names(urls: Column) -> Column:
    """The file names of a record's images by their place: poster, fanart, then image; .png where the address holds that, else .jpg."""
    return F.transform(urls, lambda u, i: F.concat(F.when(i == 0, "poster").when(i == 1, "fanart").otherwise("image"), F.when(F.contains(u, F.lit(".png")), ".png").otherwise(".jpg")))


def sidecar(kind: Column, s: Column) -> Column:
    """The text of a metadata file for looked-up fields, null without any."""
    tag = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"  <{name}>"), titles.xml_escaped(value.cast("string")), F.lit(f"</{name}>")))
    uid = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'  <uniqueid type="{name}">'), titles.xml_escaped(value.cast("string")), F.lit("</uniqueid>")))
    episode = (kind == "TvShow") & s["episode_number"].isNotNull()
    root = F.when(kind == "Movie", "movie").when(episode, "episodedetails").when(kind == "TvShow", "tvshow").when(kind == "Music", "music")
    lines = [
        F.lit('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'), F.concat(F.lit("<"), root, F.lit(">")),
        tag("title", F.when(episode, F.coalesce(s["episode_name"], s["title"])).otherwise(s["title"])), F.when(episode, tag("showtitle", s["title"])), tag("originaltitle", s["title_original"]),
        F.when(episode, tag("season", s["season_number"])), F.when(episode, tag("episode", s["episode_number"])), F.when(kind == "Music", tag("artist", s["artist"])), F.when(kind == "Music", tag("album", s["album"])),
        tag("year", s["year"]), tag("plot", s["overview"]), tag("thumb", s["poster_url"]),
        uid("tmdb", s["tmdb_id"]), uid("musicbrainz", s["musicbrainz_id"]), uid("openlibrary", s["openlibrary_id"]), F.concat(F.lit("</"), root, F.lit(">")),
    ]
    return F.when(s.isNotNull() & root.isNotNull(), F.array_join(F.array_compact(F.array(*lines)), "\n"))


def stage_report(items: DataFrame) -> DataFrame:
    """One row of counts over the stages of the pipeline; repeated deliveries count once.

    Items are reduced to a few flags in the scan, so no nested row is shuffled.
    """
    flags = {
        "parsed": F.col("parsed").isNotNull(), "tv": F.coalesce(F.col("media_type") == "TvShow", F.lit(False)), "from_context": F.coalesce(F.col("parsed.parse_source") == "Context", F.lit(False)), "scraped": F.col("scraped").isNotNull(),
        "hashed": F.col("hash").isNotNull(), "hashed_in_full": F.col("hash.full_hash").isNotNull(), "probed": F.col("quality").isNotNull(),
    }
    once = items.select("id", "path", "file_size", *[c.alias(n) for n, c in flags.items()]).distinct()
    return once.agg(F.count("*").alias("items"), *[F.count_if(n).alias(n) for n in flags], F.sum("file_size").alias("bytes"))


def search(items: DataFrame, text: str, *columns: Column) -> DataFrame:
    """Items one of whose columns holds a text, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
    return items.filter(hit)


class Searches:
    """Searches over one listing, each kept until the listing changes."""

    def __init__(self) -> None:
        self._held: dict[tuple, DataFrame] = {}

    def find(self, generation: int, rows: DataFrame, text: str, *columns: Column) -> DataFrame:
        """search(), cached by generation, text and columns; results of other generations are let go.  A blank text finds all."""
        for key in [k for k in self._held if k[0] != generation]:
            self._held.pop(key).unpersist()
        key = (generation, text.strip().lower(), *map(str, columns))
        if key not in self._held:
            self._held[key] = (search(rows, text.strip(), *columns) if text.strip() else rows).cache()
        return self._held[key]


def tree(items: DataFrame) -> DataFrame:
    """(dir, files, bytes, first, last): the folders with what they hold."""
    return items.groupBy(parent(F.col("path")).alias("dir")).agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.min("path").alias("first"), F.max("path").alias("last"))


def execution_summary(plans: DataFrame, blocked: Column, guarded: Column | None = None) -> DataFrame:
    """One row: entries, ready ones (neither blocked nor guarded), blocked and guarded ones."""
    guarded = F.lit(False) if guarded is None else guarded
    return plans.agg(F.count("*").alias("entries"), F.count_if(~blocked & ~guarded).alias("ready"), F.count_if(blocked).alias("blocked"), F.count_if(guarded).alias("guarded"))


def receipt(outcomes: DataFrame) -> DataFrame:
    """One row of counts of the outcomes (outcome, assets) of a run: executed, blocked, guarded, skipped, errors and assets written."""
    of = lambda name: F.count_if(F.col("outcome") == name)
    return outcomes.agg(*[of(n).alias(n) for n in ("executed", "blocked", "guarded", "skipped", "errors")], F.coalesce(F.sum("assets"), F.lit(0)).alias("assets"))


def pipeline_summary(items: DataFrame, stages: int, flag: bool | None = None) -> DataFrame:
    """One row: stage_count, item_count and scraped_items.

    flag: for a scan, whether it looked items up; then all items are reported as looked up, or none.  Without it, those that were are counted.
    """
    looked_up = F.count_if(F.col("scraped").isNotNull()) if flag is None else F.when(F.lit(flag), F.count("*")).otherwise(0)
    return items.agg(F.lit(stages).alias("stage_count"), F.count("*").alias("item_count"), looked_up.cast("bigint").alias("scraped_items"))


# Confidences below which a reading, looked-up metadata and a name are doubtful.
DOUBTFUL_NAME, DOUBTFUL_AUTHORITY, DOUBTFUL_TITLE = 0.6, 0.72, 0.6


def doubts(parsed: Column, scraped: Column, authority: Column, plan: Column) -> Column:
    """What speaks against an item's identity and its plan, as `stage: doubt` texts in order.

    parsed, scraped: what its name and a source say; authority: how far the source is trusted; plan: its stored rename plan.
    """
    f = lambda x: F.lit(x).cast("float")
    said = lambda stage, doubt, when: F.when(when, F.lit(f"{stage}: {doubt}"))
    none = parsed["year"].isNull() & parsed["season"].isNull() & parsed["episode"].isNull()
    return F.array_compact(
        F.array(
            said("identify", "nothing read", parsed.isNull()), said("identify", "low confidence", parsed["confidence"] < f(DOUBTFUL_NAME)), said("identify", "no year and no episode", parsed.isNotNull() & none),
            said("lookup", "nothing found", scraped.isNull()), said("lookup", "low authority", authority < f(DOUBTFUL_AUTHORITY)), said("lookup", "weak source", scraped["source"].isin("Guess", "AiAssist")),
            said("rename", "low title confidence", plan.isNotNull() & (F.coalesce(plan["decision"]["title_confidence"], f(0.0)) < f(DOUBTFUL_TITLE))), said("rename", "conflicts", F.size(plan["conflicts"]) > 0),
        )
    )
