"""Duplicate detection by content and by version, and the choice of the item to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import scoring
from corvane.functions.paths import parent
from corvane.session import cut


def latest(df: DataFrame, key: str = "id", by: str = "loaded_at") -> DataFrame:
    """One row per key, the one loaded last; rows delivered twice count once.  Chosen by a map-side combined maximum."""
    rest = [c for c in df.columns if c not in (key, by)]
    best = df.groupBy(key).agg(F.max_by(F.struct(by, *rest), F.coalesce(F.unix_micros(F.col(by).cast("timestamp")), F.lit(-(2**62)))).alias("r"))
    return best.select(key, "r.*").select(*df.columns)


def progressive_hash(df: DataFrame, key: str, text: str, prefix: int = 65536) -> DataFrame:
    """(key, size, prefix_hash, full_hash): hashes where they can still tell rows apart, else null.

    A row has a prefix hash if another one has its size, and a full hash if another one has its size and prefix hash.
    The text is read once, by the scan that makes the digests, and those alone are checkpointed and shuffled.  Sizes and
    hashes are counted in aggregates and come back by one join, so no window holds a large group.
    """
    raw, size = F.col(f"`{text}`").cast("binary"), F.octet_length(F.col(f"`{text}`"))
    head = F.md5(F.substring(raw, 1, prefix))
    rows = cut(df.select(F.col(f"`{key}`").alias("key"), size.alias("size"), head.alias("head"), F.when(size > prefix, F.md5(raw)).otherwise(head).alias("full")))
    heads = rows.filter("size is not null").groupBy("size", "head").agg(F.count("*").alias("same_head"))
    sizes = heads.groupBy("size").agg(F.sum("same_head").alias("same_size")).filter("same_size > 1")
    met = rows.join(heads.join(sizes, "size"), ["size", "head"], "left")
    return met.select("key", "size", F.when(F.col("same_size") > 1, F.col("head")).alias("prefix_hash"), F.when(F.col("same_head") > 1, F.col("full")).alias("full_hash"))


def exact_groups(items: DataFrame, digest: Column) -> DataFrame:
    """(digest, n, first, last) of digests that several items have; items: id and what the digest needs."""
    return items.select("id", digest.alias("digest")).filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).filter("n > 1")


def folder_clusters(items: DataFrame) -> DataFrame:
    """(dir, cluster): whether a folder holds three video files, two of them named like episodes."""
    path = F.col("path")
    video = scoring.is_cluster_file(path)
    return items.groupBy(parent(path).alias("dir")).agg(((F.count_if(video) >= 3) & (F.count_if(video & scoring.is_episode_name(path)) >= 2)).alias("cluster"))


#: Columns that judged() adds, beside id, path, media_type and file_size.
JUDGED = ["title", "origin", "year", "season", "episode", "trust", "metadata_confidence", "quality_score", "version_quality", "completeness", "effective", "provenance", "version_key", "full_hash"]


def judged(items: DataFrame, *more: Column, scored: bool = True) -> DataFrame:
    """Items with their preferred title, year, season and episode, trust, provenance, scores and version key.

    scored: without it, no columns from quality_score on are made, and the folders aren't looked at.

    Repeated deliveries count once.  The wide structs are reduced to a few plain columns in the scan, before anything is
    shuffled.  more: other columns to carry.
    """
    p, s, state = F.col("parsed"), F.col("scraped"), F.col("identity_resolution.confirmation_state")
    trust_p, trust_s = scoring.clamp(p["confidence"]), scoring.scraped_authority(s["confidence"], s["source"], state)
    blank = lambda c: F.when(F.trim(c) != "", c)
    quality, content = F.col("quality"), F.col("content_evidence")
    plain, deep = [
        "id", "path", "media_type", "file_size",
        scoring.preferred(blank(p["raw_title"]), trust_p, blank(s["title"]), trust_s).alias("t"),
        scoring.preferred(p["year"], trust_p, s["year"], trust_s)["value"].alias("year"),
        scoring.preferred(p["season"], trust_p, s["season_number"], trust_s)["value"].alias("season"),
        scoring.preferred(p["episode"], trust_p, s["episode_number"], trust_s)["value"].alias("episode"),
        scoring.identity_trust(state).alias("trust"), F.coalesce(trust_s, trust_p, scoring.f32(0.0)).alias("known_trust"), *more,
    ], [
        F.coalesce(quality["quality_score"], F.lit(0.0)).alias("quality_score"), scoring.version_quality(p, quality, content).alias("version_quality"),
        scoring.completeness(F.col("media_type"), F.col("path"), quality, content, F.lit("feature")).alias("completeness"),
        *[s[c].alias(f"s_{c}") for c in ("tmdb_id", "musicbrainz_id", "openlibrary_id", "year")], F.col("hash.full_hash").alias("full_hash"),
    ]
    carried = items.select(*more).columns if more else []
    if not scored:
        rows = items.select(*plain).distinct().withColumns({"title": F.col("t.value"), "origin": F.col("t.origin"), "metadata_confidence": F.coalesce("t.confidence", "known_trust")})
        return rows.select("id", "path", "media_type", "file_size", *JUDGED[: JUDGED.index("quality_score")], *carried)
    narrow = items.select(*plain, *deep).distinct()
    wide = narrow.withColumn("dir", parent(F.col("path"))).join(folder_clusters(items.select("id", "path").distinct()), "dir", "left")
    wide = wide.withColumns({"title": F.col("t.value"), "origin": F.col("t.origin"), "provenance": scoring.provenance(F.col("media_type"), F.col("path"), F.coalesce("cluster", F.lit(False)))})
    wide = wide.withColumns({"metadata_confidence": F.coalesce("t.confidence", "known_trust"), "completeness": F.col("completeness") + scoring.pick(F.col("provenance"), scoring.PROVENANCE_BONUS)})
    effective = F.round(scoring.total(F.col("quality_score"), F.col("version_quality"), F.col("completeness"), 0.35 * F.col("metadata_confidence").cast("double"), 0.45 * F.col("trust").cast("double")), 9)
    return wide.withColumns({"effective": effective, "version_key": version_key()}).select("id", "path", "media_type", "file_size", *JUDGED, *carried)


def version_key() -> Column:
    """The key that versions of one work share: a trusted id with its episode or year, else title, year, episode and provenance."""
    episode = F.format_string("S%02dE%02d", F.coalesce("season", F.lit(0)), F.coalesce("episode", F.lit(0)))
    year = F.coalesce("year", F.lit(0)).cast("string")
    by_id = F.when(
        F.col("trust") >= scoring.f32(scoring.ID_TRUST),
        F.when(
            F.col("s_tmdb_id").isNotNull(),
            F.when(F.col("media_type").isin("TvShow", "Strm"), F.concat(F.lit("tmdb:tv:"), F.col("s_tmdb_id").cast("string"), F.lit(":"), episode, F.lit(":"), F.col("provenance"))).otherwise(
                F.concat(F.lit("tmdb:movie:"), F.col("s_tmdb_id").cast("string"), F.lit(":"), F.coalesce(F.col("s_year").cast("string"), year))
            ),
        )
        .when(F.col("s_musicbrainz_id").isNotNull(), F.concat(F.lit("musicbrainz:"), F.col("s_musicbrainz_id")))
        .when(F.col("s_openlibrary_id").isNotNull(), F.concat(F.lit("openlibrary:"), F.col("s_openlibrary_id"))),
    )
    return F.coalesce(by_id, F.concat(F.lit("fallback:"), F.col("title"), F.lit("|"), year, F.lit("|"), episode, F.lit(":"), F.col("provenance")))


def version_groups(rated: DataFrame) -> DataFrame:
    """(version_key, n, keep_id, and extremes of the others) of keys that several items share and whose content isn't all equal.

    The item to keep has the greatest effective score, then quality, trust, confidence, size and id.  All are
    maxima combined before the shuffle, so a series with a third of all items is no burden.
    """
    order = F.struct("effective", "quality_score", "trust", "metadata_confidence", "file_size", F.col("id").alias("id"), "completeness")
    full = F.col("full_hash")
    out = rated.filter("version_key is not null").groupBy("version_key").agg(
        F.count("*").alias("n"), F.max(order).alias("best"), F.count(full).alias("hashed"), F.min(full).alias("low"), F.max(full).alias("high"),
        F.min("completeness").alias("least_completeness"), F.max("metadata_confidence").alias("most_confidence"), F.max("file_size").alias("largest"),
    )
    return out.filter(~((F.col("hashed") == F.col("n")) & (F.col("low") == F.col("high"))) & (F.col("n") > 1)).select("version_key", "n", F.col("best.id").alias("keep_id"), F.col("best.effective").alias("keep_score"), "least_completeness", "most_confidence", "largest")


def latest_decisions(items: DataFrame) -> DataFrame:
    """(content_id, item_index, is_keep): the row decided last of each; of rows decided at once a kept one counts.  Rows without ids are none."""
    at = F.coalesce(F.unix_micros(F.col("decided_at").cast("timestamp")), F.lit(-(2**62)))
    best = items.filter("content_id is not null and item_index is not null").groupBy("content_id", "item_index").agg(F.max(F.struct(at.alias("at"), "is_keep")).alias("m"))
    return best.select("content_id", "item_index", "m.is_keep")


#: How to choose the item of a group to keep.
STRATEGIES = ["HighestQuality", "Newest", "Largest", "Manual"]


def keep_order(strategy: str) -> Column:
    """The order of which the greatest item is kept; null for items that can't be.  Ties go to the greater id.

    Items without a time are never the newest, and with `Manual` none is kept.
    """
    if strategy == "HighestQuality":
        return F.struct("effective", "quality_score", "trust", "metadata_confidence", "file_size", "id")
    if strategy == "Newest":
        return F.when(F.col("mtime").isNotNull(), F.struct("mtime", "id"))
    if strategy == "Largest":
        return F.struct("file_size", "id")
    return F.when(F.lit(False), F.struct("id"))


def members(rated: DataFrame) -> DataFrame:
    """Rated items with content_id and kind of each group they are in: `Exact` ones of equal content and `Version` ones of one work, unless
    all of those are equal.  An item may be in one of each; items alone are in none.  The rated items are read four times, so they are checkpointed."""
    rated = cut(rated)
    full, version = F.col("full_hash"), F.col("version_key")
    exact = rated.filter(full.isNotNull()).withColumn("content_id", F.concat(F.lit("hash:"), full.cast("string"))).withColumn("kind", F.lit("Exact"))
    by_key = version_groups(rated).select(F.col("version_key").alias("content_id"))
    several = rated.filter(full.isNotNull()).groupBy("full_hash").count().filter("count > 1").select(F.concat(F.lit("hash:"), full.cast("string")).alias("content_id"))
    versions = rated.filter(version.isNotNull()).withColumn("content_id", version).withColumn("kind", F.lit("Version"))
    return exact.join(several, "content_id", "left_semi").unionByName(versions.join(by_key, "content_id", "left_semi"))


def kept(grouped: DataFrame, strategies: list[str] = STRATEGIES) -> DataFrame:
    """(content_id, kind, strategy, n, keep_id, keep_path, drops): the item each strategy keeps of each group, if any.  Combined maxima."""
    best = grouped.groupBy("content_id", "kind").agg(F.count("*").alias("n"), *[F.max(F.when(keep_order(s).isNotNull(), F.struct(keep_order(s).alias("o"), F.col("id"), F.col("path")))).alias(s) for s in strategies])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s)["id"].alias("keep_id"), F.col(s)["path"].alias("keep_path")) for s in strategies]))
    return best.select("content_id", "kind", "n", rows.alias("r")).select("content_id", "kind", "r.strategy", "n", "r.keep_id", "r.keep_path", (F.col("n") - F.col("r.keep_id").isNotNull().cast("int")).alias("drops"))


def removals(grouped: DataFrame, choice: DataFrame) -> DataFrame:
    """(content_id, kind, id, keep_id, keep_name): every item that a strategy drops, with the one kept in its place."""
    winner = choice.filter("keep_id is not null").select("content_id", "kind", "keep_id", F.regexp_extract("keep_path", "([^/]*)$", 1).alias("keep_name"))
    return grouped.select("content_id", "kind", "id").join(winner, ["content_id", "kind"]).filter("id <> keep_id")


def ranked(rows: DataFrame, group: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first rows of each group in an order, with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= most)
