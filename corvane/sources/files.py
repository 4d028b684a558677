"""Listings of files: scanning, selection of media files, and metadata files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.paths import extension, stem

# What a scan leaves out, and the kinds by extension.
MIN_BYTES, MAX_DEPTH = 1_048_576, 10
SKIPPED_FOLDERS = [".git", ".DS_Store", "Thumbs.db", "__MACOSX", "Library", ".Trash", ".cache", ".npm", ".cargo", ".rustup", "node_modules", "BDMV", "CERTIFICATE", "STREAM", "PLAYLIST", "CLIPINF", "AUXDATA", "BACKUP", "META"]
SKIPPED_PARTS = ["/BDMV/", "/CERTIFICATE/", "/SAMPLE/", "/sample/", "/Trailer/", "/trailers/"]
TRANSPORT = ["m2ts", "mts", "ts"]
KINDS = {
    "Movie": ["mp4", "mkv", "avi", "ts", "m2ts", "mts", "mov", "wmv", "flv", "webm"],
    "Music": ["mp3", "flac", "ape", "aac", "ogg", "wma", "wav", "m4a", "dsf"],
    "Novel": ["epub", "pdf", "mobi", "azw3", "txt", "cbz"],
    "Strm": ["strm"],
}


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, mtime) of the files below a folder; contents are not read.  On any file system; names that begin with a dot or an underscore are left out by Spark, walk() has them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", F.col("modificationTime").alias("mtime"))


def walk(spark: SparkSession, root: str, max_depth: int = MAX_DEPTH, follow_links: bool = False) -> DataFrame:
    """(path, length, mtime) of all files below a folder, hidden ones too.

    The folders of each level are listed by tasks, so a wide tree is spread over the executors; the file system must be mounted on
    all of them.  follow_links: links to files and folders are taken for what they lead to (down to max_depth, so a loop ends); else they
    are left out.  Folders that can't be read are empty.
    """
    import os
    from collections.abc import Iterator
    from datetime import datetime, timezone

    import pandas as pd

    from corvane.session import cut

    schema = "path string, is_dir boolean, length bigint, mtime timestamp"

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for folder in batch["path"]:
                try:
                    found = sorted(os.scandir(folder), key=lambda e: e.name)
                except OSError:
                    continue
                for e in found:
                    try:
                        if e.is_symlink() and not follow_links:
                            continue
                        told = e.stat()
                    except OSError:
                        continue
                    rows.append((e.path, e.is_dir(), told.st_size, datetime.fromtimestamp(told.st_mtime, timezone.utc)))
            yield pd.DataFrame(rows, columns=["path", "is_dir", "length", "mtime"])

    level, out = spark.createDataFrame([(root,)], "path string"), []
    for _ in range(max_depth + 1):
        found = cut(level.repartition(max(1, min(level.count(), spark.sparkContext.defaultParallelism * 4))).mapInPandas(entries, schema))
        out.append(found.filter("not is_dir").drop("is_dir"))
        level = found.filter("is_dir").select("path")
        if not level.limit(1).count():
            break
    return reduce(DataFrame.unionByName, out)


def kind_of(ext: Column) -> Column:
    return reduce(lambda w, k: w.when(ext.isin(KINDS[k]), k), list(KINDS)[1:], F.when(ext.isin(KINDS["Movie"]), "Movie"))


def select_media(files: DataFrame, min_bytes: int = MIN_BYTES, max_depth: int = MAX_DEPTH, skipped: list[str] = SKIPPED_PARTS) -> DataFrame:
    """Files (path, length) that a scan takes up, with their extension and kind.

    Left out are small and deep files, those below certain folders or with certain parts in their path, numbered transport
    streams, and unknown kinds.
    """
    path, ext = F.col("path"), extension(F.col("path"))
    folders = F.split(path, "/")
    held = files.filter((F.col("length") >= min_bytes) & (F.size(folders) - 1 <= max_depth))
    held = held.filter(~F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*[F.lit(x) for x in SKIPPED_FOLDERS])))
    held = held.filter(~reduce(lambda a, b: a | b, [F.contains(path, F.lit(k)) for k in skipped]) if skipped else F.lit(True))
    held = held.filter(~(ext.isin(TRANSPORT) & stem(path).rlike("^[0-9]+$")))
    return held.withColumns({"ext": ext, "kind": kind_of(ext)}).filter("kind is not null")


def prefix_digests(files: DataFrame, prefix: int = 65536) -> DataFrame:
    """(path, digest): the MD5 of the first bytes of each file, read by seeking, so the file system must be mounted on every executor; null for files that can't be read."""
    import hashlib
    from collections.abc import Iterator

    import pandas as pd

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    with open(path, "rb") as f:
                        out.append(hashlib.md5(f.read(prefix)).hexdigest())
                except OSError:
                    out.append(None)
            yield pd.DataFrame({"path": batch["path"], "digest": out})

    return files.select("path").mapInPandas(read, "path string, digest string")


def sidecar_fields(text: Column) -> dict[str, Column]:
    """Title, year and length of the plot of a metadata file that need not be well-formed."""
    tag = lambda name, body=r"([^<]*)": F.regexp_extract(text, f"(?s)<{name}>{body}</{name}>", 1)
    return {
        "title": F.nullif(F.trim(tag("title")), F.lit("")),
        "year": F.nullif(F.regexp_extract(text, r"<year>\s*([0-9]{4})", 1), F.lit("")).try_cast("int"),
        "plot_chars": F.length(tag("plot", "(.*?)")).cast("bigint"),
    }


# The text tags of a metadata file, and their names here.
SIDECAR_TAGS = {"title": "title", "showtitle": "show_title", "episodename": "episode_name", "originaltitle": "title_original", "year": "year", "plot": "overview", "rating": "rating", "season": "season_number", "episode": "episode_number", "thumb": "poster_url", "fanart": "fanart_url", "artist": "artist", "album": "album", "author": "author"}


def _tag_pattern(tag: str) -> str:
    return rf"(?s)<{tag}((?:[ \t\n\r][^>]*)?)>(.*?)</{tag}>"


def first_tag(text: Column, tag: str) -> Column:
    """The first value of a tag that isn't blank, trimmed; null without any."""
    values = F.transform(F.regexp_extract_all(text, F.lit(_tag_pattern(tag)), F.lit(2)), lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))
    return F.get(F.filter(values, lambda v: v != ""), F.lit(0))


def sidecar_record(text: Column) -> Column:
    """A struct of all that a metadata file says, null if it gives no title.

    The text need not be well-formed.  An episode's file gives the show's title as title, and its own as episode_name.
    Ids: the first of each type that can be read; ids of other types, or of a type that is there already, count as `tmdb` if that is missing.
    """
    tag = {name: first_tag(text, t) for t, name in SIDECAR_TAGS.items()}
    episode = F.contains(text, F.lit("<episodedetails"))
    fan = F.coalesce(first_tag(tag["fanart_url"], "thumb"), tag["fanart_url"])
    blocks = F.arrays_zip(F.regexp_extract_all(text, F.lit(_tag_pattern("uniqueid")), F.lit(1)).alias("head"), F.regexp_extract_all(text, F.lit(_tag_pattern("uniqueid")), F.lit(2)).alias("value"))
    none = F.struct(F.lit(None).cast("bigint").alias("tmdb"), F.lit(None).cast("string").alias("music"), F.lit(None).cast("string").alias("book"))

    def fold(ids: Column, block: Column) -> Column:
        kind, value = F.lower(F.regexp_extract(block["head"], r'type="([^"]*)"', 1)), F.regexp_replace(block["value"], r"^\s+|\s+$", "")
        music, book = (kind == "musicbrainz") & ids["music"].isNull(), (kind == "openlibrary") & ids["book"].isNull()
        number = F.when(value.rlike(r"^\+?[0-9]+$"), value.try_cast("bigint"))
        return F.when(value == "", ids).otherwise(F.struct(F.when(~music & ~book, F.coalesce(ids["tmdb"], number)).otherwise(ids["tmdb"]).alias("tmdb"), F.when(music, value).otherwise(ids["music"]).alias("music"), F.when(book, value).otherwise(ids["book"]).alias("book")))

    ids = F.aggregate(blocks, none, fold)
    title = F.when(episode, F.coalesce(tag["show_title"], tag["title"])).otherwise(tag["title"])
    made = F.struct(
        F.lit("LocalNfo").alias("source"), title.alias("title"), F.when(episode, F.coalesce(tag["episode_name"], tag["title"])).alias("episode_name"), tag["title_original"].alias("title_original"),
        *[F.when(tag[n].rlike(r"^\+?[0-9]+$"), tag[n].try_cast("int")).alias(n) for n in ("year", "season_number", "episode_number")], tag["rating"].try_cast("double").alias("rating"),
        *[tag[n].alias(n) for n in ("overview", "poster_url", "artist", "album", "author")], fan.alias("fanart_url"),
        ids["tmdb"].alias("tmdb_id"), ids["music"].alias("musicbrainz_id"), ids["book"].alias("openlibrary_id"), F.lit(0.98).cast("float").alias("confidence"),
    )
    return F.when(title.isNotNull(), made)
