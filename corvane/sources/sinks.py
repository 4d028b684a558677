"""Outputs: JSON envelopes, operation logs, and plans carried out on a file system."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.titles import shortened


def envelope(df: DataFrame, kind: str) -> DataFrame:
    """One JSON text per row: schema_version, kind and data, null fields kept."""
    data = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.to_json(F.struct(F.lit("1").alias("schema_version"), F.lit(kind).alias("kind"), data.alias("data")), {"ignoreNullFields": "false"}).alias("value"))


# The kinds of reports by command.
REPORTS = {"scan": "pipeline_report", "scrape": "pipeline_report", "analyze": "analysis_report", "rename": "execution_report", "dedup": "execution_report", "organize": "execution_report"}


def report(spark: SparkSession, command: str, summary: DataFrame, entries: DataFrame, **more: object) -> DataFrame:
    """One JSON text: the report of a command, with its summary (one row) and its entries in the order of their first column.

    All entries go into one text, so this is for the results that a person reads; use envelope() for one text per row.
    """
    listed = entries.agg(F.array_sort(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in entries.columns]))).alias("entries"))
    one = F.lit(1).alias("one")
    row = summary.select(F.struct("*").alias("summary"), one).join(listed.select("entries", one), "one")  # one row each
    head = [F.lit("1").alias("schema_version"), F.lit(REPORTS[command]).alias("kind"), F.lit(command).alias("command")]
    return row.select(F.to_json(F.struct(*head, "summary", "entries", *[F.lit(v).alias(k) for k, v in more.items()]), {"ignoreNullFields": "false"}).alias("value"))


def text_table(df: DataFrame, rows: int = 20, width: int = 40) -> str:
    """The first rows as text in columns, long values cut with an ellipsis, numbers to the right; the last line says if there are more."""
    cells = [F.when(F.col(f"`{c}`").isNull(), "-").otherwise(shortened(F.col(f"`{c}`").cast("string"), width)) for c in df.columns]
    found = [[str(x) for x in r] for r in df.select(*cells).limit(rows + 1).collect()]
    shown, numbers = found[:rows], {i for i, (_, t) in enumerate(df.dtypes) if t in ("tinyint", "smallint", "int", "bigint", "float", "double")}
    wide = [max(map(len, column)) for column in zip(df.columns, *shown, strict=True)]
    line = lambda row: "  ".join(x.rjust(w) if i in numbers else x.ljust(w) for i, (x, w) in enumerate(zip(row, wide, strict=True))).rstrip()
    return "\n".join([line(df.columns), "  ".join("-" * w for w in wide), *map(line, shown), *(["…"] if len(found) > rows else [])])


def write_log(df: DataFrame, folder: str) -> None:
    """Appends rows to a log of operations, each with the time of the write."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(folder)


OUTCOMES = ("executed", "blocked", "guarded", "skipped", "errors")


def carry_out(plans: DataFrame, dry_run: bool = True) -> dict[str, int]:
    """Moves or links files as a plan (old_path, new_path, action) says, one by one as they arrive, and counts the outcomes.

    With dry_run, nothing is touched.  A file that is missing, or whose target exists, is an error and stays.
    """
    counts = {"planned": 0, "done": 0, "errors": 0}
    for row in plans.select("old_path", "new_path", "action").toLocalIterator():
        counts["planned"] += 1
        if not dry_run:
            counts["done" if _moved(row.old_path, row.new_path, row.action) else "errors"] += 1
    return counts


def _moved(old_path: str, new_path: str, action: str = "Move") -> bool:
    old, new = Path(old_path), Path(new_path)
    if not old.exists() or new.exists():
        return False
    try:
        new.parent.mkdir(parents=True, exist_ok=True)
        if action == "HardLink":
            os.link(old, new)
        elif action == "SymLink":
            new.symlink_to(old)
        else:
            shutil.move(old, new)
    except OSError:
        return False
    return True


def rename(plans: DataFrame, dry_run: bool = True) -> dict[str, int]:
    """Renames files, then their subtitles, then their folders, the deepest first, and counts the outcomes.

    plans: old_path, new_path, subtitles and folders (arrays of old_path and new_path), conflicts (array).  Plans with conflicts are
    blocked as a whole.  A plan whose paths are equal only renames folders.  With dry_run all others count as executed.
    """
    counts = dict.fromkeys(OUTCOMES, 0)
    folders: dict[str, str] = {}
    for row in plans.select("old_path", "new_path", "subtitles", "folders", "conflicts").toLocalIterator():
        if row.conflicts:
            counts["blocked"] += 1
            continue
        moves = ([(row.old_path, row.new_path)] if row.old_path != row.new_path else []) + [(s.old_path, s.new_path) for s in row.subtitles or []]
        for old, new in moves:
            counts["executed" if dry_run or _moved(old, new) else "errors"] += 1
        folders |= {f.old_path: f.new_path for f in row.folders or []}
    for old in sorted(folders, key=lambda p: (-p.count("/"), p)):
        counts["executed" if dry_run or _moved(old, folders[old]) else "errors"] += 1
    return counts


def remove_duplicates(groups: DataFrame, action: str = "Trash", target: str = "", dry_run: bool = True) -> dict[str, int]:
    """Puts away the files of groups (path, is_keep, guarded) that aren't kept, and counts the outcomes.

    action: `Trash` and `Move` move them into the target folder, `Report` only counts.  Files of guarded groups stay, unless only a report is
    asked for.  Without a target they are skipped.
    """
    counts = dict.fromkeys(OUTCOMES, 0)
    for row in groups.filter("not is_keep").select("path", "guarded").toLocalIterator():
        if row.guarded and action != "Report":
            counts["guarded"] += 1
        elif dry_run or action == "Report":
            counts["executed"] += 1
        elif not target:
            counts["skipped"] += 1
        else:
            counts["executed" if _moved(row.path, str(Path(target, Path(row.path).name))) else "errors"] += 1
    return counts


def remove_empty_folders(plans: DataFrame) -> int:
    """Removes the folders that moved files (old_path) left empty, the last in order first, and counts them."""
    gone = 0
    folders = plans.select(F.regexp_replace("old_path", r"/?[^/]*$", "").alias("dir")).distinct().orderBy(F.desc("dir"))
    for row in folders.toLocalIterator():
        try:
            os.rmdir(row.dir)
            gone += 1
        except OSError:
            continue
    return gone
