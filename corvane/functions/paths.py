"""Columns over `/`-separated paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used; keeps long expressions out of generated code."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a name that begins with its only dot is its own stem."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def raw_extension(path: Column) -> Column:
    """The last extension as it is written, empty if there is none."""
    return F.regexp_extract(file_name(path), r"(?<=.)\.([^.]*)$", 1)


def extension(path: Column) -> Column:
    """The last extension in lower case, empty if there is none."""
    return F.lower(raw_extension(path))


def parent(path: Column) -> Column:
    """The folder of a path; of a file below the root it is empty."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(path: Column, most: int) -> Column:
    """The names of the folders above a path, the nearest first."""
    names = F.filter(F.split(parent(path), "/"), lambda x: x != "")
    return F.slice(F.reverse(names), 1, most)


def ancestor_paths(path: Column) -> Column:
    """The paths of all folders above a path, the nearest first."""
    parts = F.split(parent(path), "/")
    upto = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.array_join(F.slice(parts, 1, F.size(parts) - i), "/"))
    return F.when(F.size(parts) > 1, upto).otherwise(F.array().cast("array<string>"))


def beginnings(name: Column) -> Column:
    """The parts of a name that another file's stem may be: all of it, and what stands before a dot or a dash."""
    parts = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.array_join(F.slice(p, 1, k), ""))
    return F.when(name != "", let(F.split(name, "(?=[.-])"), parts)).otherwise(F.array().cast("array<string>"))
