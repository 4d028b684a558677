"""Duplicates hidden by formatting: Merkle-style digests of records with unordered fields.

A record is a tree: an object is an unordered node whose children are its fields, each an ordered pair of name and value; a list is an
ordered node.  Leaves are normalised (case folded, everything but letters and digits dropped), a node's digest is made of
its children's, sorted where the node is unordered, from the leaves up to the root.  Records
are grouped by root digest; the full normalised structure then confirms each group, so records whose
digests collide are still told apart.

Flat records never leave the JVM.  Lines of JSON with objects or lists inside are read as streams of events, in Arrow batches,
at any depth.

Grouping by digest aggregates before it shuffles: a record that holds a third of all rows comes to the
shuffle as one row for each input partition.  Copies find their first line by a join on the digest; the
digests with very many copies are few (HOT_GROUPS at most), and are joined by broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.nested import events
from corvane.session import cut

#: Digests that are joined by broadcast, at most (under a megabyte).
HOT_GROUPS = 10_000
FIELD = "array<struct<name:string,value:string>>"


def leaf(text: Column) -> Column:
    """Normal form of a name or value: letters and digits in lower case; null counts as empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def parse_line(line: Column) -> Column:
    """The fields of a line, as written: `name=value` parted by `;`, `name: value` parted by `|`, or a JSON object.

    A part without a separator is a field with an empty value; empty parts are none.  A line in braces that is not
    a JSON object is read as one of the other layouts.  Null and blank lines have no fields.
    """
    as_map = F.from_json(line, T.MapType(T.StringType(), T.StringType()))
    from_map = F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    first_equals, first_colon = F.instr(line, "="), F.instr(line, ":")
    by_colon = F.when(F.contains(line, F.lit("|")), True).when(F.contains(line, F.lit(";")), False).otherwise((first_equals == 0) | (first_colon > 0) & (first_colon < first_equals))
    parts = F.when(by_colon, F.split(line, "\\|")).otherwise(F.split(line, ";"))
    mark = F.when(by_colon, F.lit(":")).otherwise(F.lit("="))

    def pair(part: Column) -> Column:
        at = F.position(mark, part)
        return F.struct(F.when(at > 0, F.substring(part, F.lit(1), at - 1)).otherwise(part).alias("name"), F.when(at > 0, F.substring(part, at + 1, F.length(part))).otherwise(F.lit("")).alias("value"))

    from_text = F.filter(F.transform(parts, pair), lambda e: (F.trim(e["name"]) != "") | (F.trim(e["value"]) != ""))
    return F.when(line.isNull() | (F.trim(line) == ""), F.array().cast(FIELD)).when(F.trim(line).startswith("{") & as_map.isNotNull(), from_map.cast(FIELD)).otherwise(from_text.cast(FIELD))


_DROPPED = re.compile(r"[\W_]+")


def _leaf(text: str | None) -> str:
    return "".join(c for c in _DROPPED.sub("", text or "").lower() if c.isalpha() or c.isdecimal() or c.isnumeric())


def _node(kind: str, children: list[str]) -> str:
    """The structure of a node: an object's children are distinct and in the order of their digests, a list's as they stand."""
    if kind == "{":
        children = sorted(set(children), key=lambda x: hashlib.md5(x.encode("utf-8", "surrogatepass")).digest())
    return ("\x02" if kind == "{" else "\x04") + "\x1e".join(children) + "\x03"


def nested_structure(line: str | None) -> list[str] | None:
    """The fields of a JSON object with objects or lists inside, each as name, a mark and its structure; None for any other line."""
    read = events(line) if line is not None else None
    if read is None or read[0][0] != "{" or not any(k in "{[" for k in read[0][1:]):
        return None
    stack: list[tuple[str, str, list[str]]] = []  # kind, name before it, children
    name, fields = "", []
    for kind, value in zip(*read, strict=True):
        if kind == "k":
            name = _leaf(value) + "\x1f"
        elif kind in "{[":
            stack.append((kind, name, []))
            name = ""
        else:
            if kind in "}]":
                opened, name, children = stack.pop()
                if not stack:
                    fields = children
                    break
                made = _node(opened, children)
            else:
                made = _leaf(value)
            stack[-1][2].append(name + made)
            name = ""
    return fields


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nested_batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for lines in parts:
        yield lines.map(nested_structure, na_action="ignore")


def canonical(fields: Column) -> Column:
    """The normalised structure in one order: sorted `name<1f>value` leaves, equal fields once."""
    return F.array_sort(F.array_distinct(F.transform(fields, lambda e: F.concat(leaf(e["name"]), F.lit("\x1f"), leaf(e["value"])))))


def root_digest(structure: Column) -> Column:
    """The digest of the sorted child digests (SHA-256 of the fields' MD5s)."""
    return F.sha2(F.concat_ws("", F.array_sort(F.transform(structure, lambda x: F.md5(x.cast("binary"))))), 256)


def digests(df: DataFrame, key: str, line: str) -> DataFrame:
    """(key, root, structure) of every row."""
    text = F.col(f"`{line}`")
    deep = F.when(text.rlike(r"^\s*\{(?s:.)*[\[{]"), text)
    inner = df.select(F.col(f"`{key}`").alias("key"), text.alias("line"), _nested_batches(deep).alias("deep"))
    structure = inner.select("key", F.coalesce(F.array_sort(F.array_distinct("deep")), canonical(parse_line(F.col("line")))).alias("structure"))
    return structure.select("key", F.unhex(F.substring(root_digest(F.col("structure")), 1, 32)).alias("root"), F.array_join("structure", "\x1e").alias("structure"))


def collapse(df: DataFrame, key: str, line: str) -> DataFrame:
    """One row per distinct record: first (its smallest key), copies (its number of distinct keys).

    Repeated equal fields of an object count once; lists keep their order and repeats; a missing value is empty.
    Lines without any field form one record, and rows with a null key are no record.  Rows that were delivered
    twice under one key count once.  An empty table gives an empty one.
    """
    rows = digests(df, key, line).filter("key is not null")
    return rows.distinct().groupBy("root", "structure").agg(F.min("key").alias("first"), F.count("*").alias("copies")).select("first", "copies")


def copies(df: DataFrame, key: str, line: str, hot_rows: int = 100_000) -> DataFrame:
    """(first, copy) for every row that is a copy of one with a smaller key.

    hot_rows: from so many rows on, and from a HOT_GROUPS-th of all, a digest's group is joined by broadcast.  Groups below that are left to
    the splitting of skewed partitions.  Lines are parsed once; their digests and structures are checkpointed, as the groups and the joins read them.
    """
    rows = cut(digests(df, key, line).filter("key is not null"))
    hot_rows = max(hot_rows, -(-rows.count() // HOT_GROUPS))
    groups = rows.groupBy("root").agg(F.min("key").alias("first"), F.count("*").alias("n"), F.min("structure").alias("low"), F.max("structure").alias("high")).filter("n > 1")
    sure = groups.filter("low = high").select("root", "first", "n")
    plain = rows.select("key", "root").join(sure.filter(F.col("n") < hot_rows).drop("n"), "root")
    hot = rows.select("key", "root").join(F.broadcast(sure.filter(F.col("n") >= hot_rows).drop("n")), "root")
    told_apart = rows.join(groups.filter("low <> high").select("root"), "root", "left_semi")
    apart = told_apart.groupBy("root", "structure").agg(F.min("key").alias("first")).join(told_apart, ["root", "structure"])
    every = plain.select("first", "key").unionByName(hot.select("first", "key")).unionByName(apart.select("first", "key"))
    return every.filter("key > first").select("first", F.col("key").alias("copy")).distinct()
