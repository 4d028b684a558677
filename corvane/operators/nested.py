"""Shredding of deeply nested records into related flat tables.

Every record is read as a stream of (path, value, ordinals) triples.  The ordinals of a triple
are the places of the array elements that enclose its leaf, outermost first.  Triples with the
same repeated ancestor (the array path they stand below, or the record itself) belong to one
table; those with equal ordinals in it are one row.  A record is parsed by one task from start to
end, so the triples of a row stand together as they are read and are grouped without a shuffle:
the pieces are (owner, grp, ords, leaves), `leaves` being the path-value pairs of one row.
`pivot` turns the pieces of one group into a flat table.

Two parsers make pieces: `struct_pieces` walks typed struct columns by their schema, with
expressions only; `json_pieces` reads JSON text of unknown shape as a stream of events, in Arrow batches.  No tree is
built and nothing recurses with the depth of a record.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from json.decoder import scanstring

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import cut

PIECE = "array<struct<path:string,value:string>>"


# -- typed columns -------------------------------------------------------------------------------


def leaf_paths(kind: T.DataType, path: str = "") -> list[tuple[str, T.DataType]]:
    """The leaves of a struct that stand below no array, as (dotted path, type)."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in leaf_paths(f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return []
    return [(path, kind)]


def array_paths(kind: T.DataType, path: str = "") -> list[tuple[str, T.DataType]]:
    """The outermost arrays in a struct, as (dotted path, element type)."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in array_paths(f.dataType, f"{path}.{f.name}" if path else f.name)]
    return [(path, kind.elementType)] if isinstance(kind, T.ArrayType) else []


def groups_of(schema: T.StructType, columns: list[str]) -> dict[str, list[tuple[str, T.DataType]]]:
    """The tables that come of the columns: the path of the repeated ancestor, and its leaves.

    A leaf's path is relative to the ancestor; the element of an array of plain values has the path `value`.
    """
    out: dict[str, list[tuple[str, T.DataType]]] = {}

    def below(group: str, kind: T.DataType) -> None:
        out[group] = leaf_paths(kind) if isinstance(kind, T.StructType) else [] if isinstance(kind, (T.ArrayType, T.MapType)) else [("value", kind)]
        if isinstance(kind, T.ArrayType):
            below(f"{group}.value", kind.elementType)
        for path, element in array_paths(kind) if isinstance(kind, T.StructType) else []:
            below(f"{group}.{path}", element)

    for name in columns:
        kind = schema[name].dataType
        below(name, kind.elementType if isinstance(kind, T.ArrayType) else kind)
    return out


def _field(value: Column, path: str) -> Column:
    for name in path.split("."):
        value = value.getField(name)
    return value


def _leaves(value: Column, kind: T.DataType) -> Column:
    """The path-value pairs of one row; leaves that are null are no triples."""
    pairs = [(p, _field(value, p)) for p, _ in leaf_paths(kind)] if isinstance(kind, T.StructType) else [] if isinstance(kind, (T.ArrayType, T.MapType)) else [("value", value)]
    made = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(p).alias("path"), v.cast("string").alias("value"))) for p, v in pairs]) if pairs else F.array().cast(PIECE)
    return F.array_compact(made) if pairs else made


def _walk(group: str, value: Column, kind: T.DataType, ords: Column) -> list[Column]:
    """Expressions for the arrays of pieces at and below a value."""
    own = F.when(value.isNotNull(), F.array(F.struct(F.lit(group).alias("grp"), ords.alias("ords"), _leaves(value, kind).alias("leaves"))))
    inner = [(f"{group}.value", value, kind.elementType)] if isinstance(kind, T.ArrayType) else [(f"{group}.{p}", _field(value, p), e) for p, e in (array_paths(kind) if isinstance(kind, T.StructType) else [])]
    return [own, *(_repeat(g, array, element, ords) for g, array, element in inner)]


def _repeat(group: str, array: Column, element: T.DataType, ords: Column) -> Column:
    def one(x: Column, i: Column) -> Column:
        parts = _walk(group, x, element, F.concat(ords, F.array(i)))
        return parts[0] if len(parts) == 1 else F.flatten(F.array_compact(F.array(*parts)))

    return F.flatten(F.array_compact(F.transform(array, one)))


def struct_pieces(df: DataFrame, owner: str, columns: list[str]) -> DataFrame:
    """Pieces (owner, grp, ords, leaves) of typed columns: structs, arrays of them, or plain arrays.

    A null struct or element is no piece; a null or empty array has none below it; null elements keep
    their place.  A struct all of whose leaves are null is still a piece.  Records without an owner
    (null) keep their pieces.  All columns are parsed in one scan and no rows are shuffled.
    """
    none = F.array().cast("array<int>")
    parts: list[Column] = []
    for name in columns:
        kind = df.schema[name].dataType
        parts += [_repeat(name, F.col(f"`{name}`"), kind.elementType, none)] if isinstance(kind, T.ArrayType) else _walk(name, F.col(f"`{name}`"), kind, none)
    all_pieces = F.flatten(F.array_compact(F.array(*parts)))
    return df.select(F.col(f"`{owner}`").alias("owner"), F.explode(all_pieces).alias("p")).select("owner", "p.grp", "p.ords", "p.leaves")


# -- JSON text -----------------------------------------------------------------------------------


_SPACE = re.compile(r"[ \t\n\r]*").match
_PLAIN = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity").match


def events(text: str, unwrap: bool = False) -> tuple[list[str], list] | None:
    """The events of a JSON text in order, as kinds and values; None if it isn't complete JSON.

    Kinds: `{` `}` `[` `]`, `k` for a key, `v` for a value (text as it reads, numbers as they are written, None for null).  unwrap:
    text that is itself a JSON object or array has the kind `t`, with the text and the place of the event behind its own events, which follow.
    """
    kinds: list[str] = []
    values: list = []
    open_: list[str] = []
    i, n, want_key = _SPACE(text, 0).end(), len(text), False
    while True:
        if want_key:
            if text[i : i + 1] != '"':
                return None
            try:
                key, i = scanstring(text, i + 1, True)
            except ValueError:
                return None
            i = _SPACE(text, i).end()
            if text[i : i + 1] != ":":
                return None
            kinds.append("k")
            values.append(key)
            i = _SPACE(text, i + 1).end()
            want_key = False
        c = text[i : i + 1]
        if c == "{" or c == "[":
            kinds.append(c)
            values.append(None)
            open_.append(c)
            i = _SPACE(text, i + 1).end()
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                want_key = c == "{"
                continue
        elif c == '"':
            try:
                value, i = scanstring(text, i + 1, True)
            except ValueError:
                return None
            inner = events(value, True) if unwrap and value.lstrip()[:1] in ("{", "[") and value else None
            if inner is None:
                kinds.append("v")
                values.append(value)
            else:
                at = len(kinds) + 1
                kinds.append("t")
                values.append((value, at + len(inner[0])))
                kinds += inner[0]
                values += [(v[0], v[1] + at) if k == "t" else v for k, v in zip(*inner, strict=True)]
        else:
            m = _PLAIN(text, i)
            if m is None:
                return None
            kinds.append("v")
            values.append(None if m[0] == "null" else m[0])
            i = m.end()
        while True:
            i = _SPACE(text, i).end()
            c = text[i : i + 1]
            if not open_:
                return (kinds, values) if i == n else None
            if c == ",":
                want_key = open_[-1] == "{"
                i = _SPACE(text, i + 1).end()
                break
            if c != ("}" if open_[-1] == "{" else "]"):
                return None
            open_.pop()
            kinds.append(c)
            values.append(None)
            i += 1


def _anchored(kinds: list[str], values: list, anchor: str) -> int:
    """The place of the object that has the anchor as a key: the outermost, of equal ones the first; 0 without any."""
    best, found, open_ = None, 0, []
    for i, kind in enumerate(kinds):
        if kind in "{[":
            open_.append(i)
        elif kind in "}]":
            open_.pop()
        elif kind == "k" and (best is None or len(open_) < best) and values[i].lower() == anchor:
            best, found = len(open_), open_[-1]
    return found


def parse_json(text: str | None, anchor: str | None = None, lone: frozenset[str] = frozenset()) -> list[tuple[str, list[int], list[tuple[str, str]]]]:
    """The pieces (grp, ords, leaves) of one JSON text in document order; none if it isn't complete JSON.

    The events are read once: every leaf becomes a triple of its group and ordinals, path and value, and triples of one row stand together.
    """
    read = None if text is None else events(text, anchor is not None or bool(lone))
    if read is None:
        return []
    kinds, values = read
    rows: dict[tuple[str, tuple[int, ...]], list[tuple[str, str]]] = {}
    stack: list[list] = []  # [is an object, group, path or next place, ordinals, key]
    i, end = (_anchored(kinds, values, anchor) if anchor is not None else 0), len(kinds)
    while i < end:
        kind, value = kinds[i], values[i]
        i += 1
        if kind == "k":
            stack[-1][4] = value.lower()
            continue
        if kind in "}]":
            stack.pop()
            if not stack:
                break
            continue
        if not stack:
            if kind == "{":
                rows[("", ())] = []
                stack.append([True, "", "", (), ""])
            elif kind == "[":
                stack.append([False, "", 0, (), ""])
            continue
        is_object, group, at, ords, key = stack[-1]
        if is_object:
            path = f"{at}.{key}" if at else key
            full = f"{group}.{path}" if group else path
            if kind == "t":
                if full in lone:
                    continue  # its own events stand for it
                value, i = value
            if kind == "[":
                stack.append([False, full, 0, ords, ""])
            elif kind == "{":
                if full in lone:
                    rows.setdefault((full, (*ords, 0)), [])
                    stack.append([True, full, "", (*ords, 0), ""])
                else:
                    stack.append([True, group, path, ords, ""])
            elif value is not None:
                rows.setdefault((group, ords), []).append((path, value))
            continue
        stack[-1][2] = at + 1
        if kind == "t":
            value, i = value
        elif kind == "v" and value is None:
            continue
        place = (*ords, at)
        row = rows.setdefault((group, place), [])
        if kind == "{":
            stack.append([True, group, "", place, ""])
        elif kind == "[":
            stack.append([False, group, 0, place, ""])
        else:
            row.append(("value", value))
    return [(group, list(ords), leaves) for (group, ords), leaves in rows.items()]


def json_pieces(df: DataFrame, owner: str, text: str, anchor: str | None = None, lone: tuple[str, ...] = ()) -> DataFrame:
    """Pieces (owner, grp, ords, leaves) of a column of JSON text of any shape.

    anchor: the key (lower case) of the object that counts as the record; objects, lists and JSON texts
    wrapped around it are taken off, however deep.  Keys that differ in case only, or are repeated, all have their
    leaves; a table shows the first.  lone: paths where a single object stands for an array of one, and
    where the array may be given as JSON text.  Keys are folded to lower case.  Text that is null, empty or
    not complete JSON has no pieces.  Works in Arrow batches, without a shuffle.
    """
    import pyarrow as pa

    key = df.schema[owner].dataType
    schema = T.StructType([T.StructField("owner", key), T.StructField("grp", T.StringType()), T.StructField("ords", T.ArrayType(T.IntegerType())), T.StructField("leaves", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])))])
    marks = frozenset(lone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = pa.struct([("path", pa.string()), ("value", pa.string())])
        for batch in batches:
            at: list[int] = []
            grps: list[str] = []
            ords: list[list[int]] = []
            ends, paths, values = [0], [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                for grp, places, leaves in parse_json(x, anchor, marks):
                    at.append(i)
                    grps.append(grp)
                    ords.append(places)
                    paths += [p for p, _ in leaves]
                    values += [v for _, v in leaves]
                    ends.append(len(paths))
            leaf = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.string())], fields=list(inner))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(grps, pa.string()), pa.array(ords, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), leaf)], names=["owner", "grp", "ords", "leaves"])

    return df.select(F.col(f"`{owner}`").alias("owner"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


# -- tables --------------------------------------------------------------------------------------


def pivot(pieces: DataFrame, group: str, leaves: list[tuple[str, T.DataType]], name: Callable[[str], str] = lambda p: p.replace(".", "_")) -> DataFrame:
    """One flat table: owner, parent_pos (places of the enclosing elements but the last), pos, and a column for each leaf.

    pos is 0 for a group that doesn't repeat.  A value that doesn't fit its column's type is null.  Leaves
    called owner, parent_pos or pos get the prefix `leaf_`.
    """
    last = F.coalesce(F.try_element_at("ords", F.lit(-1)), F.lit(0)).cast("bigint")
    names = F.transform("leaves", lambda y: y["path"])
    once = F.filter("leaves", lambda x, i: F.array_position(names, x["path"]) == i + 1)
    first = F.when(F.size(F.array_distinct(names)) == F.size("leaves"), F.col("leaves")).otherwise(once)
    found = F.map_from_entries(F.transform(first, lambda x: F.struct(x["path"], x["value"])))
    rows = pieces.filter(F.col("grp") == group).select("owner", F.slice("ords", 1, F.greatest(F.size("ords") - 1, F.lit(0))).alias("parent_pos"), last.alias("pos"), found.alias("__found"))
    taken = {"owner", "parent_pos", "pos"}
    out = []
    for path, kind in leaves:
        alias = name(path)
        while alias in taken:
            alias = f"leaf_{alias}"
        taken.add(alias)
        out.append(F.col("__found").getItem(path).try_cast(kind).alias(alias))
    return rows.select("owner", "parent_pos", "pos", *out)


def shred(df: DataFrame, owner: str, columns: list[str], stored: bool = False) -> dict[str, DataFrame]:
    """Flat tables for the struct and array columns, by the path of their repeated ancestor.

    stored: the pieces are checkpointed first, so all tables come of one scan.

    Each has owner (the record), parent_pos and pos beside its leaves, so children join their parents on
    owner and ords.  Repeated deliveries of a record are kept; drop them with distinct() on what you need.
    An empty input gives empty tables with the same columns.
    """
    pieces = struct_pieces(df, owner, columns)
    pieces = cut(pieces) if stored else pieces
    return {group: pivot(pieces, group, leaves) for group, leaves in groups_of(df.schema, columns).items()}
