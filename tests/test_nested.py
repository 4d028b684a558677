import json

from corvane.operators.nested import events, groups_of, json_pieces, leaf_paths, parse_json, pivot, shred
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

SCHEMA = "id bigint, pos string, rec struct<a:int,pos:string,items:array<struct<n:string,deep:array<int>,m:struct<x:double>>>,tags:array<string>>, list array<struct<owner:string>>"


def test_shred(spark):
    rows = [
        (1, "x", (5, "p", [("i", [1, None, 3], (0.5,)), None, ("j", None, None)], ["t", None]), [("o",), None]),
        (2, None, (None, None, [], None), None),
        (3, None, None, []),
        (None, None, (7, None, None, ["u"]), None),
        (1, "x", (5, "p", [("i", [1, None, 3], (0.5,)), None, ("j", None, None)], ["t", None]), [("o",), None]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    t = shred(df, "id", ["rec", "list"])
    assert set(t) == {"rec", "rec.items", "rec.items.deep", "rec.tags", "list"}
    assert sorted(map(tuple, t["rec"].collect()), key=str) == sorted([(1, [], 0, 5, "p"), (1, [], 0, 5, "p"), (2, [], 0, None, None), (None, [], 0, 7, None)], key=str)
    assert t["rec"].columns == ["owner", "parent_pos", "pos", "a", "leaf_pos"]
    assert {(r.owner, r.pos, r.n, r.m_x) for r in t["rec.items"].collect()} == {(1, 0, "i", 0.5), (1, 2, "j", None)}
    assert {(r.owner, tuple(r.parent_pos), r.pos, r.value) for r in t["rec.items.deep"].collect()} == {(1, (0,), 0, 1), (1, (0,), 2, 3)}
    assert {(r.owner, r.pos, r.value) for r in t["rec.tags"].collect()} == {(1, 0, "t"), (None, 0, "u")}
    assert {(r.owner, r.pos, r.leaf_owner) for r in t["list"].collect()} == {(1, 0, "o")}
    assert all(x.count() == 0 for x in shred(df.limit(0), "id", ["rec", "list"]).values())


def test_schema_walk():
    kind = T.StructType.fromDDL("a int, b struct<c:string,d:array<struct<e:int,f:array<string>>>>")
    assert [p for p, _ in leaf_paths(kind)] == ["a", "b.c"]
    assert list(groups_of(T.StructType([T.StructField("r", kind)]), ["r"])) == ["r", "r.b.d", "r.b.d.f"]


def test_json_shapes(spark):
    one = {"index": 0, "tags": {"LANGUAGE": "eng", "language": "ger"}}
    texts = [
        json.dumps({"streams": [one, None, {"index": 1}]}), json.dumps({"Result": {"STREAMS": [one]}}), json.dumps({"streams": json.dumps([one])}), json.dumps({"streams": one}),
        json.dumps([{"data": json.dumps({"streams": [one]})}]), '{"streams": [{"index": 0}', "", None, "[]", json.dumps({"streams": []}), json.dumps({"streams": None}), json.dumps({"streams": [{}] * 5000}),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id bigint, text string, owner string")
    pieces = json_pieces(df, "id", "text", "streams", ("streams",))
    got = sorted((r.owner, r.pos, r["index"], r.tags_language) for r in pivot(pieces, "streams", [("index", T.LongType()), ("tags.language", T.StringType())]).filter("owner < 11").collect())
    assert got == [(0, 0, 0, "eng"), (0, 2, 1, None), (1, 0, 0, "eng"), (2, 0, 0, "eng"), (3, 0, 0, "eng"), (4, 0, 0, "eng")]
    assert pieces.filter("owner = 11 and grp = 'streams'").count() == 5000
    assert json_pieces(df.limit(0), "id", "text").count() == 0


def test_deep_text():
    assert parse_json("[" * 100_000) == [] and parse_json('{"a": {"b": [[1, 2], [3]]}}')[1:] == [("a.b", [0], []), ("a.b", [0, 0], [("value", "1")]), ("a.b", [0, 1], [("value", "2")]), ("a.b", [1], []), ("a.b", [1, 0], [("value", "3")])]


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20)


def rebuilt(kinds, values):
    """The value that events stand for."""
    at = -1

    def one():
        nonlocal at
        at += 1
        if kinds[at] == "[":
            out = []
            while kinds[at + 1] != "]":
                out.append(one())
            at += 1
            return out
        if kinds[at] == "{":
            found = {}
            while kinds[at + 1] != "}":
                at += 1
                key = values[at]
                found[key] = one()
            at += 1
            return found
        return values[at]

    return one()


def plain(value):
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, str) else json.dumps(value)


@settings(max_examples=300, deadline=None)
@given(VALUES, st.sampled_from([None, 1]), st.booleans())
def test_events_read_what_was_written(value, indent, ascii_):
    text = json.dumps(value, indent=indent, ensure_ascii=ascii_)
    assert rebuilt(*events(text)) == plain(value)
    if isinstance(value, (dict, list)):  # text in text
        kinds, values = events(json.dumps({"a": text, "b": 1}), unwrap=True)
        assert kinds[1:3] == ["k", "t"] and values[2][0] == text and values[values[2][1]] == "b"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='{}[]",:\\ntue0159.-+e \t', max_size=14) | VALUES.map(json.dumps).flatmap(lambda t: st.integers(0, max(len(t) - 1, 0)).map(lambda i: t[:i] + t[i + 1 :])))
def test_events_refuse_what_is_no_json(text):
    try:
        json.loads(text)
        whole = True
    except ValueError:
        whole = False
    assert (events(text) is not None) == whole
