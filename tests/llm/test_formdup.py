from corvane.llm.formdup import collapse, copies, nested_structure

LINES = [
    (1, "raw_title=Two Rivers; path=/a/b.mkv; year=1990"),
    (2, "Year: 1990 | RAW_TITLE:  two.rivers | Path: \\A\\B mkv"),
    (3, '{"path": "/a/b.mkv!", "year": "(1990)", "raw title": "TWO_RIVERS"}'),
    (4, "raw_title=Two Rivers; path=/a/b.mkv; year=1991"),
    (5, "raw_title=Two Rivers; path=/a/b.mkv"),
    (6, None),
    (7, ""),
    (8, "{not json"),
    (9, "x=1"),
    (10, "X : 1"),
    (11, '{"year": 1990, "path": "/a/b.mkv", "raw_title": "two rivers"}'),
    (11, '{"year": 1990, "path": "/a/b.mkv", "raw_title": "two rivers"}'),
]
PAIRS = {(1, 2), (1, 3), (1, 11), (6, 7), (9, 10)}


def test_copies(spark):
    df = spark.createDataFrame([(i, x, "z") for i, x in LINES] + [(None, "x=1", "z")], "key bigint, line string, root string")
    for hot in (1, 2, 1000):
        assert {tuple(r) for r in copies(df, "key", "line", hot_rows=hot).collect()} == PAIRS
    assert {tuple(r) for r in collapse(df, "key", "line").collect()} == {(1, 4), (4, 1), (5, 1), (6, 2), (8, 1), (9, 2)}
    assert copies(df.limit(0), "key", "line").count() == 0 and collapse(df.limit(0), "key", "line").count() == 0


def test_long_line(spark):
    long = "raw_title=" + "ab " * 100_000
    df = spark.createDataFrame([(1, long), (2, long.upper())], "id bigint, line string")
    assert [tuple(r) for r in copies(df, "id", "line").collect()] == [(1, 2)]


def test_nested_records(spark):
    lines = [
        '{"a": {"x": 1, "y": [1, {"p": "Q", "r": null}]}, "b": "c"}', '{"B": " C.", "A": {"Y": ["1", {"R": "", "p": "q"}], "x ": "1"}}', '{"a": {"x": 1, "y": [{"p": "Q", "r": null}, 1]}, "b": "c"}',
        '{"a": {"x": 1, "y": [1, 1]}}', '{"a": {"x": 1, "y": [1]}}', '{"a": {"x": 1, "x": 1, "y": [1]}}', '{"a": {}}', '{"a": []}', '{"a": ""}', "a=", '{"a": "x [1]"}', "A = x1", '{"a": {"x": 1, "y": [1]}', '{"a": "x1y1"}',
        '{"k": ' * 2000 + "1" + "}" * 2000, '{"K": ' * 2000 + '"1"' + "}" * 2000, '{"a": ["straße"]}', '{"a": ["STRASSE"]}',
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "key bigint, line string")
    assert {tuple(r) for r in copies(df, "key", "line").collect()} == {(0, 1), (4, 5), (8, 9), (10, 11), (12, 13), (14, 15)}  # a line that is no whole object is read as text
    assert nested_structure('{"a": 1}') is None and nested_structure("[{}]") is None and nested_structure(None) is None and nested_structure('{"a": [}') is None
