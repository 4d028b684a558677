import pytest
from corvane.llm.textform import disguised, match_key, normalise, plain_form

CASES = [
    ("Café", "Café"),
    ("Ｃｏｌｄ Rain", "Cold Rain"),
    ("Saﬀron", "Saffron"),
    ("a b c", "a b c"),
    ("1984‑2", "1984-2"),
    ("L​o⁠st­", "Lost"),
    ("Lоst", "Lost"),  # Cyrillic o
    ("Гoрод", "Город"),  # Latin o in a Cyrillic word
    ("Ρocket", "Pocket"),
    ("ɡold", "gold"),
    ("King", "King"),
    ("ｶﾞｰ", "ガー"),
    ("한", "한"),
]


@pytest.mark.parametrize("text,plain", CASES)
def test_disguises(text, plain):
    assert plain_form(text) == plain
    assert plain_form(plain) == plain


@pytest.mark.parametrize("text", ["Plain title - 2", "Мост", "星空：海辺！", "double  space", "", "Hôtel", "Idle Α Storm", "Ьatman", "ᏣᎳᎩ", "zяmn"])
def test_plain_stays(text):
    assert plain_form(text) == text


def test_keys_meet():
    assert match_key("STRAßE  x ") == match_key("strasse Ｘ")
    assert match_key(None) is None and plain_form(None) is None


def test_columns(spark):
    long = "Ａ" * 200_000
    rows = spark.createDataFrame([(1, "A", "x"), (2, None, "y"), (3, "Ａ", "z"), (3, "Ａ", "z"), (4, "", None), (5, long, "w")], "id int, t string, plain string")
    got = {r.id: (r.plain, r.key) for r in normalise(rows, "t").collect()}
    assert got == {1: ("A", "a"), 2: (None, None), 3: ("A", "a"), 4: ("", ""), 5: ("A" * 200_000, "a" * 200_000)}
    assert normalise(rows, "t").count() == 6
    assert sorted(r.id for r in disguised(rows, "t").collect()) == [3, 3, 5]
    assert normalise(rows.limit(0), "t").count() == 0


def test_queries_on_stored_tables(spark, tmp_path):
    from corvane.llm import queries

    titles = [text for text, _ in CASES] + [plain for _, plain in CASES] + [None, "", "Plain"]
    spark.createDataFrame([(i, (t,)) for i, t in enumerate(titles)], "id bigint, parsed struct<raw_title:string>").write.parquet(f"{tmp_path}/media_item.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(titles)] * 2, "id bigint, original_title string").write.parquet(f"{tmp_path}/tmdb_movie.parquet")
    spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(titles)], "id string, title string").write.parquet(f"{tmp_path}/mb_recording.parquet")
    bad = [i for i, (text, plain) in enumerate(CASES) if text != plain]
    want = {(tab, key) for i in bad for tab, key in (("media_item", str(i)), ("tmdb_movie", str(i)), ("mb_recording", f"r{i}"))}
    got = queries.p2_found(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    made = {(r.tab, r.row_key): (r.plain, r.key) for r in queries.p2_titles(spark, str(tmp_path)).collect()}
    assert len(made) == 3 * len(titles) and all(made["media_item", str(i)][0] == CASES[i][1] == made["media_item", str(i + len(CASES))][0] for i in bad)
