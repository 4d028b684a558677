import itertools
import random

import numpy as np
from corvane.llm import entity
from corvane.llm.entity import assign, confidence, distance, match, names_of, neighbours, one_to_one, words_of
from corvane.llm.queries import p5_best_files
from hypothesis import given, settings
from hypothesis import strategies as st

FILMS = [(1, "The Silent Harbor", None, 1990), (2, "The Silent Harbor", None, 2010), (3, "Karen: The Iron Door", "Дом (Karens House)", 2001), (4, "Velofin", None, 1980), (5, "Velofin 2", None, 1984), (6, "Été de Velomar", None, None), (7, None, None, 1999), (8, "", "", None)]
ITEMS = [(1, "silent.harbor.the", 1990), (2, "The_Silnet_Harbor", 2010), (3, "The Silent Harbor", 2000), (4, "Karen", 2001), (5, "karens house", None), (6, "Velofin II", 1984), (7, "Velofin", 1984), (8, "Ete.de.Velomar", 1970), (9, None, 1990), (10, "...", 1990), (11, "Unrelated Thing", 1990), (1, "silent.harbor.the", 1990), (12, "The Silent Harbor Directors Cut", 1990), (13, "ＳＩＬＥＮＴ Hаrbor", 1991)]
WANT = {1: 1, 12: 1, 2: 2, 4: 3, 5: 3, 6: 5, 8: 6, 13: 1}


def frames(spark):
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "id bigint, title string, year int, name string")
    films = spark.createDataFrame([(*r, 1) for r in FILMS], "id bigint, title string, original_title string, year int, kind int")
    return items, films


def test_match(spark):
    items, films = frames(spark)
    got = {r.left_key: r.right_key for r in match(items, films, "id", "id", "year", "year", ["title"], ["title", "original_title"]).collect()}
    assert got == WANT
    assert match(items.limit(0), films, "id", "id", "year", "year", ["title"], ["title"]).count() == 0
    assert match(items, films.limit(0), "id", "id", "year", "year", ["title"], ["title"]).count() == 0


def test_window_crosses_partitions(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("bcdfgaeiou") for _ in range(12)) for _ in range(400)]
    rows = [(0, n, 1990, 0) for n in names] + [(1, n[:5] + "z" + n[6:], 1990, 0) for n in names]
    df = spark.createDataFrame(rows, "side int, name string, year int, kind int").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r.left, r.right) for r in neighbours(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {(n, n[:5] + "z" + n[6:]) for n in names} <= got


def test_spellings_of_one_film_keep_it_in_the_window(spark):
    rng = random.Random(5)
    films = ["stolen fagitamon", *["".join(rng.choice("bcdfgaeiou") for _ in range(12)) for _ in range(200)]]
    slips = {f[:i] + c + f[i + 1 :] for f in films[:1] for i in range(len(f)) if f[i] != " " for c in "abcdefghijklmnopqrstuvwxyz"}
    slips |= {f[:5] + "z" + f[6:] for f in films}
    rows = [(0, n, 1990, 0) for n in sorted(slips)] + [(1, n, 1990, 0) for n in films]
    df = spark.createDataFrame(rows, "side int, name string, year int, kind int").repartition(7)
    got = {(r.left, r.right) for r in neighbours(df).collect()}
    assert got == {(n, f) for n in slips for f in films if confidence(n, f, 1990, 1990, 0) is not None}


def test_names():
    assert words_of("The Last & Lost: Part III") == ["last", "and", "lost", "part", "3"]
    assert words_of("Curtai,n.Directors.Cut") == ["curtain"] and words_of("...") == []
    assert names_of("X Y (Ab: Cde)", True) == {"x y ab cde": 0, "x y": 0, "ab cde": 0}


def test_distance():
    assert distance("abcd", "abdc", 2) == 1 and distance("abc", "xyz", 2) == 3 and distance("", "ab", 2) == 2


def test_assignment():
    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (2, 5), (5, 3), (1, 1)):
        for _ in range(20):
            w = np.round(rng.random((n, m)), 3) * (rng.random((n, m)) < 0.7)
            best = max(sum(w[i, p[i]] for i in range(n)) if n <= m else 0 for p in itertools.permutations(range(max(n, m)), n)) if n <= m else max(sum(w[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
            assert abs(sum(w[i, j] for i, j in assign(w)) - best) < 1e-9


def test_one_to_one(spark):
    rows = [(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.85), (3, 12, 0.5), (3, 12, 0.6), (None, 1, 0.5), (4, 13, 0.0)]
    df = spark.createDataFrame(rows, "left bigint, right bigint, confidence double")
    assert {tuple(r) for r in one_to_one(df).collect()} == {(1, 11, 0.8), (2, 10, 0.85), (3, 12, 0.6)}
    assert {(r.left, r.right) for r in one_to_one(df, most=1).collect()} == {(1, 10), (3, 12)}
    assert one_to_one(df.limit(0)).count() == 0


def test_best_files_gives_each_twin_an_item(spark, tmp_path):
    items = [(i, "Movie", ("Silent Harbor", 1990)) for i in range(1, 4)] + [(4, "Movie", ("Velofin Garden", None))]
    spark.createDataFrame(items, "id bigint, media_type string, parsed struct<raw_title string, year int>").write.parquet(f"{tmp_path}/media_item.parquet")
    films = [(10, "Silent Harbor", None, "1990-01-01"), (11, "Silent Harbor", None, "1990-05-05"), (12, "Velofin Garden", None, None)]
    spark.createDataFrame(films, "id bigint, title string, original_title string, release_date string").write.parquet(f"{tmp_path}/tmdb_movie.parquet")
    got = [tuple(r) for r in p5_best_files(spark, str(tmp_path)).select("item_id", "tmdb_id").collect()]
    assert sorted(f for _, f in got) == [10, 11, 12] and len({i for i, _ in got}) == 3 and (4, 12) in got


def test_one_to_one_of_large_parts(spark):
    rng = np.random.default_rng(1)
    wide = [(i, 1000 + j, float(np.round(0.5 + rng.random() / 2, 2))) for i in range(500) for j in range(3)] + [(500, 1000, 1.0), (500, 1001, 0.2), (501, 1000, 0.9)]
    square = [(600 + i, 2000 + j, float(np.round(rng.random(), 3))) for i in range(9) for j in range(7) if rng.random() < 0.6]

    def greatest(rows):
        left, right = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
        w = np.zeros((len(left), len(right)))
        for a, b, c in rows:
            w[left.index(a), right.index(b)] = c
        return sum(w[i, j] for i, j in assign(w))

    for rows, most, epsilon, loss in ((wide, 400, None, 1e-9), (wide[::-1], 400, 0.05, 1e-9), ([(b, a, c) for a, b, c in wide], 400, None, 1e-9), (square, 2, 0.05, 7 * 0.05)):
        got = [tuple(r) for r in one_to_one(spark.createDataFrame(rows, "left bigint, right bigint, confidence double"), most, epsilon).collect()]
        assert len({r[0] for r in got}) == len({r[1] for r in got}) == len(got) and set(got) <= set(rows)
        assert sum(r[2] for r in got) >= greatest(rows) - loss


def test_slips_in_short_names(spark):
    films = [(1, "Karen", 2001), (2, "Bomiganen", 2008), (3, "Velo", 1990), (4, "Vela", 1990), (5, "Arc", 1995)]
    items = [(1, "Karne", 2001), (2, "Bmignaen", 2008), (3, "Veli", 1990), (4, "Karne", 2002), (5, "Ark", 1995), (6, "Velo", 1990), (7, "Krane", None), (8, "Kaxne", 2001)]
    a, b = (spark.createDataFrame(x, "id bigint, title string, year int") for x in (items, films))
    got = {r.left_key: r.right_key for r in match(a, b, "id", "id", "year", "year", ["title"], ["title"]).collect()}
    assert got == {1: 1, 2: 2, 6: 3}


def edits(a, b):
    """Edits with swaps of neighbours, by the whole table."""
    t = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                t[i][j] = min(t[i][j], t[i - 2][j - 2] + 1)
    return t[-1][-1]


@settings(max_examples=500, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 4))
def test_distance_is_the_whole_tables(a, b, most):
    assert entity.distance(a, b, most) == min(edits(a, b), most + 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab cdé字", max_size=8), max_size=12))
def test_sketches_are_within_the_edits(names):
    marks = entity._sketches(names)
    one = lambda n: sum(1 << i for i in range(31) if sum(ord(c) % 31 == i for c in n) % 2) | sum(1 << 32 + i for i in range(31) if sum((ord(c) * 7 + ord(d)) % 31 == i for c, d in zip(n, n[1:], strict=False)) % 2)
    flat = [n.replace(" ", "") for n in names]
    assert marks.tolist() == [one(n) for n in flat]
    for i, a in enumerate(flat):
        for j, b in enumerate(flat[:i]):
            x, d = int(marks[i]) ^ int(marks[j]), edits(a, b)
            assert (x & 0xFFFFFFFF).bit_count() <= 2 * d and (x >> 32).bit_count() <= 6 * d
