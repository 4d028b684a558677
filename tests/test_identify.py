import pytest
from corvane.functions import context, identify, paths
from pyspark.sql import functions as F

NAMES = {
    "Breaking.Bad.S01E02.1080p.WEB-DL.x264-CtrlHD.mp4": dict(raw_title="Breaking.Bad", season=1, episode=2, resolution="1080P", codec="X264", release_group="CtrlHD", media_suffix="1080P.WEB-DL.X264.CtrlHD"),
    "The.Office.1x02.Pilot.HDTV.mp4": dict(raw_title="The.Office", season=1, episode=2, source="HDTV"),
    "[GM-Team][国漫][一人之下 第5季][The Outcast 5th Season][2022][08][AVC][GB][1080P].mp4": dict(raw_title="一人之下", season=5, episode=8, year=2022),
    "Inception.2010.1080p.BluRay.x264-SPARKS.mkv": dict(raw_title="Inception", year=2010, resolution="1080P", form="movie"),
    "Something.1800.mp4": dict(year=None, form="fallback"),
    "random_file.mp4": dict(raw_title="random_file", form="fallback"),
    "Test.2160p.UHD.mkv": dict(resolution="2160P"),
    "Test.HEVC.1080p.mkv": dict(codec="H.265"),
    "Show.S01E01.1080p.WEB-DL.ColorTV.mp4": dict(raw_title="Show", season=1),
    "Movie.1999.mkv": dict(year=1999, media_suffix=None),
    "Thing.WEB-DL": dict(source=None, form="fallback"),
    "": dict(raw_title="", form="fallback"),
}
FOLDERS = [
    (("Episode 1", None, None, None), ["Season 1", "Show"], dict(season=1)),
    (("Episode 1", None, None, None), ["S01", "Show"], dict(season=1)),
    (("Movie", None, None, None), ["Movie (2023)", "Movies"], dict(year=None)),
    (("Show", None, 2, None), ["Season 1", "Show"], dict(season=2)),
    (("", None, None, None), ["Breaking Bad"], dict(raw_title="Breaking Bad", from_folder=True)),
    (("S07E02", None, None, None), ["S07", "9号秘事"], dict(raw_title="9号秘事", season=7, episode=2)),
    (("01", None, None, None), ["财阀家的小儿子"], dict(raw_title="财阀家的小儿子", episode=1)),
    (("S05E09. 中英字幕", None, None, None), ["S05", "黄石 1-5季"], dict(raw_title="黄石", season=5, episode=9)),
    (("2025. .HQ. . .HDR. (2025) - . . .", None, None, None), ["刺z杀z小z说家2 (2025) 4K 高码 HDR"], dict(raw_title="刺杀小说家2", year=2025)),
    (("S09E02", None, None, None), ["S09", "9号秘事 1-9季(1)"], dict(raw_title="9号秘事")),
]


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES] + [(None,)], "n string").select("n", identify.identify(paths.stem(F.col("n"))).alias("p"))
    got = {r.n: r.p for r in df.collect()}
    assert got[None] is None
    for name, want in NAMES.items():
        assert {k: got[name][k] for k in want} == want, name


@pytest.mark.parametrize("i", range(len(FOLDERS)))
def test_folders(spark, i):
    (title, year, season, episode), folders, want = FOLDERS[i]
    df = spark.createDataFrame([(title, year, season, episode, 0.5, folders)], "t string, y int, s int, e int, c float, f array<string>")
    got = df.select(context.infer(*[F.col(c) for c in "tysecf"]).alias("p")).first().p
    if title == "Movie":
        want = dict(year=2023)
    assert {k: got[k] for k in want} == want


def test_noise(spark):
    df = spark.createDataFrame([("Movie.2024.1080p.ColorTV",), ("电影.字幕侠.2024",), ("Breaking.Bad.S01E02",)], "n string")
    assert [r[0] for r in df.select(identify.drop_noise(F.col("n"), ["MyGroup"])).collect()] == ["Movie.2024.1080p.", "电影. .2024", "Breaking.Bad.S01E02"]


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/c.x.mkv",), ("c",), ("/a/.hid",), (None,)], "p string")
    p = F.col("p")
    rows = df.select(paths.file_name(p), paths.stem(p), paths.extension(p), paths.parent(p), paths.ancestors(p, 3), paths.ancestor_paths(p)).collect()
    assert tuple(rows[0]) == ("c.x.mkv", "c.x", "mkv", "/a/b", ["b", "a"], ["/a/b", "/a"])
    assert tuple(rows[1]) == ("c", "c", "", "", [], []) and tuple(rows[2])[:4] == (".hid", ".hid", "", "/a")
    assert all(x is None for x in rows[3][:4])
