from datetime import datetime

import pytest
from corvane.operators import dedup, linking, planning, vectors
from corvane.plans import library
from corvane.sources import cache, files, sinks
from corvane.streaming import incremental
from pyspark.sql import functions as F

ITEM = "id bigint, path string, file_size bigint, media_type string, parsed struct<raw_title:string,year:int,season:int,episode:int,resolution:string,source:string,media_suffix:string,confidence:float>, quality struct<resolution_label:string,video_codec:string,video_bitrate:bigint,audio_codec:string,audio_bitrate:bigint,duration_secs:bigint,quality_score:double>, scraped struct<source:string,title:string,year:int,season_number:int,episode_number:int,tmdb_id:bigint,musicbrainz_id:string,openlibrary_id:string,confidence:float>, content_evidence struct<container:struct<track_titles:array<string>,stream_languages:array<string>>,subtitles:array<struct<language:string,track_title:string>>,runtime_secs:bigint,risk_flags:array<string>>, identity_resolution struct<confirmation_state:string>, hash struct<full_hash:bigint>"


def item(i, path, title="Same", year=2024, season=None, episode=None, kind="Movie", conf=0.9, q=None, subs=None, secs=None, runtime=None, tracks=None, state=None, tmdb=None, digest=None, suffix=None, label=None, rate=None, size=1024):
    quality = (label, None, rate, None, None, secs, q) if q is not None else None
    content = ((tracks or [], []), [("eng", s) for s in subs or []], runtime, []) if subs is not None or tracks or runtime else None
    scraped = ("Tmdb", title, year, season, episode, tmdb, None, None, 0.9) if tmdb else None
    return (i, path, size, kind, (title, year, season, episode, None, None, suffix, conf), quality, scraped, content, (state,) if state else None, (digest,) if digest else None)


def keeps(spark, *rows):
    rated = dedup.judged(spark.createDataFrame(list(rows), ITEM))
    return {r.version_key: r.keep_id for r in dedup.version_groups(rated).collect()}


def test_versions(spark):
    a, b = "/m/a.mkv", "/m/b.mkv"
    assert list(keeps(spark, item(0, a, q=8.0, state="Confirmed"), item(1, b, q=8.2, state="InsufficientEvidence")).values()) == [0]
    assert list(keeps(spark, item(0, a, q=8.7, suffix="2160p.REMUX", label="2160p"), item(1, b, q=8.9, suffix="2160p.WEB-DL", label="2160p")).values()) == [0]
    assert list(keeps(spark, item(0, "/m/sample/d.mkv", q=9.5, secs=480), item(1, "/m/feature/d.mkv", q=8.8, secs=7200)).values()) == [1]
    assert list(keeps(spark, item(0, a, q=9.3, secs=420, subs=["English Forced"], kind="TvShow", season=1, episode=2), item(1, b, q=8.4, secs=3300, subs=["English Full"], kind="TvShow", season=1, episode=2)).values()) == [1]
    assert list(keeps(spark, item(0, a, q=8.3, tracks=["Main", "Atmos"], subs=["Full", "SDH"]), item(1, b, q=8.35, tracks=["Commentary"])).values()) == [0]
    assert list(keeps(spark, item(0, a), item(1, b)).values()) == [1]
    assert keeps(spark, item(0, a, digest=4), item(1, b, digest=4)) == {}
    assert keeps(spark, item(0, "/s/Season 01/1.mkv", "A", kind="TvShow", season=1, episode=4, state="Confirmed", tmdb=197239), item(1, "/t/S01/x.mkv", "B", kind="TvShow", season=1, episode=4, state="Confirmed", tmdb=197239)) == {"tmdb:tv:197239:S01E04:season": 1}
    assert keeps(spark, item(0, "/s/Season 01/1.mkv", kind="TvShow", season=1, episode=4), item(1, "/s/Specials/1.mkv", kind="TvShow", season=1, episode=4)) == {}
    assert "fallback:Inception|2010|S00E00:feature" in keeps(spark, item(0, a, "Inception", 2010), item(1, b, "Inception", 2010))


def test_clusters(spark):
    df = spark.createDataFrame([(f"/x/0{i}.mkv",) for i in range(3)] + [("/y/a.mkv",), ("/y/b.mkv",), ("/y/S01E01.mkv",)], "path string")
    assert {r.dir: r.cluster for r in dedup.folder_clusters(df).collect()} == {"/x": True, "/y": False}


def test_progressive(spark):
    df = spark.createDataFrame([(1, "aaaa"), (2, "aaab"), (3, "aaaa"), (4, "z"), (5, None), (6, "")], "id bigint, text string")
    got = {r.key: (r["size"], r.prefix_hash is not None, r.full_hash is not None) for r in dedup.progressive_hash(df, "id", "text", prefix=3).collect()}
    assert got == {1: (4, True, True), 2: (4, True, True), 3: (4, True, True), 4: (1, False, False), 5: (None, False, False), 6: (0, False, False)}
    rows = dedup.progressive_hash(df, "id", "text").withColumnRenamed("key", "id")
    assert [tuple(r)[1:] for r in dedup.exact_groups(rows, F.col("full_hash")).collect()] == [(2, 1, 3)]


def test_progressive_hash_depths_of_long_texts(spark, tmp_path):
    head = "ä" * 32_768
    texts = [head + "a" * 9, head + "b" * 9, head + "b" * 9, head + "c" * 10, "x" + "y" * 69_999, "z" * 70_000, head, head, "short", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    raw = [t.encode() if t is not None else None for t in texts]
    others = lambda i, f: any(raw[i] is not None and y is not None and j != i and f(raw[i]) == f(y) for j, y in enumerate(raw))
    want = {(i, None if x is None else len(x), others(i, len), others(i, lambda y: (len(y), y[:65536]))) for i, x in enumerate(raw)}
    assert {tuple(r) for r in library.progressive_hash_depths(spark, str(tmp_path)).collect()} == want
    assert sum(full for *_, full in want) == 5


def test_latest(spark):
    t = lambda d: datetime(2024, 1, d)
    df = spark.createDataFrame([(1, t(1), "a"), (1, t(2), "b"), (2, None, "c"), (2, None, "c")], "id int, loaded_at timestamp, x string")
    assert {(r.id, r.x) for r in dedup.latest(df).collect()} == {(1, "b"), (2, "c")}


def test_cache(spark, tmp_path):
    rows = spark.createDataFrame([("scrape", "k", 1, "old"), ("scrape", "k", 50, "new"), ("scrape", "e", 1, "x"), ("hash", "k", 99, "h"), ("scrape", "n", None, "y")], "ns string, key string, updated_at bigint, value string")
    folder = str(tmp_path / "c")
    cache.append(rows, folder)
    day = 86400
    assert {(r.key, r.value) for r in cache.read(spark, folder, "scrape").collect()} == {("k", "new"), ("e", "x"), ("n", "y")}
    assert {r.key for r in cache.read(spark, folder, "scrape", now=30 + day, days=1).collect()} == {"k", "n"}
    cache.compact(spark, folder, str(tmp_path / "d"), 30 + day, 1)
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3
    one = spark.createDataFrame([('{"title": "A"}',), ('{"updated_at": 4, "value": {"title": "A"}}',), (None,)], "v string").select(cache.unpack(F.col("v"), "title string, confidence float").alias("c"))
    assert [r.c and tuple(r.c) for r in one.collect()] == [("A", None), ("A", None), None]


def test_linking(spark):
    answers = spark.createDataFrame([(1, "Tmdb", "b"), (1, "Guess", "a"), (2, "Other", "x"), (2, "Guess", "g"), (3, "Other", "x")], "k int, source string, title string")
    assert {tuple(r) for r in linking.first_source(answers, "k", "source", ["LocalNfo", "Tmdb", "Guess"]).collect()} == {(1, "Tmdb", "b"), (2, "Guess", "g")}
    items = spark.createDataFrame([(1, "/a/Film.mkv"), (2, "/a/Film.2.mkv")], "id int, path string")
    subs = spark.createDataFrame([("/a/Film.en.srt",), ("/a/Film-x.srt",), ("/a/Filmer.srt",), ("/b/Film.srt",), ("/a/Film.srt",)], "path string")
    assert {tuple(r) for r in linking.companions(items, subs).collect()} == {(1, "/a/Film.en.srt"), (1, "/a/Film-x.srt"), (1, "/a/Film.srt")}
    deep = spark.createDataFrame([(1, "/a/b/c/x.mkv"), (2, "/z/y.mkv")], "id int, path string")
    near = linking.nearest_above(deep, spark.createDataFrame([("/a", "far"), ("/a/b", "near")], "dir string, nfo string"), 3)
    assert [(r.id, r.depth, r.nfo) for r in near.collect()] == [(1, 1, "near")]
    assert linking.nearest_above(deep, spark.createDataFrame([("/a", "far")], "dir string, nfo string"), 2).count() == 0


def test_lookups(spark):
    items = spark.createDataFrame([(1, "Dark.Water.1080p", 2005, None, "Movie", ["Dark Water"]), (2, None, None, None, "Movie", None)], "id int, title string, year int, season int, media_type string, seen array<string>")
    films = spark.createDataFrame([(10, "Dark Water", None, 2005, 8.0), (11, "Dark Water", None, 2006, 5.0), (12, "Dark Water", None, 1990, 9.0), (13, "Honogurai", "Dark Water", None, None)], "id bigint, title string, original string, year int, rating double")
    got = [(r.c_id, round(r.score, 4), r.gap and round(r.gap, 4)) for r in linking.lookups(items, films).orderBy("rank").collect()]
    assert got == [(10, 2.18, 0.38), (11, 1.8, 0.12), (13, 1.68, None)]


def test_plans(spark, tmp_path):
    rows = spark.createDataFrame([(1, "/a/x.mkv", "Movie", "A", 2000, None, None, None), (2, "/a/y.mkv", "Movie", "A", 2000, None, None, None), (3, "/a/A (2000).mkv", "Movie", "A", 2000, None, None, None), (4, "/a/e.mkv", "TvShow", "B", None, 1, 2, "C"), (5, "/a/n", "Unknown", None, None, None, None, None)], "id int, path string, media_type string, title string, year int, season int, episode int, ep_name string")
    plan = planning.rename_plan(rows)
    got = {r.id: (r.new_path, r.wanted, r.occupied) for r in planning.conflicts(plan, rows.select("path")).collect()}
    assert got == {1: ("/a/A (2000).mkv", 2, True), 2: ("/a/A (2000).mkv", 2, True), 4: ("/a/B - S01E02 - C.mkv", 1, False)}
    moved = {r.id: r.new_path for r in planning.organize_plan(rows.withColumn("artist", F.lit(None).cast("string")), "/lib").collect()}
    assert moved[1] == "/lib/Movies/A/x.mkv" and moved[4] == "/lib/TV Shows/B/Season 01/e.mkv" and moved[5] == "/lib/Other/Unknown/n"
    old = tmp_path / "f.mkv"
    old.write_text("x")
    acts = spark.createDataFrame([(str(old), str(tmp_path / "d" / "g.mkv"), "Move"), (str(tmp_path / "none"), str(tmp_path / "h"), "Move")], "old_path string, new_path string, action string")
    assert sinks.carry_out(acts) == {"planned": 2, "done": 0, "errors": 0} and old.exists()
    assert sinks.carry_out(acts, dry_run=False) == {"planned": 2, "done": 1, "errors": 1} and (tmp_path / "d" / "g.mkv").exists()
    assert sinks.envelope(rows.filter("id = 5").select("id", "title"), "plan").first()[0] == '{"schema_version":"1","kind":"plan","data":{"id":5,"title":null}}'


@pytest.mark.parametrize("path,skip", [("/media/Movie/BDMV/STREAM/00001.m2ts", True), ("/media/raw/00042.ts", True), ("/media/Show/Season 1/Episode 01.mkv", False), ("/media/Movie/sample/demo.mp4", True), ("/media/x.doc", True)])
def test_scan(spark, path, skip):
    df = spark.createDataFrame([(path, 2_000_000)], "path string, length bigint")
    assert (files.select_media(df).count() == 0) == skip
    assert files.select_media(df.withColumn("length", F.lit(10).cast("bigint"))).count() == 0


def test_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("d/a.mkv", "d/b.mkv"):
        (tmp_path / name).write_bytes(b"same")
    found = files.listing(spark, str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r.length) for r in found.collect()} == {("a.mkv", 4), ("b.mkv", 4)}
    assert len({r.digest for r in files.prefix_digests(found).collect()}) == 1
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    rows = [(i, v[i].tolist()) for i in range(60)] + [(60, None), (61, []), (62, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {}
    for r in vectors.nearest(df, df.filter("id % 20 = 0 and id < 60"), "id", "v", 3, 4, 2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = u @ u[q]
        s[q] = -9
        assert [i for _, i in sorted(got[q])] == np.argsort(-s)[:3].tolist()


def test_stream(spark, tmp_path):
    t = lambda d: datetime(2024, 1, d)
    schema = "id bigint, path string, media_type string, file_size bigint, scanned_at timestamp"
    land = str(tmp_path / "in")
    for part in ([(1, "/a/F.2001.mkv", "Movie", 5, t(1)), (2, "/a/S.S01E02.mkv", "TvShow", 6, t(2))], [(1, "/a/F.2001.mkv", "Movie", 5, t(1)), (3, "/a/G.mkv", "Movie", 7, t(3))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(land)
    stream = incremental.arrivals(spark, land, spark.read.parquet(land).schema, 1)
    incremental.run(incremental.identified(incremental.distinct_items(stream)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.named.raw_title) for r in out.collect()) == [(1, "F"), (2, "S"), (3, "G")]
    assert incremental.counts_by_window(spark.read.parquet(land)).count() == 3


def test_small_tables_are_counted_before_they_are_sent(spark):
    from corvane.session import small

    plan = lambda n: spark.range(100).join(small(spark.range(n).hint("merge") if n > 5 else spark.range(n), 5), "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(5).lower() and "broadcast" not in plan(6).lower()
