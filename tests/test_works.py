import struct

import pytest
from corvane.functions import evidence, identify, templates, titles
from corvane.operators import dedup, folders, identity, linking, planning
from corvane.operators.nested import parse_json, pivot, shred, struct_pieces
from corvane.sources import assist, config, files, index, probe, sinks
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_folder_plans(spark):
    items = spark.createDataFrame(
        [
            (1, "/tv/show/s1/a.mkv", "TvShow", "My: Show", None, 1), (2, "/tv/show/s1/b.mkv", "TvShow", "Other", None, 2), (3, "/m/x/f.mkv", "Movie", "Film", 2001, None), (4, "/m/Film  (2001)/f.mkv", "Movie", "Film ", 2001, None),
            (5, "/tv/extras/e.mkv", "Movie", "Extra", None, None), (6, "/tv/Season 1/x.mkv", "Music", None, None, None), (7, "/top.mkv", "Movie", "Top", None, None), (8, "/m/y/g.mkv", "Movie", None, 2000, None), (9, None, "Movie", "X", None, None),
        ],
        "id int, path string, media_type string, title string, year int, season int",
    )
    plans = folders.folder_plans(items)
    assert rows(plans) == [("/m/Film  (2001)", "/m/Film (2001)"), ("/m/x", "/m/Film (2001)"), ("/tv/show", "/tv/My_ Show"), ("/tv/show/s1", "/tv/show/Season 01")]
    moves = spark.createDataFrame([(1, "/tv/show/s1/a.mkv", "/tv/show/s1/A.mkv"), (7, "/top.mkv", "/t.mkv")], "id int, old_path string, new_path string")
    got = {(r.id, r.old_path): [(f.old_path, f.new_path) for f in r.folder_plans] for r in folders.attached(moves, plans).collect()}
    assert got[1, "/tv/show/s1/a.mkv"] == [("/tv/show/s1", "/tv/show/Season 01"), ("/tv/show", "/tv/My_ Show")] and got[7, "/top.mkv"] == []
    assert got[None, "/m/x"] == [("/m/x", "/m/Film (2001)")] and len(got) == 4
    assert folders.folder_plans(items.limit(0)).count() == 0


def test_subtitles(spark):
    plans = spark.createDataFrame([(1, "/a/F.mkv", "/a/New.Name.mkv"), (2, "/a/G", "/a/H")], "id int, old_path string, new_path string")
    subs = spark.createDataFrame([("/a/F.en.SRT",), ("/a/F-x.ass",), ("/a/Fx.srt",), ("/a/F.txt",), ("/a/G.srt",), ("/b/F.srt",), ("/a/F.en.SRT",)], "path string")
    got = rows(folders.subtitle_plans(plans, subs))
    assert got == [(1, "/a/F-x.ass", "/a/New.Name-x.ass"), (1, "/a/F.en.SRT", "/a/New.Name.en.SRT"), (2, "/a/G.srt", "/a/H.srt")]
    clash = folders.rename_conflicts(plans.unionByName(spark.createDataFrame([(3, "/b/x.mkv", "/a/New.Name.mkv"), (4, "/b/y", "/b/F.srt")], plans.schema)), folders.subtitle_plans(plans, subs), subs.unionByName(spark.createDataFrame([("/a/H.srt",), ("/b/x.mkv",)], "path string")))
    assert rows(clash) == [(1, ["target_wanted"]), (2, ["subtitle_exists"]), (3, ["target_wanted"]), (4, ["target_exists"])]
    items = spark.createDataFrame([(1, "/a/F.mkv"), (2, "/a/Z.mkv"), (3, "/b/Q.mkv"), (4, "/c/Q.mkv")], "id int, path string")
    assert rows(folders.external_subtitles(items, subs)) == [(1, "/a/F-x.ass"), (1, "/a/F.en.SRT"), (3, "/b/F.srt")]


def test_sidecars(spark):
    items = spark.createDataFrame([(1, "/tv/s/S1/a.mkv"), (2, "/tv/s/S1/b.mkv"), (3, "/tv/s/S1/x/y/c.mkv"), (4, "/tv/s/x/d.mkv")], "id int, path string")
    known = spark.createDataFrame([("/tv/s/S1/a.nfo",), ("/tv/s/tvshow.nfo",), ("/tv/s/S1/tvshow.nfo",), ("/tv/tvshow.nfo",)], "path string")
    assert rows(folders.sidecars(items, known)) == [(1, "/tv/s/S1/a.nfo", 0), (2, "/tv/s/S1/tvshow.nfo", 1), (3, "/tv/s/S1/tvshow.nfo", 3), (4, "/tv/s/tvshow.nfo", 2)]
    text = """<episodedetails a="b"><title> </title><title>Ep</title><titlex>no</titlex><showtitle>Show</showtitle><year>2001</year><season>2</season><fanart><thumb>u</thumb></fanart>
      <uniqueid type="imdb">tt1</uniqueid><uniqueid type="TMDB" default="true"> 77 </uniqueid><uniqueid type="tvdb">5</uniqueid><uniqueid type="musicbrainz">m-1</uniqueid><rating>7.5"""
    got = spark.createDataFrame([(text,), ("<movie><plot>x</plot></movie>",), (None,), ("<movie><title>A & B</title><uniqueid>12</uniqueid><uniqueid type=\"tmdb\">13</uniqueid>",)], "t string").select(files.sidecar_record(F.col("t")).alias("s"))
    a, b, c, d = [r.s for r in got.collect()]
    assert (a.title, a.episode_name, a.year, a.season_number, a.fanart_url, a.tmdb_id, a.musicbrainz_id, a.rating, a.openlibrary_id) == ("Show", "Ep", 2001, 2, "u", 77, "m-1", None, None)
    assert b is None and c is None and (d.title, d.tmdb_id) == ("A & B", 12)


def test_templates(spark):
    df = spark.createDataFrame([("T", 2000, "x264", None, ".mkv"), ("t ", None, None, "S", "")], "title string, year int, media_suffix string, artist string, ext string")
    fields = {c: F.col(c) for c in df.columns}
    show = lambda t, keep=False: [r[0] for r in df.select(templates.render(t, fields, keep)).collect()]
    assert show("{title} ({year}) {unknown}") == ["T (2000) ", "t  () "]
    assert show("{title}", True) == ["T - x264", "t "]
    assert show("{{ title | trim | upper }}{% if year %} [{{ year }}{% if artist %}!{% endif %}]{% elif artist %} by {{artist}}{% else %}?{% endif %}{# note #}") == ["T [2000]", "T by S"]
    assert show("{% if not year %}none{% endif %}{{ title }}{{ ext }}", True) == ["T - x264.mkv", "nonet "]
    assert show("{{ nothing }}") == [None, None] and show("{{ title | odd }}") == [None, None]
    named = spark.createDataFrame([(1, "/a/x.MKV", "TvShow", "T", 3, 4), (2, "/a/y.mkv", "Other", "U", None, None)], "id int, path string, media_type string, title string, season int, episode int")
    assert rows(planning.rename_plan(named, {"Movie": "{title}", "TvShow": "{title} {s}x{e}{ext}"}, season_offset=-5), "new_path") == [("/a/T 00x04.MKV",), ("/a/U.mkv",)]


def test_organize(spark):
    df = spark.createDataFrame([(1, "/a/X.MKV", "Music", "A/B", None, None), (2, "/a/y.mkv", "Movie", "Y", None, "z"), (3, "/b/y.mkv", "Movie", "Y", None, None), (4, "/c/n.mkv", "Movie", None, None, None)], "id int, path string, media_type string, title string, season int, artist string")
    got = {r.id: (r.new_path, r.action) for r in planning.organize_plan(df, "/l", "sym").collect()}
    assert got == {1: ("/l/Music/A_B/X.MKV", "SymLink"), 2: ("/l/Movies/Y/y.mkv", "SymLink"), 3: ("/l/Movies/Y/y.mkv", "SymLink"), 4: ("/l/Movies/Unknown/n.mkv", "SymLink")}
    assert {r.id: r.new_path for r in planning.organize_plan(df, "/l", mode="local").collect()} == {1: "/a/A_B/X.MKV", 2: "/a/Y/y.mkv", 3: "/b/Y/y.mkv"}
    assert planning.organize_plan(df, "/l", mode="rename").count() == 0
    disk = spark.createDataFrame([("/l/Movies/Y/y.nfo",), ("/l/Music/A_B/X.MKV",), ("/l/Movies/Unknown/poster.jpg",)], "path string")
    images = spark.createDataFrame([(4, "poster.jpg"), (2, "poster.jpg")], "id int, name string")
    found = planning.organize_conflicts(planning.organize_plan(df, "/l"), disk, df.filter("id = 2"), images)
    assert rows(found) == [(1, ["target_exists"]), (2, ["sidecar_exists", "target_wanted"]), (3, ["target_wanted"]), (4, ["image_exists"])]
    assert spark.range(1).select(planning.image_names(F.array(F.lit("a.png?x"), F.lit("b"), F.lit("c")))).first()[0] == ["poster.png", "fanart.jpg", "image.jpg"]
    outcome = spark.createDataFrame([("executed", 2), ("errors", 0), ("executed", None)], "outcome string, assets int")
    assert rows(planning.receipt(outcome)) == [(2, 0, 0, 0, 1, 2)]


CONTENT = "container struct<title:string,comment:string,chapters:array<string>,track_titles:array<string>>, subtitles array<struct<title_candidates:array<string>>>, visual array<struct<text_hits:array<string>>>, audio array<struct<transcript_hits:array<string>>>, title_candidates array<string>, season_hypotheses array<int>, episode_hypotheses array<int>"


def test_identity(spark):
    scraped = ("Tmdb", "Show", 1, 2, None, 0.95)
    full, none = (("Show", None, [], []), [([],)], [], [], ["The Show"], [1], [2]), (None, None, None, None, None, None, None)
    cand = lambda score, title="Show", s=1, e=2: (title, s, e, None, score)
    data = [
        (1, "TvShow", scraped, [cand(0.5), cand(1.2)], full), (2, "TvShow", scraped, [cand(1.2), cand(1.1)], full), (3, "TvShow", scraped, None, full), (4, "TvShow", None, None, full), (5, "Movie", scraped, [cand(1.2), None], none),
        (6, "Movie", scraped, [cand(1.2, "Else", None, None)], full), (7, None, None, [], None), (8, "TvShow", scraped, [cand(1.2)], (("x", None, None, None), [], [("",)] and [(["hit"],)], [(["said"],)], ["Show", None], [1], [9])),
    ]
    df = spark.createDataFrame(data, f"id int, kind string, s struct<source:string,title:string,season_number:int,episode_number:int,episode_name:string,confidence:float>, c array<struct<title:string,season:int,episode:int,episode_title:string,score:float>>, e struct<{', '.join(x.replace(' ', ':', 1) for x in CONTENT.split(', '))}>")
    got = {r.id: (r.r.strong_sources, r.r.corroboration, r.r.ambiguous, r.r.state) for r in df.select("id", identity.resolve(F.col("kind"), F.col("s"), F.col("c"), F.col("e")).alias("r")).collect()}
    assert got[1] == (2, 3, False, "Confirmed") and got[2] == (2, 3, True, "AmbiguousCandidates") and got[3] == (2, 3, False, "HighConfidenceCandidate") and got[4] == (2, 0, False, "InsufficientEvidence")
    assert got[5] == (0, 0, False, "InsufficientEvidence") and got[6] == (2, 0, False, "HighConfidenceCandidate") and got[7] == (0, 0, False, "InsufficientEvidence") and got[8] == (3, 2, False, "HighConfidenceCandidate")


def test_choices(spark):
    met = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 1.0, 2), (2, 12, 2.0, 1), (3, 13, 3.0, 1), (3, 14, 2.9, 2)], "id int, c_id bigint, score float, rank int")
    alike = spark.createDataFrame([(3, 14, 0.99), (1, 10, 0.0)], "id int, c_id bigint, embedding double")
    got = {r.id: (r.c_id, round(r.confidence, 3)) for r in identity.choose(met, alike).collect()}
    assert got == {1: (11, 0.9), 2: (12, 0.9), 3: (14, 0.97)}
    series = spark.createDataFrame([(1, 5, 1, 2, 0.9), (2, 5, None, 2, 0.9)], "id int, c_id bigint, season int, episode int, confidence float")
    known = spark.createDataFrame([(5, 1, 2, "B"), (5, 1, 2, "A")], "series_id bigint, season int, episode int, episode_name string")
    assert [(i, n, round(c, 2)) for i, n, c in rows(identity.with_episodes(series, known), "id", "episode_name", "confidence")] == [(1, "A", 0.95), (2, None, 0.9)]
    asked = spark.createDataFrame([(1, 0, "No", "One"), (1, 1, "The Band", "A.Song"), (2, 0, None, "x"), (3, 0, "", "")], "id int, pos int, artist string, title string")
    book = spark.createDataFrame([("b", "the band", "a song", "L"), ("a", "The Band", "A Song", "M"), ("z", None, None, None)], "c_id string, artist string, title string, album string")
    assert rows(identity.first_hits(asked, book, ["artist", "title"])) == [(1, 1, "a", "M")]
    assert [round(r[0], 4) for r in spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "c float").select(identity.guess(F.col("c"))).collect()] == [0.3, 0.62, 0.62]


def test_candidate_points_of_episodes(spark):
    one = spark.range(1)
    lit = lambda x, t="string": F.lit(x).cast(t)
    score = lambda s, e, kind="TvShow": round(one.select(linking.candidate_score(lit("Show"), lit(None, "int"), lit(1, "int"), lit(kind), lit(None, "array<string>"), lit("Show"), lit(None), lit(None, "int"), lit(None, "bigint"), lit(None, "double"), lit(2, "int"), lit(s, "int"), lit(e, "int"))).first()[0], 3)
    assert (score(1, 2), score(1, 3), score(None, 2), score(1, 2, "Movie")) == (1.6, 1.38, 1.42, 1.2)


def test_hot_titles_are_asked_once(spark):
    items = spark.createDataFrame([(i, "Same Title", 2000, None, "Movie", None) for i in range(3000)] + [(9000, "Same Title", 2001, None, "Movie", ["Same Title"])], "id int, title string, year int, season int, media_type string, seen array<string>")
    films = spark.createDataFrame([(1, "Same Title", None, 2000, 5.0), (2, "same.title", None, 2001, 5.0)], "id bigint, title string, original string, year int, rating double")
    got = linking.lookups(items, films)
    assert got.count() == 6002 and rows(got.filter("rank = 1").groupBy("c_id").count()) == [(1, 3000), (2, 1)]


def test_lines(spark):
    lines = [("Dark Water - S01E02 - x", None), ("Show: Episode 5", None), ("暗水 / Dark Water", None), ("Alpha / Beta", "chi"), ("Alpha / Beta", "eng"), ("Watching: 暗水", None), ("", None), (None, None), ("Previously on Lost", "en"), ("subtitle / 字幕组", "zh")]
    got = [r[0] for r in spark.createDataFrame(lines, "l string, lang string").select(evidence.line_titles(F.col("l"), F.col("lang"))).collect()]
    assert got[:5] == [["Dark Water"], ["Show"], ["暗水", "Dark Water"], ["Alpha", "Beta"], []] and "暗水" in got[5]
    assert not got[6] and not got[7] and got[8] == ["Lost"] and got[9] == []


def test_kinds_and_reasons(spark):
    df = spark.createDataFrame([("A.S01E02.1080p", "Music"), ("B 2001 WEBRip", "Movie"), ("c", None)], "n string, k string").select("k", identify.identify(F.col("n")).alias("p"))
    got = rows(df.select(identify.kind_after(F.col("k"), F.col("p")).alias("k"), identify.reasons(F.col("p")).alias("r")))
    assert ("TvShow", ["matched TV pattern SxxExx", "detected resolution tag 1080P"]) in got and ("Movie", ["matched movie title + year pattern", "validated year 2001", "detected source tag WEBRip"]) in got


def test_bracket_forms(spark):
    df = spark.createDataFrame([("[Sub][星空 第2季][08][1080p]",), ("[Sub][Star Sky 3rd Season][12]",)], "n string").select(identify.identify(F.col("n")).alias("p"))
    assert [(r.p.raw_title, r.p.season, r.p.episode, r.p.form) for r in df.collect()] == [("星空", 2, 8, "bracket_zh"), ("Star Sky", 3, 12, "bracket_en")]


def test_keeps(spark):
    schema = "id int, path string, version_key string, full_hash bigint, effective double, quality_score double, trust float, metadata_confidence float, completeness double, file_size bigint, mtime int"
    row = lambda i, key, digest, eff, size, at: (i, f"/{i}.mkv", key, digest, eff, 1.0, 1.0, 1.0, 0.0, size, at)
    df = spark.createDataFrame([row(1, "a", 7, 1.0, 5, 9), row(2, "a", 7, 2.0, 5, None), row(3, "a", None, 1.0, 4, 8), row(4, "b", 8, 1.0, 1, 1), row(5, "b", 8, 1.0, 1, 1), row(6, "c", None, 1.0, 1, 1)], schema)
    grouped = dedup.members(df)
    assert rows(grouped, "content_id", "kind", "id") == [("a", "Version", 1), ("a", "Version", 2), ("a", "Version", 3), ("hash:7", "Exact", 1), ("hash:7", "Exact", 2), ("hash:8", "Exact", 4), ("hash:8", "Exact", 5)]
    choice = dedup.kept(grouped)
    assert rows(choice.filter("content_id = 'a'"), "strategy", "keep_id", "drops") == [("HighestQuality", 2, 2), ("Largest", 2, 2), ("Manual", None, 3), ("Newest", 1, 2)]
    assert rows(dedup.removals(grouped, choice.filter("strategy = 'Newest'")), "id", "keep_name") == [(2, "1.mkv"), (2, "1.mkv"), (3, "1.mkv"), (4, "5.mkv")]


def test_caches(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    cache = spark.createDataFrame([("a", 5), ("a", 6)], "k string, v int")
    found, missing = linking.with_cache(items, cache, ["k"])
    assert rows(found) == [("a", 1, 6), ("b", 2, None), (None, 3, None)] and rows(missing, "id") == [(2,), (3,)]
    live, kept = spark.createDataFrame([("/r/a",), ("/r2/b",)], "path string"), spark.createDataFrame([("/r/c",)], "path string")
    assert rows(linking.cached_else_live(kept, live, "/r", True)) == [("/r/c",)] and rows(linking.cached_else_live(kept, live, "/r", False)) == [("/r/a",)] and rows(linking.cached_else_live(None, live, "/r2/b", True)) == [("/r2/b",)]


def test_nested_shapes(spark):
    deep = '{"a": ' * 3000 + "1" + "}" * 3000
    assert len(parse_json(deep)) == 1 and parse_json('{"x":1}}') == parse_json('{"x" 1}') == parse_json('{"x":01}') == parse_json('{"x":1,}') == parse_json("[1 2]") == parse_json('"a') == parse_json("nul") == []
    text = '{"streams":[{"index":1}]}'
    for _ in range(20):
        text = '{"w": [' + text + "]}"
    assert ("streams", [0], [("index", "1")]) in parse_json(text, "streams")
    assert parse_json('{"L": "fr", "l": "en", "n": 1e5, "s": "[1]", "t": true}')[0][2] == [("l", "fr"), ("l", "en"), ("n", "1e5"), ("s", "[1]"), ("t", "true")]
    df = spark.createDataFrame([(1, [[1, None], None, [2]], [([("a", [7])], "x")])], "id int, grid array<array<int>>, l array<struct<m:array<struct<n:string,o:array<int>>>,p:string>>")
    tables = shred(df, "id", ["grid", "l"], stored=True)
    assert rows(tables["grid.value"]) == [(1, [0], 0, 1), (1, [2], 0, 2)]
    assert rows(tables["l.m.o"]) == [(1, [0, 0], 0, 7)] and rows(tables["l.m"]) == [(1, [0], 0, "a")]
    assert pivot(struct_pieces(df, "id", ["l"]), "l", []).columns == ["owner", "parent_pos", "pos"]


def test_index_and_walk(spark, tmp_path):
    (tmp_path / "d" / ".hid").mkdir(parents=True)
    for name in ("d/.hid/a.mkv", "d/b.mkv", "_c.mkv"):
        (tmp_path / name).write_bytes(b"xy")
    (tmp_path / "link.mkv").symlink_to(tmp_path / "d" / "b.mkv")
    (tmp_path / "d" / "loop").symlink_to(tmp_path)
    names = lambda df: sorted(r.path.removeprefix(str(tmp_path) + "/") for r in df.collect())
    assert names(files.walk(spark, str(tmp_path))) == ["_c.mkv", "d/.hid/a.mkv", "d/b.mkv"]
    assert "link.mkv" in names(files.walk(spark, str(tmp_path), 2, follow_links=True)) and names(files.walk(spark, str(tmp_path), 0)) == ["_c.mkv"]
    folder, scan = str(tmp_path / "index"), lambda p: files.walk(spark, p)
    first, how = index.load_or_scan(spark, folder, str(tmp_path / "d"), scan, 4_000_000_000)
    assert how == "live" and first.count() == 2
    (tmp_path / "d" / "new.mkv").write_bytes(b"x")
    again, how = index.load_or_scan(spark, folder, str(tmp_path / "d"), scan, 1)
    assert how == "cached" and again.count() == 2
    assert index.load(spark, folder, str(tmp_path / "d"), 4_000_000_001) is None and index.load(spark, folder, "/other", 1) is None
    one, how = index.load_or_scan(spark, folder, str(tmp_path / "d" / "b.mkv"), scan, 1)
    assert how == "live" and names(one) == ["d/b.mkv"]
    with pytest.raises(FileNotFoundError):
        index.load_or_scan(spark, folder, str(tmp_path / "none"), scan, 1)


def test_config(tmp_path):
    assert config.load(tmp_path / "none.toml") == config.DEFAULTS
    own = config.merged(config.DEFAULTS, {"scan": {"max_depth": 3, "noise_words": ['a"b\\', "é\n"]}, "extra": {"a b": 1.5}})
    config.save(own, tmp_path / "x" / "c.toml")
    assert config.load(tmp_path / "x" / "c.toml") == own
    (tmp_path / "bad.toml").write_text("= 1")
    with pytest.raises(ValueError):
        config.load(tmp_path / "bad.toml")


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def element(kind, body):
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + b"\x01" + len(body).to_bytes(7, "big") + body


def test_probe(spark, tmp_path):
    video = box(b"avc1", bytes(24) + struct.pack(">HH", 1920, 1080) + bytes(50))
    audio = box(b"mp4a", bytes(16) + struct.pack(">H", 2) + bytes(6) + struct.pack(">I", 48000 << 16))
    stsd = lambda x: box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", bytes(4) + struct.pack(">I", 1) + x)))))
    mvhd = box(b"mvhd", bytes(12) + struct.pack(">II", 1000, 65_500) + bytes(80))
    (tmp_path / "a.mp4").write_bytes(box(b"ftyp", b"isom") + box(b"mdat", bytes(1000)) + box(b"moov", mvhd + stsd(video) + stsd(audio)))
    track = element(0xAE, element(0x86, b"V_MPEGH/ISO/HEVC") + element(0xE0, element(0xB0, (3840).to_bytes(2, "big")) + element(0xBA, (2160).to_bytes(2, "big"))))
    sound = element(0xAE, element(0x86, b"A_DTS") + element(0xE1, element(0x9F, b"\x02")))
    info = element(0x1549A966, element(0x2AD7B1, (1_000_000).to_bytes(3, "big")) + element(0x4489, struct.pack(">d", 90_000.0)))
    (tmp_path / "b.mkv").write_bytes(element(0x1A45DFA3, b"") + element(0x18538067, info + element(0x1654AE6B, track + sound)))
    (tmp_path / "c.mkv").write_bytes(b"\x1a\x45")
    (tmp_path / "d.flac").write_bytes(b"")
    df = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.mp4", "b.mkv", "c.mkv", "d.flac", "none.mp4")] + [(None,)], "path string")
    got = {(r.path or "").rsplit("/", 1)[-1]: r for r in probe.file_quality(df).collect()}
    assert tuple(got["a.mp4"])[1:8] == (1920, 1080, "H.264", "AAC", 2 * 48000 * 16, 65, "1080p") and tuple(got["b.mkv"])[1:7] == (3840, 2160, "H.265", "DTS", None, 90)
    assert got["c.mkv"].height is None and got["d.flac"].audio_codec == "FLAC" and got["none.mp4"].resolution_label == "unknown" and got[""].quality_score == 50


def test_actions(spark, tmp_path):
    for name in ("s/x.mkv", "s/x.srt", "t/y.mkv", "u/z.mkv", "u/w.mkv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    p = lambda n: str(tmp_path / n)
    pair = "array<struct<old_path:string,new_path:string>>"
    plans = spark.createDataFrame([(p("s/x.mkv"), p("s/X.mkv"), [(p("s/x.srt"), p("s/X.srt"))], [(p("s"), p("S 1"))], []), (p("t/y.mkv"), p("t/Y.mkv"), [], None, ["target_exists"]), (p("none"), p("n"), None, None, None)], f"old_path string, new_path string, subtitles {pair}, folders {pair}, conflicts array<string>")
    assert sinks.rename(plans) == {"executed": 4, "blocked": 1, "guarded": 0, "skipped": 0, "errors": 0} and (tmp_path / "s/x.mkv").exists()
    assert sinks.rename(plans, dry_run=False) == {"executed": 3, "blocked": 1, "guarded": 0, "skipped": 0, "errors": 1} and (tmp_path / "S 1/X.srt").exists()
    dups = spark.createDataFrame([(p("u/z.mkv"), False, False), (p("u/w.mkv"), True, False), (p("t/y.mkv"), False, True)], "path string, is_keep boolean, guarded boolean")
    assert sinks.remove_duplicates(dups)["executed"] == 1 and sinks.remove_duplicates(dups, "Report")["executed"] == 2 and sinks.remove_duplicates(dups, dry_run=False)["skipped"] == 1
    assert sinks.remove_duplicates(dups, "Trash", p("bin"), False) == {"executed": 1, "blocked": 0, "guarded": 1, "skipped": 0, "errors": 0} and (tmp_path / "bin/z.mkv").exists()
    (tmp_path / "e").mkdir()
    assert sinks.remove_empty_folders(spark.createDataFrame([(p("e/a"),), (p("t/y.mkv"),)], "old_path string")) == 1 and not (tmp_path / "e").exists()
    out = sinks.report(spark, "rename", spark.createDataFrame([(2,)], "entries int"), spark.createDataFrame([("b",), ("a",)], "old_path string"), dry_run=True).first()[0]
    assert out == '{"schema_version":"1","kind":"execution_report","command":"rename","summary":{"entries":2},"entries":[{"old_path":"a"},{"old_path":"b"}],"dry_run":true}'


def test_texts(spark):
    df = spark.createDataFrame([('say ```json\n {"a": 1}\n``` {x}',), ('so {"a": {"b": 2}} end',), ("none",)], "t string")
    assert [r[0] for r in df.select(titles.json_in(F.col("t"))).collect()] == ['{"a": 1}', '{"a": {"b": 2}}', ""]
    sizes = spark.createDataFrame([(5,), (2048,), (3 << 30,), (5 << 50,), (None,)], "n bigint")
    assert [r[0] for r in sizes.select(titles.human_bytes(F.col("n"))).collect()] == ["5 B", "2.0 KB", "3.0 GB", "5120.0 TB", None]


def test_assistant(spark):
    items = spark.createDataFrame([(1, "/a/x.mkv", "X", 2000, ["A", "B"]), (2, None, None, None, None), (3, "/c", None, None, [])], "id int, path string, t string, y int, seen array<string>")
    asked = items.select("id", assist.question(F.col("path"), F.col("t"), F.col("y"), F.col("seen")).alias("question"))
    assert asked.filter("id = 1").first().question.split("\n")[1:] == ["path: /a/x.mkv", "title: X", "year: 2000", "seen in it: A; B"]

    def ask(questions):
        return [None if "path" not in q else '```json\n{"title": "T", "year": 1999}\n```' if "title: X" in q else '{"title": " "}' for q in questions]

    got = [(r.id, r.answer.title, r.answer.year, r.answer.source, r.answer.album) for r in assist.identified(asked, ask, 2).collect()]
    assert got == [(1, "T", 1999, "AiAssist", None)]
    assert [probe.backend("auto", dry, there) for dry, there in ((True, True), (False, True), (False, False))] == ["native", "external", "native"] and probe.backend("external", True, False) == "external"


def test_candidates_without_an_id_merge_by_title_and_year(spark):
    items = spark.createDataFrame([(1, "A.B", 2000, None, "Movie", None)], "id int, title string, year int, season int, media_type string, seen array<string>")
    films = spark.createDataFrame([(None, "A B", None, 2000, 5.0), (None, "A B", None, 2000, 9.0), (None, "A B", None, 2001, 1.0), (7, "a b", None, None, None), (7, "x", "a b", None, None)], "id bigint, title string, original string, year int, rating double")
    assert sorted((r.c_id or 0, r.c_year or 0) for r in linking.lookups(items, films).collect()) == [(0, 2000), (0, 2001), (7, 0)]


def test_searches_are_kept(spark):
    rows_, kept = spark.createDataFrame([("Alpha",), ("beta",)], "t string"), planning.Searches()
    first = kept.find(1, rows_, " ALPHA ", F.col("t"))
    assert first.count() == 1 and kept.find(1, rows_, "alpha", F.col("t")) is first and kept.find(1, rows_, "  ", F.col("t")).count() == 2
    assert kept.find(2, rows_, "alpha", F.col("t")) is not first and len(kept._held) == 1


def test_text_table(spark):
    df = spark.createDataFrame([(1, "a long name of a file"), (20, None), (3, "x")], "n int, `the name` string")
    assert sinks.text_table(df, 2, 8).split("\n") == [" n  the name", "--  --------", " 1  a long …", "20  -", "…"]
    assert sinks.text_table(df.limit(0)) == "n  the name\n-  --------"


def test_dialogue(spark):
    text = "[Events]\nFormat: Layer, Start\nDialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{\\i1}Hello, there{\\i0}\\NFriend\n Dialogue: 0,a,b,c,d,e,f,g,h,Second\nDialogue: 0,short\nComment: 0,a,b,c,d,e,f,g,h,No"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(evidence.spoken_lines(F.col("t"), dialogue=True).alias("l")).collect()
    assert [r.l for r in got] == [["Hello, there Friend", "Second"], []]
