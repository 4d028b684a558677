from corvane.functions import evidence, scoring, templates, titles
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_titles(spark):
    assert one(spark, titles.query_form(F.lit("A.B__C"))) == "A B C"
    assert one(spark, titles.variants(F.lit("Show.Name.S01E02.1080p.2020"))) == ["Show.Name.S01E02.1080p.2020", "Show Name S01E02 1080p 2020", "Show Name S01E02 2020", "Show Name"]
    assert one(spark, titles.variants(F.lit("  "))) == [] and one(spark, titles.variants(F.lit(None).cast("string"))) == []
    assert one(spark, titles.distinct_ignoring_case(F.array(F.lit("a"), F.lit("A "), F.lit(""), F.lit("b")))) == ["a", "b"]
    assert [tuple(x) for x in one(spark, titles.artist_and_title(F.lit("Ann Lee - Blue Song")))] == [("Ann Lee", "Blue Song")]
    assert [tuple(x) for x in one(spark, titles.artist_and_title(F.lit("Ann Blue Song")))] == [("Ann", "Blue Song")]
    assert [tuple(x) for x in one(spark, titles.artist_and_title(F.lit("Song")))] == [("Song", "Song")]
    assert one(spark, titles.percent_encoded(F.lit("a b*~é"))) == "a%20b%2A~%C3%A9"
    assert one(spark, titles.xml_escaped(F.lit("<a & 'b'>"))) == "&lt;a &amp; &apos;b&apos;&gt;"
    assert one(spark, titles.query_plan(F.lit("A"), F.array(F.lit("B.C")), F.array(F.lit("Season 1"), F.lit("a"), F.lit("D")))) == ["A", "B.C", "B C", "D"]
    assert one(spark, titles.shortened(F.lit("abcdef"), 4)) == "abc…"


def test_evidence(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\nHello <i>you</i>\n\nPreviously on Dark Water\n[music]\nx\nHELLO you\nDark Water - S01E03"
    assert one(spark, evidence.spoken_lines(F.lit(text))) == ["Hello you", "Previously on Dark Water", "HELLO you", "Dark Water - S01E03"]
    assert one(spark, evidence.telling_lines(evidence.spoken_lines(F.lit(text)))) == ["Previously on Dark Water", "Dark Water - S01E03", "Hello you"]
    ass = "Dialogue: 0,0:00,0:01,D,,0,0,0,,{\\i1}Hi, there\\Nfriend\nComment: 0,,,,,,,,,no"
    assert one(spark, evidence.spoken_lines(F.lit(ass), dialogue=True)) == ["Hi, there friend"]
    assert one(spark, evidence.titles_in(F.lit("Dark Water - S01E03"))) == ["Dark Water"]
    assert tuple(one(spark, evidence.episode_mark(F.lit("x S02E11")))) == (2, 11) and tuple(one(spark, evidence.episode_mark(F.lit("第 7 集")))) == (None, 7)
    assert one(spark, evidence.title_aliases(F.array(F.lit("Dark.Water"), F.lit("dark-water"), F.lit(" ")))) == ["Dark Water"]
    assert one(spark, evidence.spoken_lines(F.lit(None).cast("string"))) == []


def test_templates(spark):
    f = {"title": F.lit("A"), "year": F.lit(None).cast("int"), "s": templates.two_digits(F.lit(1)), "e": templates.two_digits(F.lit(123)), "media_suffix": F.lit("1080P")}
    name = lambda t, **k: one(spark, templates.clean_name(templates.render(t, f, **k)))
    assert name("{title} ({year})") == "A" and name("{title} - S{s:02d}E{e:02d} - {ep_name}") == "A - S01E123"
    assert name("{{ title }}{% if year %} ({{ year }}){% endif %}", keep_suffix=True) == "A - 1080P"
    assert name("{none}") is None
    assert one(spark, templates.safe_name(F.lit('a:b  "c"'))) == "a_b _c_"


def test_scores(spark):
    q = lambda *a: one(spark, scoring.quality_score(*[F.lit(x).cast(t) for x, t in zip(a, ("int", "string", "bigint", "string"), strict=True)]))
    assert q(2160, "HEVC", 100_000_000, "DTS") == 40 + 27 + 20 + 9.5 and abs(q(None, None, None, None) - 50) < 1e-9
    assert one(spark, scoring.release_bonus(F.lit("dts"))) == -0.45 and one(spark, scoring.release_bonus(F.lit(None).cast("string"))) == 0.0
    assert one(spark, scoring.resolution_label(F.lit(300))) == "300p"
    best = lambda p, pc, s, sc: one(spark, scoring.preferred(F.lit(p).cast("string"), scoring.f32(pc), F.lit(s).cast("string"), scoring.f32(sc)))
    assert best("a", 0.9, "b", 0.88)["value"] == "b" and best("a", 0.9, "b", 0.7)["value"] == "a" and best(None, 0.0, None, 0.0) is None
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, scoring.cosine(a(1, 0), a(1, 0))) == 1.0 and one(spark, scoring.cosine(a(1), a(1, 0))) == 0.0 and one(spark, scoring.cosine(a(0), a(0))) == 0.0
