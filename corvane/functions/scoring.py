"""Scores of technical quality, trust in metadata and completeness, as Columns.

Confidences are FLOAT and scores DOUBLE, as thresholds fall differently in the two.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.paths import extension, let, stem

# Weights, steps and bonuses of the scores.
QUALITY_WEIGHTS = {"resolution": 0.4, "codec": 0.3, "bitrate": 0.2, "audio": 0.1}
HEIGHT_SCORES = [(2160, 100.0), (1080, 80.0), (720, 60.0)]
VIDEO_SCORES = {"AV1": 95.0, "H.265": 90.0, "HEVC": 90.0, "H.264": 70.0}
AUDIO_SCORES = {"DTS": 95.0, "Atmos": 95.0, "FLAC": 90.0, "AAC": 65.0}
SOURCE_BONUS = {"LocalNfo": 0.08, "Tmdb": 0.06, "MusicBrainz": 0.06, "OpenLibrary": 0.06, "AiAssist": -0.05, "Guess": -0.12}
STATE_ADJUSTMENT = {"Confirmed": 0.18, "HighConfidenceCandidate": 0.10, "AmbiguousCandidates": -0.08, "InsufficientEvidence": -0.14}
STATE_TRUST = {"Confirmed": 1.0, "HighConfidenceCandidate": 0.82, "AmbiguousCandidates": 0.42, "InsufficientEvidence": 0.18}
LABEL_BONUS = {"2160p": 0.65, "4k": 0.65, "1440p": 0.4, "1080p": 0.24, "720p": 0.08}
SUFFIX_BONUS = [(("hdr",), 0.28), (("dv", "dovi", "dolby vision"), 0.3), (("remux",), 0.36), (("atmos",), 0.2), (("truehd", "dts-hd"), 0.16)]
RELEASE_TIERS = [(("remux", "uhd blu", "ultra hd blu"), 0.48), (("bluray", "blu-ray", "bdrip"), 0.24), (("web-dl", "webdl"), 0.12), (("webrip",), 0.06), (("hdtv",), -0.04), (("cam", "ts", "tc"), -0.45)]
PROVENANCE_BONUS = {"season_cluster": 0.14, "season": 0.08, "loose": 0.02, "extras": -0.65}
PREFERRED_LANGUAGES = ["zh", "zho", "chi", "chs", "cht", "en", "eng"]
EXTRAS = ["/extras/", "/featurettes/", "/behind the scenes/", "/specials/", "特别篇", "花絮"]
SAMPLES = ["/sample/", " sample", "-sample"]
SEASON_FOLDERS = ["/season ", "/s01", "/s02", "/s03", "/s04", "/s1/", "/s2/"]
EPISODE_MARKS = ["S01E", "S02E", "S03E", "S04E", "EP"]
CLUSTER_EXTENSIONS = ["mkv", "mp4", "avi", "mov", "m4v", "ts", "m2ts", "wmv", "webm"]
TRUSTED_CONFIDENCE, TRUST_MARGIN, ID_TRUST = 0.72, 0.03, 0.82


def f32(value: float) -> Column:
    return F.lit(value).cast("float")


def pick(key: Column, values: dict[str, float], other: float | None = 0.0, kind: str = "double") -> Column:
    out = reduce(lambda w, p: w.when(key == p[0], F.lit(p[1]).cast(kind)), list(values.items())[1:], F.when(key == next(iter(values)), F.lit(next(iter(values.values()))).cast(kind)))
    return out.otherwise(F.lit(other).cast(kind))


def any_in(text: Column, parts: list[str] | tuple[str, ...]) -> Column:
    """Whether a text holds one of the parts; a null one holds none."""
    return reduce(lambda a, b: a | b, [F.contains(F.coalesce(text, F.lit("")), F.lit(p)) for p in parts])


def _points(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def total(*parts: Column) -> Column:
    return reduce(lambda a, b: a + b, parts)


def quality_score(height: Column, video: Column, bitrate: Column, audio: Column, weights: dict[str, float] = QUALITY_WEIGHTS) -> Column:
    """0 to 100 by resolution, codec, bit rate and audio; what is unknown counts 50."""
    by_height = reduce(lambda w, p: w.when(height >= p[0], p[1]), HEIGHT_SCORES, F.when(height.isNull(), 50.0)).otherwise(40.0)
    by_rate = F.when(bitrate.isNull(), 50.0).otherwise(F.least(F.lit(100.0), bitrate.cast("double") / 50e6 * 100))
    return by_height * weights["resolution"] + pick(video, VIDEO_SCORES, 50.0) * weights["codec"] + by_rate * weights["bitrate"] + pick(audio, AUDIO_SCORES, 50.0) * weights["audio"]


def resolution_label(height: Column) -> Column:
    return F.when(height.isNull(), "unknown").when(height >= 2160, "4K").when(height >= 1080, "1080p").when(height >= 720, "720p").when(height >= 480, "480p").otherwise(F.concat(height.cast("string"), F.lit("p")))


def clamp(value: Column) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, f32(0.0)), f32(1.0)))


def scraped_authority(confidence: Column, source: Column, state: Column | None = None) -> Column:
    """Trust in looked-up metadata by its source and, if given, the state of the identity; null without metadata."""
    out = clamp((confidence + pick(source, SOURCE_BONUS, 0.0, "float")).cast("float"))
    return out if state is None else clamp((out + pick(state, STATE_ADJUSTMENT, 0.0, "float")).cast("float"))


def identity_trust(state: Column) -> Column:
    return pick(state, STATE_TRUST, 0.0, "float")


def preferred(parsed: Column, parsed_trust: Column, scraped: Column, scraped_trust: Column) -> Column:
    """A struct of value, origin and confidence: the looked-up value if it is trusted, else the parsed one; null if both are."""
    return let(F.struct(parsed.alias("p"), F.coalesce(parsed_trust, f32(0.0)).alias("pt"), scraped.alias("s"), F.coalesce(scraped_trust, f32(0.0)).alias("st")), lambda r: _preferred(r["p"], r["pt"], r["s"], r["st"]))


def _preferred(parsed: Column, parsed_trust: Column, scraped: Column, scraped_trust: Column) -> Column:
    looked_up = F.struct(scraped.alias("value"), F.lit("Scraped").alias("origin"), scraped_trust.alias("confidence"))
    own = F.struct(parsed.alias("value"), F.lit("Parsed").alias("origin"), parsed_trust.alias("confidence"))
    trusted = (scraped_trust >= f32(TRUSTED_CONFIDENCE)) & ((scraped_trust + f32(TRUST_MARGIN)).cast("float") >= parsed_trust)
    return F.when(scraped.isNull() & parsed.isNull(), None).when(parsed.isNull(), looked_up).when(scraped.isNull(), own).when(trusted, looked_up).otherwise(own)


def suffix_bonus(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    return total(*[_points(any_in(lower, parts), points) for parts, points in SUFFIX_BONUS])


def release_bonus(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda w, p: w.when(any_in(lower, p[0]), p[1]), RELEASE_TIERS, F.when(lower == "", 0.0)).otherwise(0.0)


def codec_bonus(video: Column, audio: Column) -> Column:
    v, a = F.lower(video), F.lower(audio)
    return _points(any_in(v, ["265", "hevc"]), 0.12) + F.when(any_in(a, ["truehd", "dts-hd", "atmos"]), 0.2).when(any_in(a, ["dts"]), 0.1).otherwise(0.0)


def is_forced(title: Column) -> Column:
    lower = F.lower(F.coalesce(title, F.lit("")))
    return F.contains(lower, F.lit("forced")) & ~F.contains(lower, F.lit("full"))


def is_commentary(title: Column) -> Column:
    return F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit("commentary"))


def _apart(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def version_quality(parsed: Column, quality: Column, content: Column) -> Column:
    """How good a version is by bit rates, codecs, release tier, subtitles and tracks; missing structs add nothing."""
    return let(F.struct(parsed.alias("p"), quality.alias("q"), content.alias("c")), lambda r: _version_quality(r["p"], r["q"], r["c"]))


def _version_quality(parsed: Column, quality: Column, content: Column) -> Column:
    subs = content["subtitles"]
    n = F.when(subs.isNull(), 0).otherwise(F.size(subs))
    rate = lambda c, per, most: F.when(quality[c].isNull(), 0.0).otherwise(F.least(quality[c].cast("double") / per, F.lit(most)))
    tracks, languages = content["container"]["track_titles"], content["container"]["stream_languages"]
    own_tracks = F.when(tracks.isNull(), 0).otherwise(F.size(F.filter(tracks, lambda t: ~is_commentary(t))))
    full = F.when(subs.isNull(), 0).otherwise(F.size(F.filter(subs, lambda s: ~is_forced(s["track_title"]) & ~is_commentary(s["track_title"]))))
    gap = _apart(content["runtime_secs"], quality["duration_secs"])
    return total(
        rate("video_bitrate", 4e6, 1.1), rate("audio_bitrate", 512e3, 0.35), _points(quality["duration_secs"] >= 1200, 0.18),
        pick(F.lower(F.trim(quality["resolution_label"])), LABEL_BONUS), F.when(quality.isNull(), 0.0).otherwise(codec_bonus(quality["video_codec"], quality["audio_codec"])),
        *[suffix_bonus(parsed[c]) for c in ("media_suffix", "source", "resolution")], *[release_bonus(parsed[c]) for c in ("media_suffix", "source")],
        F.when(n > 0, 0.22 + F.greatest(F.least(n, F.lit(3)).cast("double") - 1, F.lit(0.0)) * 0.05).otherwise(0.0),
        _points(F.coalesce(F.exists(subs, lambda s: F.lower(F.coalesce(s["language"], F.lit(""))).isin(PREFERRED_LANGUAGES)), F.lit(False)), 0.08),
        F.when(gap <= 3, 0.08).when(gap >= 90, -0.18).otherwise(0.0),
        F.when(own_tracks >= 2, 0.16).when(own_tracks == 1, 0.06).otherwise(0.0), _points(F.coalesce(F.size(languages), F.lit(0)) >= 2, 0.08), _points(full >= 2, 0.12),
    )


def is_episode_name(path: Column) -> Column:
    name = F.trim(stem(path))
    return any_in(F.upper(name), EPISODE_MARKS) | name.rlike("^[0-9]{1,3}$")


def is_cluster_file(path: Column) -> Column:
    return extension(path).isin(CLUSTER_EXTENSIONS)


def provenance(kind: Column, path: Column, cluster: Column) -> Column:
    """Where an episode stands: extras, season_cluster, season or loose; feature for other kinds."""
    lower = F.lower(path)
    return F.when(~F.coalesce(kind.isin("TvShow", "Strm"), F.lit(False)), "feature").when(any_in(lower, EXTRAS), "extras").when(cluster, "season_cluster").when(any_in(lower, SEASON_FOLDERS), "season").otherwise("loose")


def completeness(kind: Column, path: Column, quality: Column, content: Column, place: Column) -> Column:
    """How far a file is a whole feature or episode: samples, extras, forced subtitles, failed probes and short runs lower it."""
    return let(F.struct(kind.alias("k"), path.alias("p"), quality.alias("q"), content.alias("c"), place.alias("at")), lambda r: _completeness(r["k"], r["p"], r["q"], r["c"], r["at"]))


def _completeness(kind: Column, path: Column, quality: Column, content: Column, place: Column) -> Column:
    lower, subs = F.lower(path), content["subtitles"]
    n = F.when(subs.isNull(), 0).otherwise(F.size(subs))
    forced = (n > 0) & F.forall(subs, lambda s: is_forced(s["track_title"]))
    short = F.when((kind == "Movie") & (quality["duration_secs"] < 2400), -0.75).when(kind.isin("TvShow", "Strm") & (quality["duration_secs"] < 600), -0.55).otherwise(0.0)
    return total(
        _points(any_in(lower, SAMPLES), -1.25), _points(any_in(lower, EXTRAS), -0.85), F.when(forced, -0.55).when(n > 0, 0.18).otherwise(0.0),
        _points(F.coalesce(F.exists(content["risk_flags"], lambda f: F.contains(F.lower(f), F.lit("failed"))), F.lit(False)), -0.15),
        _points(_apart(content["runtime_secs"], quality["duration_secs"]) >= 180, -0.4), short, pick(place, PROVENANCE_BONUS),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers; 0 for different lengths, empty arrays and zero norms, and for nulls."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms), F.lit(0.0))
