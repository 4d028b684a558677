"""Which work an item is: scores of candidates, evidence of its content, and how sure the identity is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import scoring, titles
from corvane.functions.paths import let

# Confidence of each source, weights of the embedding, and limits.
SOURCE_CONFIDENCE = {"LocalNfo": 0.98, "Tmdb": 0.90, "MusicBrainz": 0.86, "OpenLibrary": 0.83, "AiAssist": 0.62}
EPISODE_CONFIDENCE, ACCEPTED_CONFIDENCE = 0.95, 0.88
CHOICE_BASE, CHOICE_SCORE, CHOICE_EMBEDDING, CHOICE_MOST = 0.62, 0.18, 0.08, 0.97
GUESS_BASE, GUESS_PARSED, GUESS_MOST = 0.30, 0.35, 0.62
EMBEDDING_WEIGHT, AMBIGUOUS_GAP, CONFIRMED_SCORE = 0.12, 0.18, 1.05


def _f(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def _list(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def strong_sources(content: Column) -> Column:
    """How many kinds of content say something: container, subtitles, pictures, sound."""
    box = content["container"]
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    kinds = [
        box["title"].isNotNull() | some(box["chapters"]) | some(box["track_titles"]), some(content["subtitles"]),
        F.coalesce(F.exists(content["visual"], lambda v: F.coalesce(F.size(v["text_hits"]) > 0, F.lit(False))), F.lit(False)),
        F.coalesce(F.exists(content["audio"], lambda v: F.coalesce(F.size(v["transcript_hits"]) > 0, F.lit(False))), F.lit(False)),
    ]
    return sum((F.coalesce(k, F.lit(False)).cast("int") for k in kinds), F.lit(0))


def hint(parsed: Column, hypotheses: Column) -> Column:
    """The parsed number, else the first that the content suggests."""
    return F.coalesce(parsed, F.get(hypotheses, F.lit(0)))


def title_seen(title: Column, episode_title: Column, seen: Column) -> Column:
    """Whether a title found in the content is a candidate's, or the one holds the other."""
    own, episode = titles.match_form(title), F.coalesce(titles.match_form(episode_title), F.lit(""))
    said = F.filter(F.transform(_list(seen, "string"), titles.match_form), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.coalesce(F.exists(said, lambda x: (x == own) | ((episode != "") & (x == episode)) | F.contains(own, x) | F.contains(x, own)), F.lit(False))


def resolve(kind: Column, scraped: Column, candidates: Column, content: Column) -> Column:
    """A struct of strong_sources, corroboration, ambiguous, score and state.

    candidates: structs with title, season, episode, episode_title and score; the best comes first, of equals the first.  Without
    any, the looked-up metadata is the candidate, with its authority as score.  Ambiguous: the two best differ by less than 0.18.
    corroboration counts the title, season and episode of the best that the content holds too.
    """
    real = F.transform(F.filter(candidates, lambda c: c.isNotNull()), lambda c: F.struct(c["title"].alias("title"), c["season"].alias("season"), c["episode"].alias("episode"), c["episode_title"].alias("episode_title"), _f(c["score"]).alias("score")))
    real = F.coalesce(real, F.array().cast("array<struct<title:string,season:int,episode:int,episode_title:string,score:float>>"))
    ordered = F.transform(F.array_sort(F.transform(real, lambda c, i: F.struct((-F.coalesce(c["score"], _f(0.0))).alias("s"), i.alias("i"), c.alias("c")))), lambda x: x["c"])
    own = F.when(scraped.isNotNull(), F.struct(scraped["title"].alias("title"), scraped["season_number"].alias("season"), scraped["episode_number"].alias("episode"), scraped["episode_name"].alias("episode_title"), scoring.scraped_authority(scraped["confidence"], scraped["source"]).alias("score")))
    return let(F.struct(kind.alias("k"), ordered.alias("o"), own.alias("own"), content.alias("c")), lambda r: _resolved(r["k"], r["o"], F.coalesce(F.get(r["o"], F.lit(0)), r["own"]), r["c"]))


def _resolved(kind: Column, ordered: Column, best: Column, content: Column) -> Column:
    strong = strong_sources(content)
    holds = lambda hypotheses, x: F.coalesce(F.array_contains(hypotheses, x), F.lit(False))
    gap = F.abs(F.get(ordered, F.lit(0))["score"] - F.get(ordered, F.lit(1))["score"])
    ambiguous = F.coalesce((F.size(ordered) > 1) & (_f(gap) < _f(AMBIGUOUS_GAP)), F.lit(False))
    title = title_seen(best["title"], best["episode_title"], content["title_candidates"])
    season, episode = holds(content["season_hypotheses"], best["season"]), holds(content["episode_hypotheses"], best["episode"])
    corroboration = F.when(best.isNull(), 0).otherwise(title.cast("int") + season.cast("int") + episode.cast("int"))
    fits = F.when(kind == "TvShow", season & episode | title & episode | title & season & best["episode_title"].isNotNull()).when(kind == "Movie", title).otherwise(False)
    sure = F.coalesce(best["score"] >= _f(CONFIRMED_SCORE), F.lit(False)) & fits
    state = F.when(best.isNull() | (strong == 0), "InsufficientEvidence").when(ambiguous, "AmbiguousCandidates").when((strong >= 2) & (corroboration >= 2) & sure, "Confirmed").otherwise("HighConfidenceCandidate")
    return F.struct(strong.alias("strong_sources"), corroboration.alias("corroboration"), ambiguous.alias("ambiguous"), best["score"].alias("score"), state.alias("state"))


def guess(parsed: Column) -> Column:
    """The confidence (FLOAT) of metadata taken from a name alone."""
    return _f(F.least(F.greatest(_f(_f(GUESS_BASE) + _f(parsed * _f(GUESS_PARSED))), _f(GUESS_BASE)), _f(GUESS_MOST)))


def choose(candidates: DataFrame, embeddings: DataFrame | None = None, base: float = SOURCE_CONFIDENCE["Tmdb"]) -> DataFrame:
    """(id, c_id, score, embedding, confidence): the candidate to take for each item.

    candidates: id, c_id, score and rank (from 1, the best score first).  embeddings: (id, c_id, embedding), a missing one counts 0.
    The greatest sum of score and 0.12 of the embedding wins, of equal ones the last in rank.  An only candidate keeps the base
    confidence; others are raised by their score.  Combined maxima, no window.
    """
    rated = candidates.select("id", "c_id", _f(F.col("score")).alias("score"), "rank")
    rated = rated.join(embeddings.select("id", "c_id", _f(F.col("embedding")).alias("embedding")), ["id", "c_id"], "left") if embeddings is not None else rated.withColumn("embedding", F.lit(None).cast("float"))
    known = F.coalesce("embedding", _f(0.0))
    total = _f(F.col("score") + _f(known * _f(EMBEDDING_WEIGHT)))
    best = rated.groupBy("id").agg(F.max(F.struct(total.alias("total"), "rank", "c_id", "score", "embedding")).alias("m"), F.count("*").alias("n"))
    best = best.select("id", "m.c_id", "m.score", "m.embedding", "n")
    raised = _f(_f(_f(CHOICE_BASE) + _f(F.col("score") * _f(CHOICE_SCORE))) + _f(known * _f(CHOICE_EMBEDDING)))
    return best.select("id", "c_id", "score", "embedding", F.when(F.col("n") == 1, _f(base)).otherwise(F.greatest(_f(base), F.least(F.greatest(raised, _f(CHOICE_BASE)), _f(CHOICE_MOST)))).alias("confidence"))


def with_episodes(series: DataFrame, episodes: DataFrame) -> DataFrame:
    """Series (id, c_id, season, episode, confidence) with the episode_name of an episode table (series_id, season, episode, episode_name).

    Where an episode is found, the confidence is 0.95 at least.  Items without a season, an episode or a match keep their row; of
    several entries for one episode the smallest name counts.
    """
    named = episodes.groupBy(F.col("series_id").alias("c_id"), "season", "episode").agg(F.min("episode_name").alias("episode_name"), F.lit(True).alias("met"))
    found = series.join(named, ["c_id", "season", "episode"], "left")
    return found.select("id", "c_id", "season", "episode", "episode_name", F.when(F.col("met"), F.greatest("confidence", _f(EPISODE_CONFIDENCE))).otherwise(F.col("confidence")).alias("confidence"))


def first_hits(questions: DataFrame, catalogue: DataFrame, on: list[str]) -> DataFrame:
    """The catalogue's columns for each item's first question (id, pos and the columns `on`) that meets an entry; of several entries the
    smallest c_id counts.  Texts are compared in their lookup form, in any case; questions with an empty or null part meet none."""
    form = lambda df: df.withColumns({f"__{c}": titles.match_form(F.col(c)) for c in on}).filter(" and ".join(f"__{c} <> ''" for c in on))
    rest = [c for c in catalogue.columns if c not in ("c_id", *on)]
    entries = form(catalogue).groupBy(*[f"__{c}" for c in on]).agg(F.min(F.struct("c_id", *rest)).alias("e"))
    met = form(questions).join(entries, [f"__{c}" for c in on])
    return met.groupBy("id").agg(F.min(F.struct("pos", "e")).alias("m")).select("id", "m.pos", "m.e.*")
