"""The best representative of each group of duplicates.

`representatives` chooses the kept item and the values of the merged record by fixed ladders of
preferences, as the test data defines them; all are map-side combined maxima, so a group of any size costs
one row per input partition.

`truth` is the latent two-sided quality model for what no ladder decides: each source has a sensitivity
(how often it states what is true) and a specificity (how often it leaves out what is false), both
inferred by expectation-maximisation from the claims themselves.  Any number of values of a field may be
judged true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import cut


#: Sources whose quality is broadcast, at most (about a megabyte).
FEW_SOURCES = 10_000


def known(number: Column) -> Column:
    """NaN as null."""
    number = number.cast("double")
    return F.when(~F.isnan(number), number)


def strategy(text: Column) -> Column:
    """The name of a keep strategy, however spelled: letters in lower case."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z]", ""))


def valid_items(items: DataFrame) -> DataFrame:
    """The row with the latest decided_at of each content_id and item_index; null times count as earliest.

    Of rows decided at the same time, the greatest by keep mark, scores and then the other columns counts.  Rows
    without a content_id or item_index are no items.
    """
    rest = [F.col(c) for c in ("quality_score", "metadata_confidence", "is_keep") if c in items.columns]
    row = F.struct(F.coalesce(F.unix_micros(F.col("decided_at").cast("timestamp")), F.lit(-(2**62))).alias("at"), *rest)
    return items.filter("content_id is not null and item_index is not null").groupBy("content_id", "item_index").agg(F.max(row).alias("r")).select("content_id", "item_index", "r.*").drop("at")


def representatives(items: DataFrame, groups: DataFrame, files: DataFrame, fields: list[str], values: bool = False) -> DataFrame:
    """(content_id, field, item_index[, value]): the item kept (field `record`) and the item whose value each field takes.

    items: content_id, item_index, quality_score, metadata_confidence, is_keep.  groups: content_id, strategy.
    files: item_index, file_size, mtime and the fields; repeated deliveries of a file are the same row.  Null, NaN and
    missing values rank lowest, remaining ties go to the greater item_index.
    record: `highestquality` by quality_score, metadata_confidence, file_size; `newest` by mtime; `largest` by file_size;
    `manual` the item that is marked, if it is one only.  Other and null strategies keep none.
    Fields: greatest metadata_confidence, then mtime, among items with a value that is neither null nor blank.
    Groups without items and fields without values have no row.  values: adds the value, as text.
    One join and one aggregation for all fields; each group keeps one running maximum per field and partition.
    """
    low, first = F.lit(float("-inf")), F.lit(-(2**62))
    rank = lambda c: F.coalesce(known(F.col(c)), low)
    time, size = F.coalesce(F.unix_micros(F.col("mtime").cast("timestamp")), first), F.coalesce(F.col("file_size"), first)
    some = {f: F.regexp_replace(F.col(f).cast("string"), r"[\p{Z}\s]+", "") != "" for f in fields}
    once = files.groupBy("item_index").agg(*[F.max(c).alias(c) for c in files.columns if c != "item_index"])
    joined = items.join(once, "item_index", "left")
    ladders = {
        "quality": F.struct(rank("quality_score"), rank("metadata_confidence"), size, "item_index"),
        "newest": F.struct(time, "item_index"),
        "largest": F.struct(size, "item_index"),
        "marked": F.when(F.col("is_keep"), F.struct("item_index")),
    } | {f"f_{f}": F.when(some[f], F.struct(rank("metadata_confidence"), time, "item_index", *([F.col(f).cast("string").alias("value")] if values else []))) for f in fields}
    best = joined.groupBy("content_id").agg(F.count_if("is_keep").alias("marks"), *[F.max(x).alias(name) for name, x in ladders.items()]).join(groups, "content_id", "left")
    by = lambda name: F.col(name)["item_index"]
    choice = F.when(F.col("strategy") == "highestquality", by("quality")).when(F.col("strategy") == "newest", by("newest")).when(F.col("strategy") == "largest", by("largest")).when((F.col("strategy") == "manual") & (F.col("marks") == 1), by("marked"))
    none = [F.lit(None).cast("string").alias("value")] if values else []
    rows = [F.struct(F.lit("record").alias("field"), choice.alias("item_index"), *none)] + [F.struct(F.lit(f).alias("field"), by(f"f_{f}").alias("item_index"), *([F.col(f"f_{f}")["value"].alias("value")] if values else [])) for f in fields]
    return best.select("content_id", F.explode(F.array(*rows)).alias("r")).select("content_id", "r.*").filter("item_index is not null")


def truth(claims: DataFrame, rounds: int = 8, prior_true: tuple[float, float] = (4.0, 6.0), sensitivity: tuple[float, float] = (8.0, 2.0), specificity: tuple[float, float] = (9.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """Judges the values of fields by a two-sided model of source quality.

    claims: (entity, field, value, source), any of them repeated; rows with a null entity, field, value or source are
    no claims.  A source that claims some value of a field, but not a given one, denies that one.  The priors are
    pseudo-counts (for, against): of a value being true, of a source stating a true value, of it leaving out a false one.
    Returns (entity, field, value, probability, stated, denied) for every claimed value, and the sources' quality
    (source, sensitivity, specificity).  All values with a probability over one half may be kept.

    The observations are written once to a checkpoint, parted by value, and the rounds read that.  Sources are counted first: up to
    FEW_SOURCES, their quality is broadcast and no round shuffles by source; with more it is joined.  A round shuffles one partial sum per
    source and partition.
    """
    told = claims.filter("entity is not null and field is not null and value is not null and source is not null").select("entity", "field", "value", "source").distinct()
    speakers = told.select("entity", "field", "source").distinct()
    values = told.select("entity", "field", "value").distinct()
    seen = values.join(speakers, ["entity", "field"]).join(told.withColumn("states", F.lit(True)), ["entity", "field", "value", "source"], "left").withColumn("states", F.coalesce("states", F.lit(False)))
    seen = cut(seen)
    share = prior_true[0] / sum(prior_true)
    sources = seen.select("source").distinct()
    few = sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    quality = sources.select("source", F.lit(sensitivity[0] / sum(sensitivity)).alias("sensitivity"), F.lit(specificity[0] / sum(specificity)).alias("specificity"))
    for i in range(rounds + 1):
        p_true = F.when(F.col("states"), F.col("sensitivity")).otherwise(1 - F.col("sensitivity"))
        p_false = F.when(F.col("states"), 1 - F.col("specificity")).otherwise(F.col("specificity"))
        judged = seen.join(F.broadcast(quality) if few else quality, "source").groupBy("entity", "field", "value").agg(F.sum(F.log(p_true) - F.log(p_false)).alias("odds"), F.sum(F.col("states").cast("int")).alias("stated"), F.sum((~F.col("states")).cast("int")).alias("denied"))
        judged = judged.select("entity", "field", "value", (1 / (1 + F.exp(-(F.col("odds") + F.log(F.lit(share / (1 - share))))))).alias("probability"), "stated", "denied")
        if i == rounds:
            return judged, quality
        both = seen.join(judged.select("entity", "field", "value", "probability"), ["entity", "field", "value"])
        p, s = F.col("probability"), F.col("states").cast("double")
        counted = both.groupBy("source").agg(F.sum(p * s).alias("tp"), F.sum(p).alias("t"), F.sum((1 - p) * (1 - s)).alias("tn"), F.sum(1 - p).alias("f"))
        quality = cut(counted.select("source", ((F.col("tp") + sensitivity[0]) / (F.col("t") + sum(sensitivity))).alias("sensitivity"), ((F.col("tn") + specificity[0]) / (F.col("f") + sum(specificity))).alias("specificity")))
    raise AssertionError


def agreement(chosen: DataFrame, judged: DataFrame) -> DataFrame:
    """(field, groups, same, other, only_chosen, only_judged): how often a choice is the value that the model finds likeliest.

    chosen: (entity, field, value), one value each.  judged: (entity, field, value, probability); of equal probabilities the
    choice counts as the likeliest if it is one of them.
    """
    likely = judged.groupBy("entity", "field").agg(F.max("probability").alias("best"))
    held = chosen.select("entity", "field", F.trim("value").alias("value")).join(judged.select("entity", "field", "value", "probability"), ["entity", "field", "value"], "left")
    both = held.join(likely, ["entity", "field"], "full")
    has, told = F.col("value").isNotNull(), F.col("best").isNotNull()
    same = F.coalesce(F.col("probability") >= F.col("best") - 1e-9, F.lit(False))
    return both.groupBy("field").agg(F.count("*").alias("groups"), F.count_if(same).alias("same"), F.count_if(has & told & ~same).alias("other"), F.count_if(has & ~told).alias("only_chosen"), F.count_if(~has & told).alias("only_judged"))
