"""Mixing of sources to target weights by a Pfair schedule.

The documents of a source, in a fixed random order, form a stream that may be repeated up to its cap; it is cut into
blocks of equal size.  Block j of a source with weight w may come from slot floor(j / w) on and must come before
slot ceil((j + 1) / w); taking the block with the earliest deadline in every slot meets all of them, so at
any point each source is less than one block off its share.  A source's weight is the exact fraction of its blocks among all.

A mix of many blocks is cut into frames.  The blocks that don't divide evenly among the frames are spread over them by a
schedule of their own, and each frame is scheduled by what it holds; frames that hold the same are computed once, all of them at
once in arrays.  As frames add to the deviation, blocks are a quarter as large as the deviation that is asked for.  There are at most
MOST_FRAMES frames, so the schedule that is sent has a bound: two numbers for each frame and source, two bytes for each slot of each kind of frame.

Positions in a stream are prefix sums in two levels: within hash buckets of bounded size, and over the sums of
the buckets.  So a source that holds a third of all documents is no longer in one task than any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.session import cut

#: Blocks in a frame, about, and frames in a mix at most.
FRAME = 2_048
MOST_FRAMES = 65_536
#: Blocks that a schedule may be off at most; three at the edges and inside of frames.
PARTS = 4
BUCKET_ITEMS = 50_000


def schedule(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period: sum of weights slots, a source having as many as its weight.

    In every slot, of the blocks released, the one with the earliest deadline is taken, of equal ones the first source by name.
    """
    period = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    live = {s: w for s, w in weights.items() if w}
    release = {s: 0 for s in live}
    deadline = {s: -(-period // w) for s, w in live.items()}
    for t in range(period):
        _, s = min((deadline[s], s) for s in live if release[s] <= t)
        slots[s].append(t)
        n, w = len(slots[s]), live[s]
        if n == w:
            del live[s]
        else:
            release[s], deadline[s] = n * period // w, -(-(n + 1) * period // w)
    return slots


def schedules(held: np.ndarray) -> np.ndarray:
    """The source in each slot of each period, -1 behind its end: schedule() for many at once.

    held: periods by sources, in the order of their names; how many slots a source has.
    """
    never = np.iinfo(np.int64).max
    period = held.sum(1)
    rows, placed = np.arange(len(held)), np.zeros(held.shape, np.int64)
    release, deadline = np.zeros(held.shape, np.int64), np.where(held > 0, -(-period[:, None] // np.maximum(held, 1)), never)
    out = np.full((len(held), int(period.max(initial=0))), -1, np.int16)
    for t in range(out.shape[1]):
        ready = np.where(release <= t, deadline, never)
        s = ready.argmin(1)
        out[:, t] = np.where(ready[rows, s] < never, s, -1)
        n = placed[rows, s] = placed[rows, s] + 1
        w = np.maximum(held[rows, s], 1)
        release[rows, s], deadline[rows, s] = n * period // w, np.where(n < held[rows, s], -(-(n + 1) * period // w), never)
    return out


@dataclass(frozen=True)
class Frames:
    """The schedule of all blocks.  blocks: how many each source has."""

    blocks: dict[str, int]
    size: int = FRAME

    def made(self) -> None:
        """Computes the schedule, so that it is sent and not computed again."""
        if self.blocks:
            _ = self._made

    @cached_property
    def _made(self) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
        n, names = max(1, -(-sum(self.blocks.values()) // self.size)), sorted(self.blocks)
        extra = schedule({s: self.blocks[s] % n for s in names})
        total = sum(map(len, extra.values()))
        held = {s: np.full(n, self.blocks[s] // n, np.int64) + np.bincount(np.array(extra[s], np.int64) * n // max(total, 1), minlength=n) for s in names}
        first = {s: np.concatenate([[0], np.cumsum(x)]) for s, x in held.items()}
        what, kind = np.unique(np.stack([held[s] for s in names], axis=1), axis=0, return_inverse=True)
        placed = schedules(what)
        start = np.concatenate([[0], np.cumsum(sum(held.values()))])[:-1]
        flat = {s: np.nonzero(placed == i)[1].astype(np.uint16 if placed.shape[1] <= 1 << 16 else np.int64) for i, s in enumerate(names)}
        at = {s: np.concatenate([[0], np.cumsum(what[:, i])]) for i, s in enumerate(names)}
        return first, start, kind.ravel(), flat, at

    def slots(self, source: str, number: np.ndarray) -> np.ndarray:
        """The slots of some blocks of a source."""
        first, start, kind, flat, at = self._made
        frame = np.searchsorted(first[source], number, side="right") - 1
        return start[frame] + flat[source][at[source][kind[frame]] + number - first[source][frame]]


@dataclass(frozen=True)
class Plan:
    """quota: tokens of each source."""

    quota: dict[str, float]


def plan(available: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: float | None = None) -> Plan:
    """How much of each source to take.

    available: tokens of each source.  Without a total, it is the largest at which every source that has documents reaches
    its share.  With one, sources that can't fill their share give all they may, and the others take over the rest in
    proportion.  Sources without tokens, share or repeats are left out, and the shares of the others are scaled up.
    """
    most = {s: available.get(s, 0) * max(repeats[s] or 0, 0) for s in shares}
    live = sorted(s for s, x in shares.items() if x and x > 0 and most[s] > 0)
    if not live:
        return Plan({})
    scale = sum(shares[s] for s in live)
    quota: dict[str, float] = {}
    if total is None:
        total = min(most[s] * scale / shares[s] for s in live)
        quota = {s: total * shares[s] / scale for s in live}
    else:
        rest, open_ = float(total), list(live)
        while open_ and rest > 0:
            part = sum(shares[s] for s in open_)
            full = [s for s in open_ if rest * shares[s] / part >= most[s]]
            for s in full or open_:
                quota[s] = float(most[s]) if full else rest * shares[s] / part
            if not full:
                break
            rest -= sum(most[s] for s in full)
            open_ = [s for s in open_ if s not in full]
    return Plan(quota)


def streamed(sized: DataFrame, n_items: int, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """(source, key, tokens, at): where each document begins in the stream of its source."""
    buckets = max(1, -(-n_items // bucket_items))
    rows = sized.withColumn("h", F.xxhash64("key", F.lit(11))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = sums.withColumn("base", F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).drop("n")
    inside = F.sum("tokens").over(W.partitionBy("source", "bucket").orderBy("h", "key").rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens")
    return rows.withColumn("inside", inside).join(before, ["source", "bucket"]).select("source", "key", "tokens", (F.col("base") + F.col("inside")).alias("at"))


def scheduled(rows: DataFrame, frames: Frames, part: int) -> DataFrame:
    """Rows (source, place, ...) with the slot of the block, of `part` tokens, that each begins in."""
    import pyarrow as pa

    frames.made()
    sent = rows.sparkSession.sparkContext.broadcast(frames)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("source").dictionary_encode()
            code, number = coded.indices.to_numpy(zero_copy_only=False), batch.column("place").to_numpy(zero_copy_only=False) // part
            slot = np.zeros(len(number), np.int64)
            for i, s in enumerate(coded.dictionary.to_pylist()):
                slot[code == i] = sent.value.slots(s, number[code == i])
            yield pa.RecordBatch.from_arrays([pa.array(slot), *batch.columns], names=["slot", *batch.schema.names])

    return rows.mapInArrow(run, "slot bigint, " + ", ".join(f"`{n}` {t}" for n, t in rows.dtypes))


def mix(spark: SparkSession, sized: DataFrame, targets: DataFrame, block: int = 4096, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(slot, source, place, key, copy, tokens) of the mix, and (source, target_share, reached_share, tokens, documents, most_copies, available, unused).

    available and unused: the tokens of a source's documents, each once, and those of documents that are not in the mix.

    sized: (key, source, tokens), keys unique; rows without a key, source or tokens take no part.  targets: (source,
    target_share, max_repeats), a small table; of sources named twice the first by share counts.  Read in the order of slot,
    source and place, the mix holds every source's share at any point.  A source's
    documents are all used as often as each other, give or take one.  Sources without documents are reported with 0.
    Documents are never split: the last one of a source is used if more than half of it is within the quota.  A source is
    off its share by less than a block and the longest document, as that begins in one block and may end in a later one.
    block: tokens; in a mix of more than FRAME * MOST_FRAMES / PARTS blocks, they are as much larger as it has more.
    """
    sized = cut(sized.filter("key is not null and source is not null and tokens > 0").select("key", "source", F.col("tokens").cast("bigint").alias("tokens")))
    wanted = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.filter("source is not null").orderBy(F.desc("target_share")).collect()[::-1]}
    found = {r["source"]: (r["n"], r["docs"]) for r in sized.filter(F.col("source").isin(list(wanted))).groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")).collect()}
    available = {s: n for s, (n, _) in found.items()}
    p = plan(available, {s: x for s, (x, _) in wanted.items()}, {s: r for s, (_, r) in wanted.items()}, total)
    rows = [(s, float(p.quota[s]), available[s]) for s in p.quota]
    table = spark.createDataFrame(rows, "source string, quota double, available bigint")
    streams = streamed(sized.filter(F.col("source").isin(list(p.quota))), sum(d for _, d in found.values())).join(F.broadcast(table), "source")
    middle = F.col("at") + F.col("tokens") / 2
    last = F.floor((F.col("quota") - middle) / F.col("available")).cast("int")
    used = streams.filter(middle <= F.col("quota")).select("*", F.explode(F.sequence(F.lit(0), last)).alias("copy"))
    place = F.col("at") + F.col("copy") * F.col("available")
    part = max(block // PARTS, 1, int(-(-sum(p.quota.values()) // (FRAME * MOST_FRAMES))))
    mixed = scheduled(used.select("source", place.alias("place"), "key", "copy", "tokens"), Frames({s: max(1, int(-(-q // part))) for s, q in p.quota.items()}), part)
    reached = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_distinct("key").alias("documents"), F.sum(F.when(F.col("copy") == 0, F.col("tokens"))).alias("once"), (F.max("copy") + 1).alias("most_copies"))
    aims = spark.createDataFrame([(s, float(x), available.get(s, 0)) for s, (x, _) in wanted.items()], "source string, target_share double, available bigint")
    whole = F.sum("tokens").over(W.partitionBy(F.lit(1)))  # over the rows of targets
    shares = aims.join(reached, "source", "left").select("source", "target_share", F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "available", (F.col("available") - F.coalesce("once", F.lit(0))).alias("unused"))
    return mixed, shares
