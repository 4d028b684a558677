"""Filling containers of fixed capacity by harmonic classes.

Items are parted into classes by reciprocal capacity: class k holds the sizes in (C / (k + 1), C / k], and a
bin of class k is filled with exactly k of them, so whole bins need no knowledge of other items.  Pieces are spread over
shards of bounded size by a hash of their key and place, and every shard is packed on its own: one shuffle of (key, size), no
coordination, and no task that grows with the input, nor with the length of an item.

Before a class opens bins of its own, its items are put into the space that bins of larger items left over; so
only the last bins of a shard stay loosely filled.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import small

SHARD_ITEMS = 50_000


def harmonic(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of every item; sizes are between 1 and the capacity.  Equal sizes are taken in their order.

    Classes go from large items to small ones.  Space left in bins is kept sorted, and an item takes the smallest
    space that holds it.
    """
    bins = np.full(len(sizes), -1, np.int64)
    order = np.argsort(-sizes, kind="stable")
    classes = capacity // sizes[order]
    space: list[tuple[int, int]] = []
    made, at = 0, 0
    while at < len(order):
        k = int(classes[at])
        upto = int(np.searchsorted(classes, k, side="right"))
        rest = []
        for i in order[at:upto].tolist():
            size = int(sizes[i])
            found = bisect_left(space, (size, -1))
            if found == len(space):
                rest.append(i)
                continue
            left, b = space.pop(found)
            bins[i] = b
            if left > size:
                insort(space, (left - size, b))
        for n in range(0, len(rest), k):
            group = rest[n : n + k]
            bins[group] = made
            if left := capacity - int(sizes[group].sum()):
                insort(space, (left, made))
            made += 1
        at = upto
    return bins


def pieces(items: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity, key, part, start, size): items cut into pieces of the capacity only where they exceed it.

    items: (key, tokenizer, tokens).  specs: (spec_id, tokenizer, capacity_tokens), broadcast if it is small; specs without a positive
    capacity hold nothing.  Items without tokens take no space and have no piece.
    """
    sized = items.filter("tokens > 0 and key is not null").join(small(specs.filter("capacity_tokens > 0").distinct()), "tokenizer")
    whole = F.sequence(F.lit(0), ((F.col("tokens") - 1) / F.col("capacity_tokens")).cast("int"))
    cut = sized.select("spec_id", F.col("capacity_tokens").cast("bigint").alias("capacity"), "key", "tokens", F.explode(whole).alias("part"))
    start = F.col("part").cast("bigint") * F.col("capacity")
    return cut.select("spec_id", "capacity", "key", "part", start.alias("start"), F.least(F.col("capacity"), F.col("tokens") - start).alias("size"))


def most_pieces(items: DataFrame, specs: DataFrame) -> int:
    """The pieces of the spec that has the most."""
    sized = items.filter("tokens > 0 and key is not null").join(small(specs.filter("capacity_tokens > 0").select("spec_id", "tokenizer", "capacity_tokens").distinct()), "tokenizer")
    return sized.groupBy("spec_id").agg(F.sum(F.ceil(F.col("tokens") / F.col("capacity_tokens"))).alias("n")).agg(F.max("n")).first()[0] or 0


def pack(items: DataFrame, specs: DataFrame, n_items: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(spec_id, bin_id, key, part, start, size): every piece with the bin it is in.

    n_items: how many pieces there are for a spec, or about; it sets the number of shards, and with it how many bins stay loose.
    No bin exceeds its capacity.  Bins are numbered by shard, so ids are unique within a spec and have gaps.
    """
    import pandas as pd

    shards = max(1, -(-n_items // shard_items))
    rows = pieces(items, specs).withColumn("shard", F.pmod(F.xxhash64("key", "part"), F.lit(shards)))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "part"], kind="stable").reset_index(drop=True)
        bins = harmonic(part["size"].to_numpy(np.int64), int(part["capacity"].iloc[0])) if len(part) else np.zeros(0, np.int64)
        return part.assign(bin_id=part["shard"].astype("int64") * (1 << 32) + bins)[["spec_id", "bin_id", "key", "part", "start", "size"]]

    key = dict(rows.dtypes)["key"]
    return rows.groupBy("spec_id", "shard").applyInPandas(fill, f"spec_id int, bin_id bigint, key {key}, part int, start bigint, size bigint")


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity_tokens, bins, tokens, used): how full the bins of each spec are."""
    by_bin = packed.groupBy("spec_id", "bin_id").agg(F.sum("size").alias("size"))
    total = by_bin.groupBy("spec_id").agg(F.count("*").alias("bins"), F.sum("size").alias("tokens"))
    return total.join(specs.select("spec_id", "capacity_tokens").distinct(), "spec_id").withColumn("used", F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")))
