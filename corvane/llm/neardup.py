"""Near-duplicate records: an exact set-similarity self-join by binary tries of word sketches.

A record is the set of its words.  Sets of similarity t (common words divided by all words) differ in at
most (1 - t) / (1 + t) * (|A| + |B|) words.  Every word flips one bit of a record's sketch, so the sketches of two
records differ in at most as many bits as their sets differ in words: the Hamming distance of sketches
never exceeds that budget for a similar pair, and a trie join under the budget loses none.

1. Records with equal sets form a class; one of each class goes on.
2. Words are ordered from rare to frequent.  Similar sets share one of their first |A| - ceil(t |A|) + 1 words,
   which routes them to the trie of that word.  A word in very many sets routes by pairs of words instead: the
   second common word lies among one more of the first words.  Pairs in very many sets route by three words, and so on, as
   counted over all sets, so no trie holds more than `hot` sets but those too small to share another word.
3. In each trie, node pairs are traversed together from the root, adding up the bits in which they differ, and
   pruned once the budget is exceeded.  All tries of a task are traversed at once, one bit a step, in arrays;
   node pairs of few records are compared outright.
4. The pairs left, each once, are confirmed on the words themselves.

The words counted as frequent are those in more than total / 200 000 sets, so they are at most 200 000 whatever the
number of records, as are the chains of words counted as hot; they are all that is broadcast.  Joins sort both sides:
the sizes estimated for arrays and for what Python returns are far too low, and the driver would get classes and
candidates as broadcasts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import cut

FREQUENT_WORDS = 200_000
LEAF_PAIRS = 64
SLICE = 1 << 20


def words_of(*texts: Column) -> Column:
    """The distinct lower-cased runs of letters and digits in the texts together; null counts as empty."""
    return F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", *texts)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def _sorted(df: DataFrame) -> DataFrame:
    """df marked for a join that sorts both sides, whatever size is estimated for it; never broadcast."""
    return df.hint("merge")


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for every n in counts, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def chains(hashes: np.ndarray, starts: np.ndarray, t: float, keys: np.ndarray, counts: np.ndarray, hot: int, deeper: list[np.ndarray], most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, key, routes) of the chains of one word, of two words, and so on; routes: whether the row goes to the trie of that key.

    hashes: the words of all rows, starts: where each row begins (and the end).  keys, counts: the frequent words.  deeper:
    sorted keys of the hot chains of two words, of three and so on; hot chains go on, others end.  most: the longest chains to make.

    Where d words are common, the i-th of them in order lies among the first n - need + i words of a set, as at least need - i follow.  A row
    that needs no more than d words may have a partner by those alone, so it goes to a hot chain's trie, too.
    """
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
    freq = np.where(keys[at] == hashes, counts[at], 0) if len(keys) else np.zeros(len(hashes), np.int64)
    order = np.lexsort((hashes, freq, row))
    h, f, begin = hashes[order], freq[order], starts[:-1]
    need = np.ceil(t * sizes - 1e-9).astype(np.int64)
    last = np.flatnonzero(_ranges(sizes) < (sizes - need + 1)[row])  # where a chain's last word stands
    key, is_hot = h[last], f[last] >= hot
    d = 1
    while len(last):
        owner = row[last]
        yield owner, key, ~is_hot | (need[owner] <= d)
        if d == most or not is_hot.any():
            return
        last, key, owner = last[is_hot], key[is_hot], owner[is_hot]
        later = np.maximum(sizes[owner] - np.maximum(need[owner], d + 1) + d - (last - begin[owner]), 0)
        following = np.repeat(last, later) + 1 + _ranges(later)
        with np.errstate(over="ignore"):
            key = np.repeat(key, later) * np.int64(-7046029254386353131) ^ (h[following] + np.int64(1442695040888963407))
        last, d = following, d + 1
        known = deeper[d - 2] if d - 2 < len(deeper) else key[:0]
        is_hot = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key if len(known) else np.zeros(len(key), bool)


def route(hashes: np.ndarray, starts: np.ndarray, t: float, keys: np.ndarray, counts: np.ndarray, hot: int, deeper: list[np.ndarray] = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """(row, key) of the tries that each set belongs to; see chains()."""
    parts = [(r[m], k[m]) for r, k, m in chains(hashes, starts, t, keys, counts, hot, deeper)] or [(np.zeros(0, np.int64), hashes[:0])]
    return np.concatenate([r for r, _ in parts]), np.concatenate([k for _, k in parts])


def sketches(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits a row: the parity of the words that fall on each bit.  Rows must not be empty."""
    bits = np.left_shift(np.uint64(1), (hashes.view(np.uint64) >> np.uint64(58)))
    return np.bitwise_xor.reduceat(bits, starts[:-1]) if len(starts) > 1 else bits[:0]


def trie_join(key: np.ndarray, sketch: np.ndarray, size: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within one key whose sketches are within the budget and whose sizes allow similarity t."""
    order = np.lexsort((sketch, key))
    key, sketch, size = key[order], sketch[order], size[order].astype(np.int64)
    n, share = len(key), (1 - t) / (1 + t)
    if n < 2:
        return
    lo = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    hi = np.concatenate([lo[1:], [n]])
    most = np.floor(2 * share * np.maximum.reduceat(size, lo) + 1e-9).astype(np.int64)
    big = hi - lo > 1
    al = bl = lo[big]
    ah = bh = hi[big]
    budget, err = most[big], np.zeros(big.sum(), np.int64)
    for bit in range(63, -2, -1):
        same = al == bl
        work = (ah - al) * (bh - bl)
        leaf = (work <= LEAF_PAIRS) | (bit < 0)
        for a, b in _pairs(al[leaf], ah[leaf], bl[leaf], bh[leaf], same[leaf]):
            near = np.bitwise_count(sketch[a] ^ sketch[b]) <= share * (size[a] + size[b]) + 1e-9
            near &= np.minimum(size[a], size[b]) >= t * np.maximum(size[a], size[b]) - 1e-9
            if near.any():
                yield order[a[near]], order[b[near]]
        if leaf.all():
            return
        al, ah, bl, bh, budget, err, same = (x[~leaf] for x in (al, ah, bl, bh, budget, err, same))
        ones = np.concatenate([[0], np.cumsum((sketch >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])  # zeros stand before ones
        cross = ~same
        parts = [(al, am, bl, bm, budget, err), (am, ah, bm, bh, budget, err), (al, am, bm, bh, budget, err + 1), tuple(x[cross] for x in (am, ah, bl, bm, budget, err + 1))]
        al, ah, bl, bh, budget, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        alive = (ah > al) & (bh > bl) & (err <= budget) & ~((al == bl) & (ah - al < 2) & (bh - bl < 2) & (ah == bh))
        al, ah, bl, bh, budget, err = (x[alive] for x in (al, ah, bl, bh, budget, err))


def _pairs(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray, same: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of node pairs, in slices; of a node with itself each pair once."""
    rows = ah - al
    node = np.repeat(np.arange(len(al)), rows)
    left = al[node] + _ranges(rows)
    begin = np.where(same[node], left + 1, bl[node])
    width = np.maximum(bh[node] - begin, 0)
    ends = np.cumsum(width)
    done = 0
    while done < len(width):
        upto = max(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SLICE, side="right")), done + 1)
        w = width[done:upto]
        yield np.repeat(left[done:upto], w), np.repeat(begin[done:upto], w) + _ranges(w)
        done = upto


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow array of lists, and where each list begins (and the end)."""
    starts = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), starts - starts[0]


def _hot_chains(hashed: DataFrame, t: float, keys: np.ndarray, counts: np.ndarray, hot: int) -> list[np.ndarray]:
    """The sorted keys of the chains of two words, of three and so on that are in `hot` sets at least; FREQUENT_WORDS of a length at most."""
    import pyarrow as pa

    deeper: list[np.ndarray] = []
    while True:
        sent = hashed.sparkSession.sparkContext.broadcast((keys, counts, deeper))
        length = len(deeper) + 2

        def count(batches: Iterator[pa.RecordBatch], sent=sent, length=length) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    every = list(chains(*_flat(batch.column(0)), t, *sent.value[:2], hot, sent.value[2], length))
                    k, n = np.unique(every[-1][1], return_counts=True) if len(every) == length else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["k", "n"])

        counted = cut(hashed.select("h").mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")))
        least = max(hot, -(-(counted.agg(F.sum("n")).first()[0] or 0) // FREQUENT_WORDS))
        found = counted.filter(F.col("n") >= least).select("k").toArrow()["k"].to_numpy()
        sent.destroy()
        if not len(found):
            return deeper
        deeper = [*deeper, np.sort(found)]


def similar_sets(sets: DataFrame, key: str, words: str, t: float, hot: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """The sets (key, words) whose similarity is at least t: (links, members).

    members: (id, class_id) of every record with words, class_id being the smallest key with the same set.
    links: (a, b, common, total) between class ids, a < b, each once.  Together they hold every similar pair; records
    with equal sets are similar and are not listed as links.  Records without a key or without words have no partner.
    Repeated rows of one key count once.  hot: a word in so many sets routes by pairs, a pair in so many by three words, and so on.
    """
    import pyarrow as pa

    rows = sets.select(F.col(f"`{key}`").alias("id"), F.col(f"`{words}`").alias("words")).filter("id is not null and size(words) > 0")
    rows = rows.withColumn("digest", F.unhex(F.md5(F.concat_ws("\x1f", F.array_sort("words")).cast("binary"))))
    classes = cut(rows.groupBy("digest").agg(F.min("id").alias("class_id"), F.max("id").alias("last"), F.first("words").alias("words")))
    total = classes.agg(F.sum(F.size("words"))).first()[0] or 0
    least = max(16, -(-total // FREQUENT_WORDS))
    counted = classes.select(F.explode(F.transform("words", lambda w: F.xxhash64(w))).alias("h")).groupBy("h").count().filter(F.col("count") >= least)
    found = counted.toArrow().sort_by("h")
    keys, counts = found["h"].to_numpy(), found["count"].to_numpy()
    hashed = classes.select(F.col("class_id").cast("bigint").alias("id"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    deeper = _hot_chains(hashed, t, keys, counts, hot) if len(counts) and counts.max() >= hot else []
    frequent = classes.sparkSession.sparkContext.broadcast((keys, counts, deeper))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, starts = _flat(batch.column(1))
            row, out = route(hashes, starts, t, *frequent.value[:2], hot, frequent.value[2])
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(ids[row]), pa.array(np.diff(starts)[row].astype(np.int32)), pa.array(sketches(hashes, starts)[row].view(np.int64))], names=["k", "id", "n", "sketch"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            k, ids, n, sketch = (np.concatenate(x) for x in zip(*parts, strict=True))
            for a, b in trie_join(k, sketch.view(np.uint64), n, t):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            tail = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on in the next batch
            if tail or held and held[-1][0][-1] != cols[0][0]:
                held.append([c[:tail] for c in cols])
                if sum(len(x[0]) for x in held) and (len(held) > 1 or tail):
                    whole = [x for x in held if len(x[0])]
                    yield from out(whole)
                held = [[c[tail:] for c in cols]]
            else:
                held.append(cols)
        if held:
            yield from out(held)

    tries = hashed.mapInArrow(routed, "k bigint, id bigint, n int, sketch bigint").repartition("k").sortWithinPartitions("k")
    candidates = tries.mapInArrow(joined, "a bigint, b bigint").distinct()
    one, two = classes.select(F.col("class_id").alias("a"), F.col("words").alias("wa")), classes.select(F.col("class_id").alias("b"), F.col("words").alias("wb"))
    common = F.size(F.array_intersect("wa", "wb"))
    links = candidates.join(_sorted(one), "a").join(_sorted(two), "b").select("a", "b", common.alias("common"), (F.size("wa") + F.size("wb") - common).alias("total")).filter(F.col("common") / F.col("total") >= t)
    several = classes.filter("last > class_id").select("digest", "class_id")
    members = rows.select("id", "digest").join(_sorted(several), "digest", "left").select("id", F.coalesce("class_id", "id").alias("class_id")).distinct()
    return links, members


def pairs_of(links: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of records (a, b), a < b: links between the members of classes, and pairs within a class."""
    shared = members.filter("id <> class_id")
    whole = shared.unionByName(shared.select(F.col("class_id").alias("id"), "class_id")).distinct()
    left = whole.select(F.col("class_id").alias("a"), F.col("id").alias("x"))
    right = whole.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    between = links.select("a", "b").join(_sorted(left), "a", "left").join(_sorted(right), "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    within = left.join(_sorted(right), F.col("a") == F.col("b")).filter("x < y").select("x", "y")
    return between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(within.select(F.col("x").alias("a"), F.col("y").alias("b"))).distinct()


def groups_of(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group_id, n_links): connected groups of records; group_id is the smallest class id, n_links counts links of the class.

    Labels are passed along links, and distances halved by pointer jumping, until no label changes; each round is checkpointed.
    """
    edges = links.select("a", "b")
    edges = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label"))
    label = cut(label)
    changed = 1
    while changed:
        near = edges.join(_sorted(label.select(F.col("node").alias("b"), "label")), "b").groupBy("a").agg(F.min("label").alias("low"))
        passed = label.join(_sorted(near.withColumnRenamed("a", "node")), "node").select("node", "label", F.least("label", "low").alias("low"))
        jumped = passed.join(_sorted(label.select(F.col("node").alias("low"), F.col("label").alias("far"))), "low", "left").select("node", "label", F.least("low", F.coalesce("far", "low")).alias("new"))
        jumped = cut(jumped)
        changed = jumped.filter("new <> label").limit(1).count()
        label = jumped.select("node", F.col("new").alias("label"))
    degree = edges.groupBy("a").agg(F.count("*").alias("n_links")).select(F.col("a").alias("class_id"), "n_links")
    named = members.join(_sorted(label.withColumnRenamed("node", "class_id")), "class_id", "left").join(_sorted(degree), "class_id", "left")
    return named.select("id", F.coalesce("label", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
