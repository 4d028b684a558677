"""Matching of entities across tables without a shared key: sorted neighbourhood over several composite keys.

Every distinct reading (title and year) of either table becomes a few sort keys: the title, the title from its
end, both of them behind the year, and the title without one of its words.  All readings are sorted by key over
the cluster and each left reading is compared with the right readings that stand next to it, on both sides, those of the
neighbouring partitions among them.  So the window is counted in readings of the other side, and the many spellings of a
popular title don't use it up.  Pairs are compared first by years and letter sketches in arrays, then by numbers and
edit distance.  The confidence weighs the similarities of title, year and kind of name.  Then each record on the left
takes its best match; `one_to_one` also gives each record on the right to one on the left, so that the total
confidence is the greatest.

A title held by a third of all rows is one reading, so no key is hot.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.neardup import groups_of
from corvane.llm.textform import match_key
from corvane.session import cut

# Words that mark an edition at the end of a title.
EDITION_WORDS = "director directors cut extended edition unrated uncut remastered theatrical special ultimate collectors imax repack proper rerip limited redux restored anniversary final internal criterion"
ARTICLES = {"the", "a", "an"}
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9"}
_MARKS = frozenset(EDITION_WORDS.split())
_WORDS = re.compile(r"[^\W_]+")
_PARENS = re.compile(r"^(.*?)\s*\(([^()]+)\)\s*$")
_SUBTITLE = re.compile(r"\s*:\s*|\s+[-–—]\s+")
_TYPO = re.compile(r"(?<=[^\W\d_])[,;'`](?=[^\W\d_])")


def words_of(title: str) -> list[str]:
    """The words of a title that tell films apart: no accents, articles at either end or edition marks; numerals as digits."""
    text = "".join(c for c in unicodedata.normalize("NFD", match_key(title) or "") if not "̀" <= c <= "ͯ")
    found = _WORDS.findall(_TYPO.sub("", text.replace("&", " and ").replace("director's", "directors")))
    while len(found) > 1 and found[-1] in _MARKS:
        found.pop()
    while len(found) > 1 and found[0] in ARTICLES:
        found.pop(0)
    while len(found) > 1 and found[-1] in ARTICLES:
        found.pop()
    if len(found) > 1 and found[-1] in ROMAN:
        found[-1] = ROMAN[found[-1]]
    return found


def names_of(title: str | None, subtitles: bool) -> dict[str, int]:
    """The names that a title gives, as words parted by spaces: 0 for a full one, 1 for one without its subtitle.

    A title `X (Y)` gives X and Y.  Null and titles without a word give none.
    """
    out: dict[str, int] = {}
    key = match_key(title) or ""
    parts = [title or ""]
    if m := _PARENS.match(key):
        parts += [m[1], m[2]]
    for part in parts:
        if name := " ".join(words_of(part)):
            out[name] = 0
    if subtitles:
        for part in parts[1:] or parts:
            main = _SUBTITLE.split(match_key(part) or "", maxsplit=1)
            if len(main) > 1 and (name := " ".join(words_of(main[0]))) and len(name) >= 4:
                out.setdefault(name, 1)
    return out


def sort_keys(name: str, year: int | None, spread: int) -> set[str]:
    """Composite sort keys of a reading; spread: how far its year may be off, 0 on one side of the comparison."""
    flat = name.replace(" ", "")
    at = f"{year:04d}" if year is not None else "~"
    keys = {f"1{flat}|{at}", f"2{flat[::-1]}|{at}"}
    for y in range(year - spread, year + spread + 1) if year is not None else []:
        keys |= {f"3{y:04d}{flat}", f"4{y:04d}{flat[::-1]}"}
    parts = name.split(" ")
    if len(parts) > 2:
        keys |= {f"5{''.join(parts[:i] + parts[i + 1:])}|{at}" for i in range(len(parts))}
    return keys


@lru_cache(maxsize=1 << 16)
def numbers_in(name: str) -> str:
    return " ".join(sorted(w for w in name.split(" ") if w.isdigit()))


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) between two texts, or most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    if most == 1:
        return 1 if len(a) == len(b) and (len(a) == 1 or len(a) == 2 and a == b[::-1]) else 2
    far, width = most + 1, len(b)
    before, last = [], [j if j <= most else far for j in range(width + 1)]
    for i, x in enumerate(a, 1):
        row = [far] * (width + 1)
        row[0] = least = i if i <= most else far
        for j in range(max(1, i - most), min(width, i + most) + 1):  # further off the diagonal lie more edits than that
            y = b[j - 1]
            d = last[j - 1] + (x != y)
            if last[j] < d:
                d = last[j] + 1
            if row[j - 1] < d:
                d = row[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < d:
                d = before[j - 2] + 1
            row[j] = d
            if d < least:
                least = d
        if least > most:
            return far
        before, last = last, row
    return min(last[-1], far)


def allowed(length: int) -> int:
    """Edits that two titles of one entity may differ by."""
    return min(3, int(0.15 * length))


def confidence(a: str, b: str, year_a: int | None, year_b: int | None, kind: int) -> float | None:
    """The weighted similarity of two readings, or None if they can't be of one entity.

    Titles weigh 0.6, years 0.3, the kind of name 0.1.  Numbers must be equal, years at most one apart; equal years allow two edits from nine letters on; a missing year
    counts as less alike, and a name without its subtitle needs both years.
    """
    if year_a is not None and year_b is not None:
        if abs(year_a - year_b) > 1:
            return None
        year = 1.0 if year_a == year_b else 0.8
    elif kind:
        return None
    else:
        year = 0.6
    if numbers_in(a) != numbers_in(b):
        return None
    x, y = a.replace(" ", ""), b.replace(" ", "")
    most = allowed(min(len(x), len(y)))
    if year == 1.0 and min(len(x), len(y)) >= 9:
        most = max(most, 2)
    d = distance(x, y, most)
    if d > most or kind and d > 1:
        return None
    return 0.6 * (1 - d / max(len(x), len(y), 1)) + 0.3 * year + 0.1 * (1 - 0.5 * kind)


def slim(a: str, b: str, year_a: int | None, year_b: int | None, kind: int) -> float | None:
    """The weighted similarity of two readings that are one only if no other is as near, or None.

    That is one edit in full names of four to six letters, two in those of seven or eight, of equal known years.
    """
    x, y = a.replace(" ", ""), b.replace(" ", "")
    short = min(len(x), len(y))
    if kind or year_a is None or year_a != year_b or not 4 <= short <= 8 or numbers_in(a) != numbers_in(b):
        return None
    most = 1 if short < 7 else 2
    d = distance(x, y, most)
    return None if d > most else 0.6 * (1 - d / max(len(x), len(y))) + 0.3 + 0.1


def _sketches(names: list[str]) -> np.ndarray:
    """Parity of the letters (low 32 bits) and of the pairs of letters (high 32 bits) of each name, without its spaces.

    An edit changes two letters at most (a replacement), and six pairs (a swap of neighbours, three pairs giving way to three).
    """
    flat = [n.replace(" ", "") for n in names]
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    out = np.zeros(len(flat), np.uint64)
    some = sizes > 0
    if some.any():
        code = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts = (np.cumsum(sizes) - sizes)[some]
        bits = np.left_shift(np.uint64(1), code % np.uint64(31))
        pairs = np.left_shift(np.uint64(1), np.uint64(32) + (code[:-1] * np.uint64(7) + code[1:]) % np.uint64(31))
        pairs[starts[1:] - 1] = 0  # the last letter of one name and the first of the next are no pair
        bits[:-1] ^= pairs
        out[some] = np.bitwise_xor.reduceat(bits, starts)
    return out


def _edits(length: np.ndarray) -> np.ndarray:
    """Edits that confidence() and slim() may admit, at most, between names of which the shorter one has so many letters."""
    return np.where(length >= 20, 3, np.where(length >= 7, 2, 1))


READING = "side int, name string, year int, kind int"


def readings(df: DataFrame, side: int, key: str, year: str, titles: list[str], subtitles: bool) -> DataFrame:
    """(key, side, name, year, kind): the readings of each record, each once."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, kinds = [], [], []
            held: dict[tuple, dict[str, int]] = {}
            for i, row in enumerate(zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True)):
                if row not in held:
                    held[row] = {n: k for x in reversed(row) for n, k in sorted(names_of(x, subtitles).items(), key=lambda p: -p[1])}
                for name, kind in held[row].items():
                    at.append(i)
                    names.append(name)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), batch.column(1).take(pa.array(at, pa.int64())), pa.array(kinds, pa.int32())], names=["key", "name", "year", "kind"])

    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{year}`").cast("int").alias("year"), *[F.col(f"`{t}`").alias(f"t{i}") for i, t in enumerate(titles)])
    return rows.filter("key is not null").mapInArrow(run, "key bigint, name string, year int, kind int").select("key", F.lit(side).alias("side"), "name", "year", "kind")


def _keyed(rows: DataFrame) -> DataFrame:
    """Each reading under each of its sort keys."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side, name, year, _ = (c.to_pylist() for c in batch.columns)
            at, keys, marks = [], [], _sketches(name).view(np.int64)
            for i, (s, n, y) in enumerate(zip(side, name, year, strict=True)):
                for k in sort_keys(n, y, 1 if s == 0 else 0):
                    at.append(i)
                    keys.append(k)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[c.take(take) for c in batch.columns], pa.array(marks, pa.int64()).take(take)], names=["sort", "side", "name", "year", "kind", "mark"])

    return rows.mapInArrow(run, f"sort string, {READING}, mark bigint")


def neighbours(rows: DataFrame, window: int = 12) -> DataFrame:
    """(left, left_year, right, right_year, kind, confidence, slim): readings of the two sides that match, each pair once.

    slim: they match only if the left reading has no other (see slim()).  rows: distinct (side, name, year, kind).  window: with how many right readings before it, and how many after it, each
    left reading is compared, by each key.  Left readings don't count, so many spellings of one entity push none out.
    Edges of partitions: the first and the last `window` right readings of every partition, at most twice window times the
    partitions, are broadcast and stand beside the readings of the other partitions.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    ordered = cut(_keyed(rows).repartitionByRange("sort").sortWithinPartitions("sort", "side", "name", "year"))
    columns = ["sort", "name", "year", "kind", "mark"]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last = TaskContext.get().partitionId(), [], []
        for batch in batches:
            found = batch.select(columns).filter(pc.equal(batch.column("side"), 1))
            first += found.slice(0, window - len(first)).to_pylist()
            last = [*last, *found.slice(max(found.num_rows - window, 0)).to_pylist()][-window:]
        rows_ = [(part, at, i, *r.values()) for at, side in enumerate((first, last)) for i, r in enumerate(side)]
        cols = list(zip(*rows_, strict=True)) or [()] * 8
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "at", "i", *columns])

    edge = ordered.mapInArrow(ends, "part int, at int, i int, sort string, name string, year int, kind int, mark bigint").toArrow().sort_by([("part", "ascending"), ("at", "ascending"), ("i", "ascending")])
    sides = [edge.filter(pc.equal(edge["at"], at)).select(["part", *columns]).combine_chunks() for at in (0, 1)]
    sent = rows.sparkSession.sparkContext.broadcast(sides)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, (heads, tails) = TaskContext.get().partitionId(), sent.value
        done: set[tuple] = set()
        upto = int(np.searchsorted(tails["part"].to_numpy(), part))
        right = tails.select(columns).slice(max(upto - window, 0), min(window, upto)).to_pydict()
        start, waiting = 0, []  # the number of right readings dropped; left readings, and how many right ones stand before each

        def pairs(left: pa.RecordBatch, before: np.ndarray) -> pa.RecordBatch:
            name, years = left.column("name").to_pylist(), left.column("year").to_pylist()
            code = lambda values: np.array([-1 if y is None else y for y in values], np.int64)
            group = lambda keys: np.array([k[0] for k in keys], "U1")
            mark, year, kinds = left.column("mark").to_numpy().view(np.uint64), code(years), group(left.column("sort").to_pylist())
            others, other_year, other_kinds = np.array(right["mark"], np.int64).view(np.uint64), code(right["year"]), group(right["sort"])
            letters = lambda names: np.array([len(n) - n.count(" ") for n in names], np.int64)
            length, other_length = letters(name), letters(right["name"])
            low, out = np.uint64(0xFFFFFFFF), []
            for step in range(-window, window):
                at = before - start + step
                i = np.flatnonzero((at >= 0) & (at < len(others)))
                j = at[i]
                x = mark[i] ^ others[j]
                most = _edits(np.minimum(length[i], other_length[j]))
                near = (kinds[i] == other_kinds[j]) & ((year[i] < 0) | (other_year[j] < 0) | (np.abs(year[i] - other_year[j]) <= 1)) & (np.bitwise_count(x & low) <= 2 * most) & (np.bitwise_count(x >> np.uint64(32)) <= 6 * most)
                for p, q in zip(i[near].tolist(), j[near].tolist(), strict=True):
                    what = (name[p], years[p], right["name"][q], right["year"][q], right["kind"][q])
                    if what in done:
                        continue
                    done.add(what)
                    if (c := confidence(what[0], what[2], what[1], what[3], what[4])) is not None:
                        out.append((*what, c, False))
                    elif (c := slim(what[0], what[2], what[1], what[3], what[4])) is not None:
                        out.append((*what, c, True))
            if len(done) > 500_000:
                done.clear()
            cols = list(zip(*out, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.float64()), pa.array(cols[6], pa.bool_())], names=["left", "left_year", "right", "right_year", "kind", "confidence", "slim"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ours = batch.column("side").to_numpy() == 0
            before = start + len(right["sort"]) + np.cumsum(~ours)
            theirs = batch.filter(pa.array(~ours))
            for c in columns:
                right[c] += theirs.column(c).to_pylist()
            if ours.any():
                waiting.append((batch.filter(pa.array(ours)), before[ours]))
            while waiting and waiting[0][1][-1] + window <= start + len(right["sort"]):
                yield pairs(*waiting.pop(0))
            drop = (waiting[0][1][0] if waiting else start + len(right["sort"])) - window - start
            if drop > 0:
                start, right = start + drop, {c: v[drop:] for c, v in right.items()}
        following = heads.select(columns).slice(int(np.searchsorted(heads["part"].to_numpy(), part, side="right")), window).to_pydict()
        for c in columns:
            right[c] += following[c]
        for left, before in waiting:
            yield pairs(left, before)

    found = ordered.mapInArrow(compare, "left string, left_year int, right string, right_year int, kind int, confidence double, slim boolean")
    return found.groupBy("left", "left_year", "right", "right_year").agg(F.max("confidence").alias("confidence"), F.min("kind").alias("kind"), F.min("slim").alias("slim"))


def _compared(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_year: str, right_year: str, left_titles: list[str], right_titles: list[str], window: int) -> tuple[DataFrame, DataFrame]:
    """(left_key, left, y): the readings of the left records; (left, left_year, right_key, confidence): the right records each may be."""
    a, b = readings(left, 0, left_key, left_year, left_titles, False), readings(right, 1, right_key, right_year, right_titles, True)
    a, b = cut(a.distinct()), cut(b.distinct())
    found = cut(neighbours(a.unionByName(b).select("side", "name", "year", "kind").distinct(), window))
    films = b.select(F.col("key").alias("right_key"), F.col("name").alias("right"), F.col("year").alias("right_year"), F.col("kind").alias("k"))
    same = (F.col("f.right") == F.col("b.right")) & F.col("f.right_year").eqNullSafe(F.col("b.right_year")) & (F.col("f.kind") <= F.col("b.k"))
    ours = a.select(F.col("key").alias("left_key"), F.col("name").alias("left"), F.col("year").alias("y"))
    of_one = W.partitionBy("left", "left_year")
    pairs = found.alias("f").join(films.alias("b"), same).select("left", "left_year", "right_key", "confidence", "slim")
    pairs = pairs.withColumn("sole", F.min("right_key").over(of_one) == F.max("right_key").over(of_one))
    return ours, pairs.filter(~F.col("slim") | F.col("sole")).drop("slim", "sole")


def match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_year: str, right_year: str, left_titles: list[str], right_titles: list[str], window: int = 12) -> DataFrame:
    """(left_key, right_key, confidence): for every left record its best match on the right, if there is one.

    Of equal confidences the smallest right key is taken.  Records without a key, without a title or whose titles have no
    word match none; repeated rows count once; the years may be null.
    """
    ours, pairs = _compared(left, right, left_key, right_key, left_year, right_year, left_titles, right_titles, window)
    by_reading = pairs.groupBy("left", "left_year").agg(F.max(F.struct("confidence", (-F.col("right_key")).alias("r"))).alias("best"))
    taken = ours.join(by_reading.withColumnRenamed("left", "l"), (F.col("left") == F.col("l")) & F.col("y").eqNullSafe(F.col("left_year")))
    best = taken.groupBy("left_key").agg(F.max("best").alias("best"))
    return best.select("left_key", (-F.col("best.r")).alias("right_key"), F.col("best.confidence").alias("confidence"))


def candidates(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_year: str, right_year: str, left_titles: list[str], right_titles: list[str], window: int = 12) -> DataFrame:
    """(left_key, right_key, confidence): every pair that match() chooses from, once, with its greatest confidence."""
    ours, pairs = _compared(left, right, left_key, right_key, left_year, right_year, left_titles, right_titles, window)
    by_reading = pairs.groupBy("left", "left_year", "right_key").agg(F.max("confidence").alias("confidence"))
    taken = ours.join(by_reading.withColumnRenamed("left", "l"), (F.col("left") == F.col("l")) & F.col("y").eqNullSafe(F.col("left_year")))
    return taken.groupBy("left_key", "right_key").agg(F.max("confidence").alias("confidence"))


def assign(weight: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of a one-to-one assignment of greatest total weight; pairs of weight 0 are none.  Rows by columns."""
    rows, cols = weight.shape
    if rows > cols:
        return [(i, j) for j, i in assign(weight.T)]
    cost = np.zeros((rows + 1, cols + 1))
    cost[1:, 1:] = weight.max(initial=0.0) - weight
    u, v, owner, way = np.zeros(rows + 1), np.zeros(cols + 1), np.zeros(cols + 1, int), np.zeros(cols + 1, int)
    for i in range(1, rows + 1):
        owner[0], j = i, 0
        least, used = np.full(cols + 1, np.inf), np.zeros(cols + 1, bool)
        while True:
            used[j] = True
            reduced = cost[owner[j]] - u[owner[j]] - v
            better = ~used & (reduced < least)
            better[0] = False
            least[better], way[better] = reduced[better], j
            rest = np.where(used, np.inf, least)
            rest[0] = np.inf
            following = int(rest.argmin())
            delta = rest[following]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = following
            if not owner[j]:
                break
        while j:
            owner[j], j = owner[way[j]], way[j]
    return [(owner[j] - 1, j - 1) for j in range(1, cols + 1) if owner[j] and weight[owner[j] - 1, j - 1] > 0]


#: Cells of the largest table of weights that one task holds (72 MB).
CELLS = 9_000_000


def one_to_one(edges: DataFrame, most: int = 3000, epsilon: float | None = None) -> DataFrame:
    """(left, right, confidence): the matches kept if each side may be matched once, with the greatest total confidence.

    edges: (left bigint, right bigint, confidence), repeated pairs count once with their greatest confidence.  The connected
    parts of the graph are solved apart.  A part with n records on its smaller side needs no more than the n best edges of
    every record there, as the others take at most n - 1 of them; so parts with up to `most` on the smaller side are
    solved exactly, whatever their larger side, if what is left has at most CELLS cells.  With one record on a side that
    is the best edge, taken in an aggregate.  The other parts are matched over
    the cluster, so no task holds a large part: with epsilon by an auction, whose total is less than the greatest by epsilon
    for each pair at most; without it by taking the locally best pairs in rounds, which reach at least half of it.
    """
    import pandas as pd

    edges = cut(edges.filter("left is not null and right is not null and confidence > 0").groupBy("left", "right").agg(F.max("confidence").alias("confidence")))
    link = edges.select((F.col("left") * 2).alias("a"), (F.col("right") * 2 + 1).alias("b"))
    nodes = link.select(F.col("a").alias("id")).union(link.select("b")).distinct().select("id", F.col("id").alias("class_id"))
    part = cut(groups_of(link, nodes).select("id", "group_id"))
    sizes = part.groupBy("group_id").agg(F.count_if(F.col("id") % 2 == 0).alias("n_left"), F.count_if(F.col("id") % 2 != 0).alias("n_right"))
    parted = cut(edges.join(part.filter("id % 2 = 0").select((F.col("id") / 2).cast("bigint").alias("left"), "group_id"), "left").join(sizes, "group_id"))

    star = F.least("n_left", "n_right") == 1
    single = parted.filter(star).groupBy("group_id").agg(F.max(F.struct("confidence", (-F.col("left")).alias("l"), (-F.col("right")).alias("r"))).alias("m")).select((-F.col("m.l")).alias("left"), (-F.col("m.r")).alias("right"), "m.confidence")
    parted = parted.filter(~star)

    few, small = F.least("n_left", "n_right") <= most, F.greatest("n_left", "n_right") <= most
    wide = parted.filter(few & ~small)
    pruned = []
    for side, n, other in (("right", F.col("n_right") < F.col("n_left"), "left"), ("left", F.col("n_right") >= F.col("n_left"), "right")):
        ranked = wide.filter(n).withColumn("place", F.row_number().over(W.partitionBy(side).orderBy(F.desc("confidence"), other)))
        pruned.append(ranked.filter((F.col("place") <= most) & (F.col("place") <= F.least("n_left", "n_right"))).drop("place"))
    wide = cut(pruned[0].unionByName(pruned[1]))
    cells = wide.groupBy("group_id").agg((F.count_distinct("left") * F.count_distinct("right")).alias("cells"))
    wide = wide.join(cells, "group_id")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = np.unique(rows["left"]), np.unique(rows["right"])
        weight = np.zeros((len(left), len(right)))
        weight[np.searchsorted(left, rows["left"]), np.searchsorted(right, rows["right"])] = rows["confidence"]
        pairs = assign(weight)
        return pd.DataFrame({"left": [left[i] for i, _ in pairs], "right": [right[j] for _, j in pairs], "confidence": [weight[i, j] for i, j in pairs]}, columns=["left", "right", "confidence"])

    columns = ["left", "right", "confidence"]
    exact = parted.filter(small).select("group_id", *columns).unionByName(wide.filter(F.col("cells") <= CELLS).select("group_id", *columns))
    chosen = single.unionByName(exact.groupBy("group_id").applyInPandas(solve, "left bigint, right bigint, confidence double"))
    rest = parted.filter(~few).select(columns).unionByName(wide.filter(F.col("cells") > CELLS).select(columns))
    if epsilon is not None:
        return chosen.unionByName(auction(rest, epsilon))
    while rest.limit(1).count():
        best = lambda side, other: rest.groupBy(side).agg(F.max(F.struct("confidence", (-F.col("left")).alias("l"), (-F.col("right")).alias("r"))).alias("m")).select((-F.col("m.l")).alias("left"), (-F.col("m.r")).alias("right"))  # noqa: E731, B023
        mutual = cut(best("left", "right").join(best("right", "left"), ["left", "right"]).join(rest, ["left", "right"]))
        chosen = chosen.unionByName(mutual.select("left", "right", "confidence"))
        rest = cut(rest.join(mutual.select("left"), "left", "left_anti").join(mutual.select("right"), "right", "left_anti"))
    return chosen


def auction(edges: DataFrame, epsilon: float) -> DataFrame:
    """(left, right, confidence): a one-to-one assignment whose total is less than the greatest by epsilon a pair at most.

    edges: (left, right, confidence > 0), each pair once.  In every round each left record without a partner bids for the
    right one that is worth most to it at its price, up to what the next best one, or none, is worth, and epsilon more; the
    highest bid takes it.  Prices begin at 0 and only rise, by epsilon or more, so a right record changes hands at most
    (greatest confidence / epsilon + 1) times, and one that nobody bids for costs nothing, which gives the bound.
    """
    edges = cut(edges)
    held = edges.select("right", F.lit(0.0).alias("price"), F.col("left").alias("owner")).limit(0)
    while True:
        worth = edges.join(held.select(F.col("owner").alias("left")), "left", "left_anti").join(held.select("right", "price"), "right", "left")
        worth = worth.withColumn("value", F.col("confidence") - F.coalesce("price", F.lit(0.0))).filter("value > 0")
        first = worth.groupBy("left").agg(F.max(F.struct("value", (-F.col("right")).alias("r"), "confidence")).alias("m"))
        first = first.select("left", (-F.col("m.r")).alias("wanted"), F.col("m.confidence").alias("most"))
        second = worth.join(first, "left").groupBy("left", "wanted", "most").agg(F.max(F.when(F.col("right") != F.col("wanted"), F.col("value"))).alias("next"))
        bids = second.select(F.col("wanted").alias("right"), "left", (F.col("most") - F.coalesce("next", F.lit(0.0)) + epsilon).alias("bid"))
        won = cut(bids.groupBy("right").agg(F.max(F.struct("bid", (-F.col("left")).alias("l"))).alias("m")).select("right", F.col("m.bid").alias("price"), (-F.col("m.l")).alias("owner")))
        if not won.limit(1).count():
            return edges.join(held.select("right", F.col("owner").alias("left")), ["left", "right"]).select("left", "right", "confidence")
        held = cut(held.join(won.select("right"), "right", "left_anti").unionByName(won))
