"""Subject areas of documents by a seeded non-negative factorisation of the document-term matrix.

The matrix counts the terms of every document, on a logarithmic scale, so no long text outweighs the others.
It is factored by alternating multiplicative updates
(Kullback-Leibler objective) into document mixtures and component-term weights.  The components of the
subjects are seeded by hand-labelled documents, which also act as a prior in every update; further components,
seeded by documents without a subject and by all documents, take the words of no subject.  So component i
stays subject i, and a document's mixture is read off directly.

Texts are parsed once, in arrays, into blocks of the matrix: for each document its terms with their counts, and for
each sentence the places of its terms.  The blocks are checkpointed, compressed, and everything else reads them.  A term
is a column by its hash (TERM_COLUMNS of them), so there is no vocabulary to count, to cut or to send, and every term of every document counts.

The component-term matrix has a fixed bound (components times columns); it is all that is broadcast
or brought to the driver.  Each update is one pass over the blocks: a task folds its documents into one
component-term sum, the sums are added per term in a shuffle.  Rows are never grouped, so no label, source or work can
be too large.

The mixture gives the subjects a document may have; of these, its sentences confirm those that enough of them are
about: each sentence goes to the component that has the most of its terms under the document's mixture.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import cut

#: Columns of the document-term matrix; terms whose hashes fall together share one.
TERM_COLUMNS = 1 << 18
#: Bytes of text in a block, unless one text is longer.
BLOCK_BYTES = 4_000_000
#: Hand-labelled documents that the seeds are taken from, at most (those of the smallest hash).
MOST_LABELLED = 200_000

_TAG_LINE = re.compile(r"<[^<>\n]*>")
_TIMES = re.compile(r"^\s*(?:\d+|\d+:\d\d:\d\d[,.]\d+\s*-->.*)\s*$", re.M)
_END = re.compile(r"(?<=[.!?。！？…])(?:\s+|(?<=[。！？]))|\n+")
_TERM = re.compile(r"[^\W\d_]+")
_EAST = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text without its markup and time codes.

    A sentence ends with a full stop, a question or an exclamation mark; headings, field names and titles are none.
    A text in which nothing ends like a sentence has its lines as sentences.  Null has none.
    """
    if not text:
        return []
    parts = [x.strip() for x in _END.split(_TIMES.sub("\n", _TAG_LINE.sub("\n", text)))]
    parts = [x for x in parts if _TERM.search(x)]
    ended = [x for x in parts if x[-1] in ".!?。！？…\"'”’)"]
    return ended or parts


def terms(sentence: str) -> list[str]:
    """The words of a sentence in lower case; two neighbouring characters each in scripts without spaces."""
    out = []
    for word in _TERM.findall(sentence.lower()):
        if _EAST.match(word):
            out += [word[i : i + 2] for i in range(len(word) - 1)] or [word]
        else:
            out.append(word)
    return out


def column_of(term: str) -> int:
    return zlib.crc32(term.encode()) % TERM_COLUMNS


# -- parsing -------------------------------------------------------------------------------------

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)


def _on(values, chosen, change):
    """values with change(values) where chosen."""
    import pyarrow.compute as pc

    return pc.replace_with_mask(values, chosen, change(values.filter(chosen))) if pc.any(chosen).as_py() else values


def parse(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentences of each text, terms of each sentence, column of each term) of an Arrow array of texts.

    The same as sentences() and terms() for each, but in arrays.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    text = pc.fill_null(texts.cast(pa.large_string()), "")
    text = _on(text, pc.match_substring(text, "<"), lambda x: pc.replace_substring_regex(x, r"<[^<>\n]*>", "\n"))
    text = _on(text, pc.match_substring(text, "-->"), lambda x: pc.replace_substring_regex(x, r"(?m)^\s*\d+:\d\d:\d\d[,.]\d+\s*-->.*$", "\n"))
    text = pc.replace_substring_regex(text, r"([.!?。！？…])\s+", "\\1\n")
    text = _on(text, pc.invert(pc.string_is_ascii(text)), lambda x: pc.replace_substring_regex(x, "([。！？])", "\\1\n"))
    lists = pc.split_pattern(text, "\n")
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy(zero_copy_only=False)))
    parts = pc.utf8_trim_whitespace(lists.flatten())
    some = pc.match_substring_regex(parts, r"\pL")
    ended = pc.and_(some, pc.match_substring_regex(parts, "[.!?。！？…\"'”’)]$")).to_numpy(zero_copy_only=False)
    whole = np.zeros(len(lists), bool)
    whole[owner[ended]] = True
    kept = np.where(whole[owner], ended, some.to_numpy(zero_copy_only=False))
    parts, owner = parts.filter(pa.array(kept)), owner[kept]
    odd = pc.invert(pc.string_is_ascii(parts))
    parts = _on(parts, odd, lambda x: pc.replace_substring_regex(pc.utf8_lower(x), r"[^\x00-\x7f\pL\pM\p{No}\p{Nl}]+", " "))
    parts = pa.concat_arrays([parts])  # the buffers begin at 0
    _, offsets, data = parts.buffers()
    low, high = (int(x) for x in np.frombuffer(offsets, np.int64)[[parts.offset, parts.offset + len(parts)]]) if len(parts) else (0, 0)
    letters = np.zeros(0 if data is None else data.size, np.uint8)
    if data is not None:
        letters[low:high] = _LETTERS[np.frombuffer(data, np.uint8)[low:high]]
    spaced = pa.Array.from_buffers(pa.large_string(), len(parts), [None, offsets, pa.py_buffer(letters)], offset=parts.offset)
    words = pc.ascii_split_whitespace(spaced)
    sentence = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy(zero_copy_only=False)))
    flat = words.flatten()
    filled = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(filled).dictionary_encode()
    sentence, codes = sentence[filled.to_numpy(zero_copy_only=False)], coded.indices.to_numpy(zero_copy_only=False)
    made = [terms(w) for w in coded.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, made), np.int64, len(made))
    columns = np.fromiter((column_of(t) for x in made for t in x), np.int32, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    each = sizes[codes]
    inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    column = columns[np.repeat(starts[codes], each) + inside]
    return np.bincount(owner, minlength=len(lists)), np.bincount(sentence, weights=each, minlength=len(parts)).astype(np.int64), column


def _packed(values: np.ndarray) -> bytes:
    import pyarrow as pa

    return len(values).to_bytes(8, "little") + pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpacked(value: bytes, kind: type) -> np.ndarray:
    import pyarrow as pa

    size = int.from_bytes(value[:8], "little") * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(value[8:], decompressed_size=size, codec="zstd", asbytes=True), kind)


BLOCK = {"ids": np.int64, "sizes": np.int32, "terms": np.int32, "counts": np.int32, "sentences": np.int32, "lengths": np.int32, "places": np.int32}


def blocks(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The blocks of the document-term matrix, checkpointed; each column holds packed numbers.

    ids; sizes: the distinct terms of each document; terms, counts: of one document after the other; sentences: of each
    document; lengths: the terms of each sentence; places: for each of them its place among the document's terms.
    Documents without a key have no part in it; null and empty texts have no terms.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def block(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        per_doc, lengths, column = parse(texts)
        doc = np.repeat(np.repeat(np.arange(len(per_doc)), per_doc), lengths)
        cells, place, counts = np.unique(doc * TERM_COLUMNS + column, return_inverse=True, return_counts=True)
        sizes = np.bincount(cells // TERM_COLUMNS, minlength=len(per_doc))
        made = {"ids": ids.to_numpy(zero_copy_only=False), "sizes": sizes, "terms": cells % TERM_COLUMNS, "counts": counts, "sentences": per_doc, "lengths": lengths, "places": place - (np.cumsum(sizes) - sizes)[doc]}
        return pa.RecordBatch.from_pydict({c: pa.array([_packed(made[c].astype(kind))], pa.binary()) for c, kind in BLOCK.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reached = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                upto = max(int(np.searchsorted(reached, (reached[at - 1] if at else 0) + BLOCK_BYTES, side="right")), at + 1)
                yield block(batch.column(0).slice(at, upto - at), batch.column(1).slice(at, upto - at))
                at = upto

    rows = documents.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).filter("id is not null")
    return cut(rows.mapInArrow(run, ", ".join(f"{c} binary" for c in BLOCK)))


# -- the factorisation ---------------------------------------------------------------------------

CELLS = 1 << 16


def _like_sized(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Documents in groups of nearly the same number of terms, with the greatest of the group; those without terms are in none."""
    order = np.argsort(sizes, kind="stable")
    at = int(np.searchsorted(sizes[order], 1))
    while at < len(order):
        least = int(sizes[order[at]])
        upto = int(np.searchsorted(sizes[order], least + least // 8, side="right"))
        upto = max(min(upto, at + CELLS // (least + least // 8)), at + 1)
        yield order[at:upto], int(sizes[order[upto - 1]])
        at = upto


def mixtures(h: np.ndarray, term: np.ndarray, count: np.ndarray, sizes: np.ndarray, steps: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Document mixtures for given components (rows sum to 1), and count / (WH) of every entry.

    h: terms by components.  term, count: the entries of one document after the other, sizes[i] of document i.
    """
    k = h.shape[1]
    w = np.full((len(sizes), k), 1.0 / k, np.float32)
    ratio = np.zeros(len(term), np.float32)
    starts = np.cumsum(sizes) - sizes
    for docs, width in _like_sized(sizes):
        inside = np.arange(width)
        real = inside[None, :] < sizes[docs][:, None]
        entry = np.where(real, starts[docs][:, None] + inside[None, :], 0)
        some = np.where(real, count[entry], np.float32(0))
        columns = h[term[entry]]
        x = w[docs]
        for step in range(steps + 1):
            part = some / np.maximum(np.matmul(columns, x[:, :, None])[:, :, 0], np.float32(1e-12))
            if step < steps:
                x = x * np.matmul(part[:, None, :], columns)[:, 0, :] + np.float32(1e-3)
                x /= x.sum(1, keepdims=True)
        w[docs] = x
        ratio[entry[real]] = part[real]
    return w, ratio


def fold(h: np.ndarray, term: np.ndarray, count: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What some documents add to the next component-term weights: terms by components."""
    w, ratio = mixtures(h, term, count, sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return np.stack([np.bincount(term, weights=w[doc, i] * ratio, minlength=len(h)) for i in range(h.shape[1])], axis=1) * h


class Seeds:
    """Anchors of the components: which terms the labelled documents tie to which subject.

    labelled: (subjects + 1, terms), the number of labelled documents of each subject (the last row: of none) that hold a
    term, a document of several subjects counting in parts; total: labelled documents by subject; share: of all documents,
    the share that holds a term.  A term is an anchor of a subject if it is clearly more frequent there; a term with
    evidence that isn't one is closed to the subject.
    """

    def __init__(self, labelled: np.ndarray, total: np.ndarray, share: np.ndarray, background: int, smoothing: float = 4.0, lift: float = 1.5, sigmas: float = 2.0, evidence: float = 6.0, seed: int = 7) -> None:
        k, size = len(total) - 1, labelled.shape[1]
        seen = labelled.sum(0)
        base = np.where(seen > 0, seen / max(total.sum(), 1e-9), share)
        lifts = (labelled[:k] + smoothing * base) / (total[:k, None] + smoothing) / np.maximum(base, 1e-9)
        expected = total[:k, None] * base
        anchors = (lifts > lift) & ((labelled[:k] - expected) / np.sqrt(expected + 0.5) > sigmas)
        self.subjects = k
        self.mask = np.ones((k + background, size))
        self.mask[:k][~anchors & (seen >= evidence)[None, :]] = 0.001
        rng = np.random.default_rng(seed)
        start = [share * np.where(anchors[i], lifts[i] ** 2, 0.05) for i in range(k)]
        start += [share * np.where(anchors.any(0), 0.1, 1.0) * (rng.uniform(0.5, 1.5, size) if b else 1.0) for b in range(background)]
        h = np.stack(start) * self.mask + 1e-9
        self.h = h / h.sum(1, keepdims=True)
        self.prior = self.h * 500

    def update(self, gathered: np.ndarray, sharpen: float = 1.3) -> np.ndarray:
        """The next components.  The background is sharpened, so it keeps what is common in its documents and leaves the rest to the subjects."""
        h = (gathered + self.prior) * self.mask + 1e-4
        h /= h.sum(1, keepdims=True)
        rest = h[self.subjects :] ** sharpen
        h[self.subjects :] = rest / np.maximum(rest.sum(1, keepdims=True), 1e-30)
        return h


def label_sentences(h: np.ndarray, w: np.ndarray, subjects: int, term: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, places: np.ndarray, per_doc: np.ndarray, least: float = 0.8) -> np.ndarray:
    """The subject of every sentence, -1 for none, by the mixtures w of the documents.

    Each term is shared out among the components by the document's mixture.  A sentence goes to the subject with the
    most of its terms, if that is at least `least` of a term; equal shares go to the first subject.
    """
    if not len(lengths):
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    part = w[doc] * h[term]
    part = part[:, :subjects] / np.maximum(part.sum(1, keepdims=True), np.float32(1e-30))
    per_sentence = np.repeat((np.cumsum(sizes) - sizes), per_doc)
    mass = np.zeros((len(lengths), subjects), np.float32)
    some = lengths > 0
    if some.any():
        mass[some] = np.add.reduceat(part[places + np.repeat(per_sentence, lengths)], (np.cumsum(lengths) - lengths)[some], axis=0)
    best = mass.argmax(1)
    best[mass.max(1) < least] = -1
    return best


# -- over the corpus -----------------------------------------------------------------------------


def _entries(batch, columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The named parts of each block of a batch."""
    for row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
        yield [_unpacked(x, BLOCK[c]) for c, x in zip(columns, row, strict=True)]


def _weights(count: np.ndarray) -> np.ndarray:
    return (1 + np.log(count)).astype(np.float32)


def fit(documents: DataFrame, labels: DataFrame, subjects: list[str], key: str = "doc_id", text: str = "text", background: int = 3, rounds: int = 4, most_labelled: int = MOST_LABELLED, stored: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(column, h): the place of each term column among those in use (-1: not in use), and the component-term weights, subjects first.

    labels: (doc_id, subject) in any case, `none` for no subject; labels of unknown subjects or documents are left out.
    most_labelled: the seeds are counted on at most so many labelled documents, those whose key has the smallest hash;
    everything else is over all documents.  stored: the blocks of the documents, if they are there already.
    """
    import pyarrow as pa

    stored = blocks(documents, key, text) if stored is None else stored
    sc = stored.sparkSession.sparkContext
    names, k = [s.lower() for s in subjects] + ["none"], len(subjects) + background
    own = labels.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.lower(F.trim("subject")).alias("s")).filter(F.col("s").isin(names) & F.col("id").isNotNull())
    by_doc = own.groupBy("id").agg(F.sum_distinct(F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, 1 << i)]), F.col("s")).cast("bigint")).alias("bits")).orderBy(F.xxhash64("id"), "id").limit(most_labelled).toArrow().sort_by("id")
    known = sc.broadcast((by_doc["id"].to_numpy(), by_doc["bits"].to_numpy()))
    n = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bits = known.value
        seen, totals, tied = np.zeros(TERM_COLUMNS, np.int64), np.zeros(n + 1), np.zeros((n, TERM_COLUMNS))
        for batch in batches:
            for doc_ids, sizes, term in _entries(batch, ["ids", "sizes", "terms"]):
                seen += np.bincount(term, minlength=TERM_COLUMNS)
                totals[n] += len(doc_ids)
                at = np.minimum(np.searchsorted(ids, doc_ids), max(len(ids) - 1, 0))
                mine = np.where(ids[at] == doc_ids, bits[at], 0) if len(ids) else np.zeros(len(doc_ids), np.int64)
                part = 1 / np.maximum(np.bitwise_count(mine.astype(np.uint64)), 1)
                chosen = np.flatnonzero(np.repeat(mine > 0, sizes))
                doc = np.repeat(np.arange(len(doc_ids)), sizes)[chosen]
                for i in range(n):
                    has = (mine[doc] >> i & 1).astype(bool)
                    tied[i] += np.bincount(term[chosen[has]], weights=part[doc[has]], minlength=TERM_COLUMNS)
                    totals[i] += part[(mine >> i & 1).astype(bool)].sum()
        used = np.flatnonzero(seen)
        rows = [np.concatenate([[-1], used]), np.concatenate([[totals[n]], seen[used]]), *[np.concatenate([[totals[i]], tied[i, used]]) for i in range(n)]]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0].astype(np.int32)), *[pa.array(x.astype(np.float64)) for x in rows[1:]]], names=["term", "n", *[f"s{i}" for i in range(n)]])

    counted = stored.select("ids", "sizes", "terms").mapInArrow(count, "term int, n double, " + ", ".join(f"s{i} double" for i in range(n)))
    found = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in counted.columns[1:]]).toArrow().sort_by("term")
    column = np.full(TERM_COLUMNS, -1, np.int32)
    if found.num_rows < 2:
        return column, np.zeros((k, 0), np.float32)
    used, every = found["term"].to_numpy()[1:], found["n"].to_numpy()
    column[used] = np.arange(len(used))
    tied = np.stack([found[f"s{i}"].to_numpy() for i in range(n)])
    seeds = Seeds(tied[:, 1:], tied[:, 0], every[1:] / max(every[0], 1), background)
    h = seeds.h
    for _ in range(rounds):
        sent = sc.broadcast((column, np.ascontiguousarray(h.T, np.float32)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            column, weights = sent.value
            sums = np.zeros(weights.shape)
            for batch in batches:
                for sizes, term, count in _entries(batch, ["sizes", "terms", "counts"]):
                    sums += fold(weights, column[term], _weights(count), sizes)
            some = np.flatnonzero(sums.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(sums[some, i]) for i in range(k)]], names=["term", *[f"k{i}" for i in range(k)]])

        made = stored.select("sizes", "terms", "counts").mapInArrow(run, "term int, " + ", ".join(f"k{i} double" for i in range(k)))
        sums = made.groupBy("term").agg(*[F.sum(f"k{i}").alias(f"k{i}") for i in range(k)]).toArrow()
        gathered = np.zeros((k, len(used)))
        for i in range(k):
            gathered[i, sums["term"].to_numpy()] = sums[f"k{i}"].to_numpy()
        h = seeds.update(gathered)
        sent.unpersist()
    return column, h.astype(np.float32)


def assign(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], subjects: list[str], key: str = "doc_id", text: str = "text", stored: DataFrame | None = None) -> DataFrame:
    """(id, subject, weight, about, sentences): for every document and subject, its part of the mixture and how many sentences are about it.

    Documents have a row for every subject with a sentence about it or with a hundredth of the mixture at least; null and
    empty texts have no rows.  Whole texts are read; a document delivered twice has its rows twice.
    """
    import pyarrow as pa

    stored = blocks(documents, key, text) if stored is None else stored
    column, h = model
    sent, names = stored.sparkSession.sparkContext.broadcast((column, np.ascontiguousarray(h.T, np.float32))), list(subjects)
    kinds = {"id": pa.int64(), "subject": pa.string(), "weight": pa.float64(), "about": pa.int64(), "sentences": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, weights = sent.value
        labels = np.array(names, object)
        for batch in batches:
            for ids, sizes, term, count, per_doc, lengths, places in _entries(batch, list(BLOCK)):
                if not len(weights) or not len(names):
                    continue
                at = column[term]
                w, _ = mixtures(weights, at, _weights(count), sizes, 12)
                best = label_sentences(weights, w, len(names), at, sizes, lengths, places, per_doc)
                doc = np.repeat(np.arange(len(ids)), per_doc)
                told = np.bincount(doc[best >= 0] * len(names) + best[best >= 0], minlength=len(ids) * len(names)).reshape(len(ids), len(names))
                d, s = np.nonzero((told > 0) | (w[:, : len(names)] >= 0.01) & (sizes > 0)[:, None])
                cols = [ids[d], labels[s], w[d, s].astype(np.float64), told[d, s], per_doc[d].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))

    return stored.mapInArrow(run, "id bigint, subject string, weight double, about bigint, sentences bigint")


def subjects_of(spark: SparkSession, documents: DataFrame, labels: DataFrame, areas: DataFrame, share: float = 0.25, least: int = 2, weight: float = 0.03) -> DataFrame:
    """(doc_id, subject, share): the subjects that at least `share` of a document's sentences are about, and `least` of them at least.

    Only subjects with a part of the document's mixture of at least `weight` are asked for.  areas: (subject), a small
    table that doesn't grow.
    """
    found = mixtures_of(spark, documents, labels, areas, weight).filter((F.col("about") >= least) & (F.col("about") >= share * F.col("sentences")))
    return found.select("doc_id", "subject", (F.col("about") / F.col("sentences")).alias("share")).distinct()


def mixtures_of(spark: SparkSession, documents: DataFrame, labels: DataFrame, areas: DataFrame, weight: float = 0.07) -> DataFrame:
    """(doc_id, subject, weight, about, sentences): the subjects with at least so large a part of a document's mixture.

    about: how many of its sentences are about the subject.
    """
    names = sorted(r[0] for r in areas.select("subject").filter("subject is not null").distinct().collect())
    stored = blocks(documents)
    found = assign(documents, fit(documents, labels, names, stored=stored), names, stored=stored)
    return found.filter(F.col("weight") >= weight).withColumnRenamed("id", "doc_id")
