"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of words, words as buckets of a hashed vocabulary of the corpus. The space
of the search is a randomised SVD of the TF-IDF matrix whose rows are all passages of the corpus and the benchmark
items: each passage is added, with a random sign, to one of ``SKETCH`` rows, in the task that reads it; the sums of
these rows over the corpus, and the items with a weight, span the range of the matrix, and the
right singular vectors of this small matrix are the space. Passages whose cosine with an item, taken in the space,
passes a threshold are candidates. They are checked on their words in the same task: longest common subsequence, and
for looser matches the item's content words and its sentences as answers.

The corpus is read once for the sketch, which does not depend on the items, and once for each ``ITEMS`` items. What is
held is bounded by parameters: the sketch (SKETCH by BUCKETS numbers) and what projects words on items (BUCKETS by
ITEMS).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, staged, table
from .words import mix, word_hashes

HALF = 32  #: a passage has two halves and shares each with a neighbour
BUCKETS, SKETCH = 1 << 15, 288
#: Items that share a space, its dimensions beyond their number, and passages that are compared at a time.
ITEMS, EXTRA_RANK, PASSAGE_BLOCK = 512, 64, 64
#: The items' energy in the matrix as a multiple of the corpus's, so that the space has room for each of them.
ITEM_ENERGY = 30.0
COSINE = 0.16
#: Shares of an item's words that a passage holds in order: copies; and paraphrases, which also hold so much of the
#: item's content words and of a sentence.
COPY, PARAPHRASE, CONTENT, ANSWER = 0.75, 0.45, 0.4, 0.5
SENTENCE_WORDS = 3
_SIGNS = "\"'`.,;:!?()[]{}<>*#$%&|-_~+=/\\^@"
SPACES = bytes(1 if b <= 0x20 or b == 0x7F or chr(b) in _SIGNS else 0 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def prepare(text: bytes) -> bytes:
    """Lower-case bytes of the same length (ASCII and Latin-1 letters), with other signs of Latin text as spaces."""
    low = text.translate(_LOWER)
    if low.isascii():
        return low
    x = np.frombuffer(bytearray(low), np.uint8)
    at = np.flatnonzero(x[:-1] == 0xC3) + 1
    big = at[(x[at] >= 0x80) & (x[at] <= 0x9E) & (x[at] != 0x97)]
    x[big] += 0x20
    at = np.flatnonzero(x[:-1] == 0xC2)
    at = at[~np.isin(x[at + 1], (0xAA, 0xB5, 0xBA))]
    x[at] = x[at + 1] = 0x20
    at = np.flatnonzero((x[:-2] == 0xE2) & (x[1:-1] == 0x80))
    x[at] = x[at + 1] = x[at + 2] = 0x20
    return x.tobytes()


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Hashes of the lower-case words between white space and signs, by runs of texts."""
    return word_hashes(column, prepare, SPACES)


def buckets(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence of words, by bit-parallel rows."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for w in b:
        if m := places.get(w):
            u = row & m
            row = (row + u | row - u) & whole
    return len(a) - row.bit_count()


class Layout:
    """Halves and passages of a run of texts: passage p of a text has its halves p and p + 1."""

    def __init__(self, bounds: np.ndarray) -> None:
        n = np.diff(bounds)
        self.halves = -(-n // HALF)
        self.passages = np.where(self.halves > 0, np.maximum(self.halves - 1, 1), 0)
        self.first_half, self.first_passage = np.cumsum(self.halves) - self.halves, np.cumsum(self.passages) - self.passages
        self.doc = np.repeat(np.arange(len(n)), n)
        self.half = (np.arange(bounds[-1]) - bounds[self.doc]) // HALF  # of each word in its text


class Sketch:
    """Documents with each bucket, and the signed sums of the passages of a task."""

    def __init__(self, seed: int) -> None:
        self.df, self.n, self.seen = np.zeros(BUCKETS, np.int64), 0, seed << 40
        self.rows = np.zeros(SKETCH * BUCKETS, np.int32)

    def add(self, h: np.ndarray, bounds: np.ndarray) -> None:
        lay, t = Layout(bounds), buckets(h)
        self.n += len(lay.halves)
        # Once for each half: a term counts 0, 1 or 2 in a passage, so that lists and repetition don't outweigh the rest.
        kept = np.unique((lay.first_half[lay.doc] + lay.half) * BUCKETS + t, return_index=True)[1]
        t, doc, half = t[kept], lay.doc[kept], lay.half[kept]
        self.df += np.bincount(np.unique(doc * BUCKETS + t) % BUCKETS, minlength=BUCKETS)
        key = mix(np.arange(int(lay.passages.sum()), dtype=np.uint64) + np.uint64(self.seen))
        self.seen += len(key)
        row = (key % np.uint64(SKETCH)).astype(np.int64) * BUCKETS
        sign = (key >> np.uint64(63)).astype(np.int32) * 2 - 1
        for ok, step in ((half < lay.passages[doc], 0), (half > 0, -1)):
            p = (lay.first_passage[doc] + half + step)[ok]
            np.add.at(self.rows, row[p] + t[ok], sign[p])

    def parts(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(row, places, values) of what is not 0; row -1 has the documents with each bucket and then their number."""
        df = np.append(self.df, self.n)
        for i, x in [(-1, df), *enumerate(self.rows.reshape(SKETCH, BUCKETS))]:
            at = np.flatnonzero(x)
            if len(at):
                yield i, at.astype("<i4").tobytes(), x[at].astype("<i4" if i >= 0 else "<i8").tobytes()


def sketch(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The signed sums (SKETCH by BUCKETS) of all passages, the documents with each bucket, and all documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = Sketch(TaskContext.get().partitionId())
        for b in batches:
            for _, _, h, bounds in words_of(b.column(0)):
                held.add(h, bounds)
        for row, places, values in held.parts():
            yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([places]), pa.array([values])], names=["row", "places", "vals"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; one is held at a time."""
        row, total = None, None

        def given() -> pa.RecordBatch:
            kind = "<f4" if row >= 0 else "<f8"
            return pa.RecordBatch.from_arrays([pa.array([row]), pa.array([total.astype(kind).tobytes()])], names=["row", "total"])

        for b in batches:
            for i, places, values in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if i != row:
                    if row is not None:
                        yield given()
                    row, total = i, np.zeros(BUCKETS + 1)
                total[np.frombuffer(places.as_buffer(), "<i4")] += np.frombuffer(values.as_buffer(), "<i4" if i >= 0 else "<i8")
        if row is not None:
            yield given()

    parts = docs.select("text").mapInArrow(read, "row long, places binary, vals binary")
    sums = parts.repartition(min(SKETCH, 64), "row").sortWithinPartitions("row").mapInArrow(summed, "row long, total binary")
    rows, df, n = np.zeros((SKETCH, BUCKETS), np.float32), np.zeros(BUCKETS), 0
    for r in staged(sums, "sketch", batch_rows=16).toLocalIterator():  # SKETCH + 1 rows of BUCKETS numbers
        if r.row < 0:
            got = np.frombuffer(r.total, "<f8")
            df, n = got[:-1], int(got[-1])
        else:
            rows[r.row] = np.frombuffer(r.total, "<f4")[:-1]
    return rows, df, n


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """Smooth IDF: terms of every document still count, as they are what is left of an item whose rarer words were replaced."""
    return np.log(1 + (n + 1) / (df + 0.5))


def onto_items(rows: np.ndarray, items: np.ndarray, rank: int) -> np.ndarray:
    """What projects a passage on the latent space and then on each item there: a matrix of BUCKETS by items.

    The matrix of the space is the weighted sketch ``rows`` over the items, which get ITEM_ENERGY times its energy. Its
    right singular vectors are its own rows in other proportions, which the products of its rows give; so neither
    the matrix nor the vectors are laid out.
    """
    times = np.float32(np.sqrt(ITEM_ENERGY * max(float((rows**2).sum()), 1.0) / max(float((items**2).sum()), 1e-9)))
    cross = times * (rows @ items.T)
    products = np.block([[rows @ rows.T, cross], [cross.T, times**2 * (items @ items.T)]]).astype(np.float64)
    values, left = np.linalg.eigh(products)
    top = np.argsort(-values)[:rank]
    top = top[values[top] > 1e-6 * values.max()]
    shares = left[:, top] / np.sqrt(values[top])  # of the matrix's rows in each singular vector
    latent = products[len(rows) :] @ shares  # the items in the space
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    parts = (latent @ shares.T).astype(np.float32)
    return np.ascontiguousarray((parts[:, : len(rows)] @ rows + (times * parts[:, len(rows) :]) @ items).T)


class Item:
    """An item's words by their hashes, those of more than its median weight, and its sentences."""

    def __init__(self, item_id: int, text: str, weight: np.ndarray) -> None:
        self.id = item_id
        h = next(words_of(pa.array([text])), (0, 0, np.empty(0, np.uint64), None))[2]
        self.words, w = h.tolist(), weight[buckets(h)]
        self.buckets = buckets(h)
        self.content = h[w >= np.median(w)].tolist() if len(h) else []
        ends = text.replace("\n", ". ").replace("? ", ". ").replace("! ", ". ").split(". ")
        found = [x[2].tolist() for s in ends for x in words_of(pa.array([s]))]
        self.answers = [s for s in found if len(s) >= SENTENCE_WORDS] or [self.words]

    def match(self, region: list[int]) -> tuple[str | None, float]:
        """Whether a passage with its surroundings holds the item (copy, paraphrase or None), and how much of it in order."""
        n = len(self.words)
        there = set(region)
        # No subsequence is longer than the item's words that are there at all.
        if sum(map(there.__contains__, self.words)) < PARAPHRASE * n:
            return None, 0.0
        part = lcs(self.words, region) / n
        if part >= COPY:
            return "copy", part
        if part < PARAPHRASE or lcs(self.content, region) < CONTENT * len(self.content):
            return None, part
        answered = any(lcs(s, region) >= ANSWER * len(s) for s in self.answers)
        return "paraphrase" if answered else None, part


class Search:
    """The items in the latent space, and the passages that are near one and hold it."""

    def __init__(self, rows: np.ndarray, weight: np.ndarray, items: list[Item], cosine: float = COSINE) -> None:
        """``rows``: the weighted sketch."""
        self.weight, self.items, self.cosine = weight.astype(np.float32), items, cosine
        counts = np.array([np.bincount(x.buckets, minlength=BUCKETS).clip(max=2) for x in items], np.float32)
        counts *= self.weight
        self.onto = onto_items(rows, counts, len(items) + EXTRA_RANK)
        self.onto *= self.weight[:, None]
        #: A passage's length in the items' terms, as other terms are outside what the items can tell.
        self.square = np.where(counts.any(axis=0), self.weight**2, 0)

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(text, passage, item, cosine) of a run of texts, in their order."""
        lay, t = Layout(bounds), buckets(h)
        half = lay.first_half[lay.doc] + lay.half  # of each word in the run
        starts = np.append(np.searchsorted(half, np.arange(int(lay.halves.sum()))), len(t))
        doc = np.repeat(np.arange(len(lay.passages)), lay.passages)
        own = np.arange(len(doc)) - lay.first_passage[doc]
        first = lay.first_half[doc] + own
        two = lay.halves[doc] > 1
        for at in range(0, len(doc), PASSAGE_BLOCK):
            a, b = first[at : at + PASSAGE_BLOCK], two[at : at + PASSAGE_BLOCK]
            lo, hi = int(a[0]), int(a[-1]) + 1 + int(b[-1])
            words = t[starts[lo] : starts[hi]]
            terms, place = np.unique(words, return_inverse=True)
            cells = (half[starts[lo] : starts[hi]] - lo) * len(terms) + place
            counts = np.zeros((hi - lo, len(terms)), np.float32)
            counts.reshape(-1)[cells] = 1
            rows = counts[a - lo]
            rows[b] += counts[a[b] + 1 - lo]
            length = np.sqrt(rows**2 @ self.square[terms])
            near = (rows @ self.onto[terms]) / np.maximum(length, 1e-9)[:, None]
            for row, item in zip(*np.nonzero(near >= self.cosine), strict=True):
                yield int(doc[at + row]), int(own[at + row]), int(item), float(near[row, item])

    def found(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, str, float, float]]:
        """(text, item id, kind, share in order, cosine) of the candidates that their words confirm."""
        for doc, passage, k, cosine in self.candidates(h, bounds):
            item = self.items[k]
            around = len(item.words)
            lo = bounds[doc] + max(0, passage * HALF - around)
            kind, part = item.match(h[lo : min(bounds[doc + 1], bounds[doc] + (passage + 2) * HALF + around)].tolist())
            if kind:
                yield doc, item.id, kind, part, cosine


FOUND = "doc_id long, item_id long, kind string, lcs double, cosine double"


def _searched(docs: DataFrame, search: Search) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for first, _, h, bounds in words_of(b.column(1)):
                best: dict[tuple[int, int], tuple] = {}
                for doc, item, kind, part, cosine in search.found(h, bounds):
                    key = ids[first + doc], item
                    best[key] = max(best.get(key, (0.0, 0.0, "")), (part, cosine, kind))
                out += [(*key, kind, part, cosine) for key, (part, cosine, kind) in best.items()]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "kind", "lcs", "cosine"])

    return docs.mapInArrow(run, FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, kind (copy or paraphrase), lcs, cosine: the documents that hold benchmark items.

    Each pair comes once, with its longest common subsequence as a share of the item's words. Null, empty and
    wordless texts and items match nothing; an empty table on either side gives no rows; rows of one doc_id (or
    items of one item_id: the first text by order) count together; rows with a null id are left out; of equal
    matches the greater cosine is given. Long texts are read whole, in blocks of passages. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    queries = benchmark.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    known: tuple[np.ndarray, np.ndarray] | None = None
    held: list[Item] = []
    found: DataFrame | None = None

    def add() -> None:
        nonlocal found
        if held:
            part = _searched(docs, Search(*known, list(held)))
            found = part if found is None else found.union(part)
            held.clear()

    # The benchmark is the query set: the driver holds ITEMS items at a time.
    for r in queries.orderBy("item_id").toLocalIterator():
        if known is None:
            rows, df, n = sketch(docs)
            known = rows, weights(df, n)
            rows *= known[1].astype(np.float32)
        item = Item(r.item_id, r.text, known[1])
        if item.words:
            held.append(item)
        if len(held) == ITEMS:
            add()
    add()
    if found is None:
        return spark.createDataFrame([], FOUND)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", "cosine", "kind")).alias("x"))
    return best.select("doc_id", "item_id", "x.kind", "x.lcs", "x.cosine")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontamination": op6_decontamination}
SQL: dict[str, str] = {}
