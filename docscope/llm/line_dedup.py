"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines chooses where chunks end, so the same run of lines is cut alike
wherever it stands. A line of LONG_WORDS words or more is a chunk of its own (a parameter: without it a passage that stands
in one line, as most repeated passages of the tables do, is in no chunk that repeats). Chunks that occur more than once in
the corpus are compared byte by byte with their first occurrence (the smallest doc_id, then line); equal ones are
removed, and with them the lines before and after that also stand beside the first occurrence.

Several cuttings with different seeds find runs that one cutting splits badly. Chunks of few words are not removed
by themselves; instead a chunk of MIN_WORDS words is also taken from every short line on, so that a repeated passage
of short lines has chunks within it wherever the cuts fall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, fresh, ready, spread_join, staged, table, unsigned_crc

ROLL, DIVISOR, SEEDS = 2, 2, 3
#: A chunk has two lines and MIN_WORDS words at least, or is one line of LONG_WORDS words.
MIN_WORDS, LONG_WORDS = 20, 25
_PRIME = 0x100000001B3


def _reach(words: list[int], at: int, step: int = 1, long_words: int = LONG_WORDS) -> int:
    """How many lines from ``at`` on hold MIN_WORDS words in two lines, or end beside a long line or the text."""
    n = held = full = 0
    while 0 <= (i := at + step * n) < len(words) and words[i] < long_words and (held < MIN_WORDS or full < 2):
        held, full, n = held + words[i], full + (words[i] > 0), n + 1
    return n


def chunks(lines: list[bytes], long_words: int = LONG_WORDS) -> list[tuple[int, int]]:
    """(first line, number of lines) of the chunks of all cuttings that can be removed."""
    words = [len(x.split()) for x in lines]
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    found = set()
    for seed in range(SEEDS):
        start = 0
        for i in range(len(lines)):
            rolled = 0
            for h in hashes[max(start, i - ROLL + 1) : i + 1]:
                rolled = (rolled * _PRIME + h) & 0xFFFFFFFFFFFFFFFF
            alone = words[i] >= long_words
            if alone and start < i:
                found.add((start, i - start))
                start = i
            if alone or xxhash.xxh3_64_intdigest(rolled.to_bytes(8, "little"), seed) % DIVISOR == 0 or i + 1 == len(lines):
                found.add((start, i + 1 - start))
                start = i + 1
    for i in range(len(lines)):
        if 0 < words[i] < long_words and sum(run := words[i : i + _reach(words, i, 1, long_words)]) >= MIN_WORDS and sum(map(bool, run)) > 1:
            found.add((i, len(run)))
    return sorted((s, n) for s, n in found if (w := sum(words[s : s + n])) >= (MIN_WORDS if n > 1 else long_words) and w)


def _found(docs: DataFrame, long_words: int) -> DataFrame:
    """(h1, h2, doc_id, start): every chunk by a 128-bit hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                lines = (text.as_py() or "").encode().split(b"\n")
                for start, n in chunks(lines, long_words):
                    h = xxhash.xxh3_128_intdigest(b"\n".join(lines[start : start + n]))
                    rows.append((h >> 64, h & (1 << 64) - 1, doc_id, start))
            if rows:
                columns = list(zip(*rows, strict=True))
                halves = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[:2]]
                rest = [pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32())]
                yield pa.RecordBatch.from_arrays([*halves, *rest], names=["h1", "h2", "doc_id", "start"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, start int")


def _texts(docs: DataFrame, long_words: int) -> DataFrame:
    """The chunks again with their bytes, and the lines before (nearest first) and after them.

    As many short lines are given on a side as make a chunk: what is farther off is in a chunk of its own or beside
    one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                lines = (text.as_py() or "").encode().split(b"\n")
                words = [len(x.split()) for x in lines]
                for start, n in chunks(lines, long_words):
                    body = b"\n".join(lines[start : start + n])
                    h = xxhash.xxh3_128_intdigest(body)
                    lo, hi = start - _reach(words, start - 1, -1, long_words), start + n + _reach(words, start + n, 1, long_words)
                    rows.append((h >> 64, h & (1 << 64) - 1, doc_id, start, n, body, lines[lo:start][::-1], lines[start + n : hi]))
            for at in range(0, len(rows), 2000):
                columns = list(zip(*rows[at : at + 2000], strict=True))
                halves = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[:2]]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
                rest = [pa.array(c, k) for c, k in zip(columns[2:], kinds, strict=True)]
                names = ["h1", "h2", "doc_id", "start", "n", "body", "before", "after"]
                yield pa.RecordBatch.from_arrays([*halves, *rest], names=names)

    schema = "h1 long, h2 long, doc_id long, start int, n int, body binary, before array<binary>, after array<binary>"
    return docs.mapInArrow(run, schema)


def _compared(pairs: DataFrame) -> DataFrame:
    """(doc_id, start, n) of the lines to remove: chunks equal to their first occurrence, grown on both sides."""

    def same(a: list[bytes], b: list[bytes]) -> int:
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
                doc_id, start, n, body, before, after, body0, before0, after0 = r
                if body == body0:
                    up, down = same(before, before0), same(after, after0)
                    rows.append((doc_id, start - up, n + up + down))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n"])

    return pairs.mapInArrow(run, "doc_id long, start int, n int")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only if the table is within BROADCAST_ROWS rows of a few numbers each."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def removals(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, spans: the runs of lines (start, n) of each document that occur earlier in the corpus."""
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    found = staged(_found(docs, long_words), "line-chunks")
    rows, keys, own = found.count(), ["h1", "h2"], ["doc_id", "start"]
    place = F.struct(*own)
    repeated = found.groupBy(keys).agg(F.min(place).alias("first"), F.count("*").alias("k")).where("k > 1")
    repeated = staged(repeated.select(*keys, "first", "k"), "line-repeats")
    ids = staged(spread_join(found, repeated.drop("first"), keys, "k", rows, own).select("doc_id").distinct(), "line-holders", (found,))
    holders = docs.join(_small(ids, ids.count()), "doc_id", "left_semi")
    # A chunk that many documents share is dealt to several tasks in each of these joins.
    texts = staged(spread_join(_texts(holders, long_words), repeated, keys, "k", rows, own), "line-texts", (ids, repeated))
    firsts = texts.where(place == F.col("first")).dropDuplicates(keys)
    firsts = firsts.select(*keys, "k", *(F.col(c).alias(f"{c}0") for c in ("body", "before", "after")))
    later = texts.where(place != F.col("first")).drop("first", "k")
    columns = ["doc_id", "start", "n", "body", "before", "after", "body0", "before0", "after0"]
    pairs = spread_join(later, firsts, keys, "k", rows, own).select(columns)
    spans = _compared(pairs).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return staged(spans, "line-spans", (texts,), 200)


def dedup_lines(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with the text that is left, n_lines, removed_lines and removed_words; every row stays.

    The first occurrence of a chunk (the smallest doc_id, then line) stays where it is, later ones go, also within
    one document. A copy of an earlier document thus loses its text but stays as a row. Null texts stay null; an
    empty table gives no rows. Rows that share a doc_id are told apart by nothing: what is removed from one is removed
    from each of them where it stands, and where their chunks tie as first occurrence each of them keeps it; rows with
    a null doc_id are left alone and shield nothing. Long texts are read whole. Other columns stay as they
    are, but for those named like the three new ones, which give way. ``long_words``: a line of so many words is a
    chunk of its own; a greater number leaves chunks of several lines alone.
    """
    docs = docs.drop("n_lines", "removed_lines", "removed_words")
    spans = removals(docs, long_words)
    n = spans.select(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    key, held = fresh(docs, "spans_of"), fresh(docs, "spans")
    spans = _small(spans.select(F.col("doc_id").alias(key), F.col("spans").alias(held)), n)
    joined = docs.join(spans, F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    kinds = {f.name: f for f in docs.schema.fields}
    names = [*kinds, "n_lines", "removed_lines", "removed_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for text, spans in zip(b.column("text"), b.column(held).to_pylist(), strict=True):
                text = text.as_py()
                if not spans or text is None:
                    texts.append(text)
                    counts.append((0 if text is None else text.count("\n") + 1, 0, 0))
                    continue
                lines = text.split("\n")
                gone = {i for s in spans for i in range(s["start"], s["start"] + s["n"])}
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
                lost = [lines[i] for i in gone if i < len(lines)]
                counts.append((len(lines), len(lost), sum(len(x.split()) for x in lost)))
            columns = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in kinds]
            columns += [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = T.StructType(list(docs.schema.fields))
    for c in names[len(kinds) :]:
        out = out.add(c, "long")
    return joined.select(*kinds, held).mapInArrow(run, out)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table with its texts as they are left, and their checksums."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "removed_lines", "removed_words", unsigned_crc(F.col("text")).alias("text_crc32"), "text")


QUERIES = {"op4_line_dedup": op4_line_dedup}
SQL: dict[str, str] = {}
