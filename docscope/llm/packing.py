"""Packing: shortest-pack-first over the length histogram, joined back to the documents' pieces by rank.

Documents are cut into full sequences and a remainder. Only the histogram of piece lengths (at most ``max_len``
bins) reaches the driver. Lengths are placed longest first, each into the shortest pack, the one with the most room; where
it does not fit there, it opens a new pack. Equal packs are one pattern with a count, so the work depends on the bins and
not on the pieces. The n-th piece of a length then takes the n-th place that the patterns give this length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, staged, table
from .token_files import END_ID
from .tokens import encoder

MAX_LEN = 4096
PIECES = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local_rank long"


def cut_pieces(docs: DataFrame, max_len: int = MAX_LEN, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``max_len`` ids with their rank among the pieces of their length in their partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, code, end = TaskContext.get().partitionId(), encoder(tokenizer), end_id.to_bytes(4, "little")
        seen: dict[int, int] = {}
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = code.encode(text.as_py()) + end
                n = len(ids) // 4
                for start in range(0, n, max_len):
                    length = min(max_len, n - start)
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    rows.append((part, doc_id, start, length, crc, n, rank))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int32(), *[pa.int64()] * 6]
                names = [x.split()[0] for x in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def pack_histogram(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[tuple[int, ...], int]]:
    """(pattern of lengths, count) so that the patterns hold every length as often as the histogram says.

    Longest first; a length goes to the packs with the fewest tokens, one to each in turn, as many at a time as
    both counts allow; what does not fit in them fits nowhere and opens new packs.
    """
    open_packs: dict[int, dict[tuple[int, ...], int]] = {}  # room -> pattern -> count
    rooms: list[int] = []  # sorted, those with packs
    closed: dict[tuple[int, ...], int] = {}

    def put(pattern: tuple[int, ...], room: int, count: int) -> None:
        if room == 0:
            closed[pattern] = closed.get(pattern, 0) + count
            return
        if room not in open_packs:
            open_packs[room] = {}
            bisect.insort(rooms, room)
        open_packs[room][pattern] = open_packs[room].get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if not rooms or rooms[-1] < length:
                each = max_len // length
                if left >= each:
                    put((length,) * each, max_len - each * length, left // each)
                if left % each:
                    put((length,) * (left % each), max_len - (left % each) * length, 1)
                break
            room = rooms[-1]
            pattern, count = next(iter(open_packs[room].items()))
            # These packs stay the shortest until they reach the next room: so many copies go to each of them in turn.
            later = rooms[-2] if len(rooms) > 1 and len(open_packs[room]) == 1 else room if len(open_packs[room]) > 1 else 0
            fit = max(1, min((room - later) // length, room // length, left // count))
            used = min(count, left // fit)
            if used == count:
                del open_packs[room][pattern]
                if not open_packs[room]:
                    del open_packs[room], rooms[-1]
            else:
                open_packs[room][pattern] = count - used
            put(pattern + (length,) * fit, room - fit * length, used)
            left -= used * fit
    for patterns in open_packs.values():
        for pattern, count in patterns.items():
            closed[pattern] = closed.get(pattern, 0) + count
    return sorted(closed.items(), reverse=True)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks, first sequences and offsets of the runs of places that the patterns give it."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            runs.setdefault(length, []).append((given.get(length, 0), sequence, offset))
            given[length] = given.get(length, 0) + count
            offset += length
        sequence += count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def pack(docs: DataFrame, max_len: int = MAX_LEN, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: each piece and its place in a sequence.

    A null or empty text is its end id alone. Rows with one doc_id, or with a null one, are documents of their own.
    Pieces of one length are interchangeable, so ties change nothing but which of them stands where. Long texts are
    cut into whole sequences and a remainder. An empty table gives no rows. Columns other than doc_id and text are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    ready(spark)
    pieces = staged(cut_pieces(docs, max_len, tokenizer), "pieces")
    counts = staged(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    # At most max_len bins.
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    runs = spark.sparkContext.broadcast(places(pack_histogram(histogram, max_len)))
    # A running count for each length over the partitions: a length has one row for each partition at most.
    before = counts.selectExpr("length", "part", "sum(n) over (partition by length order by part) - n as base")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(0).to_numpy(), b.column(1).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, seqs, offsets = runs.value[int(length[rows[0]])]
                run = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = seqs[run] + rank[rows] - first[run], offsets[run]
            names = [*b.schema.names[2:], "length", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], b.column(0), pa.array(sequence), pa.array(offset)], names=names)

    ranked = pieces.join(before, ["length", "part"]).select(
        "length", (F.col("base") + F.col("local_rank")).alias("rank"), "doc_id", "start", "ids_crc32", "doc_tokens"
    )
    out = "doc_id long, start long, ids_crc32 long, doc_tokens long, length long, sequence_id long, offset long"
    return ranked.mapInArrow(place, out).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
SQL: dict[str, str] = {}
