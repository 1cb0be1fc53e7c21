"""Token-ID output: Arrow stream files of equal-length sequences with masks, read back without copying.

A shard is two files. ``*.sequences.arrows`` is an Arrow stream whose record batches hold ``ids`` and ``mask`` as
fixed-size lists of ``seq_len``: sequence i is in batch i // ``batch_rows`` at a fixed place, so a memory map gives
any sequence without copying or scanning. The documents of a shard lie end to end in these sequences; only the
last one is padded, with mask false. ``*.documents.arrows`` has doc_id, start (in the shard) and n_tokens.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, ready, shared_dir, table
from .tokens import encoder

SEQ_LEN, BATCH_ROWS, END_ID = 2048, 64, 2


class ShardWriter:
    """Writes one shard, a batch of sequences at a time; memory is bounded by a batch and one document."""

    def __init__(self, stem: str, dtype: str = "uint16", seq_len: int = SEQ_LEN, batch_rows: int = BATCH_ROWS) -> None:
        fs, path = pafs.FileSystem.from_uri(stem)
        fs.create_dir(path.rpartition("/")[0])
        self.seq_len, self.batch_rows, self.dtype = seq_len, batch_rows, np.dtype(dtype)
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = fs.open_output_stream(f"{path}.sequences.arrows")
        self.docs_out = fs.open_output_stream(f"{path}.documents.arrows")
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.docs_stream = pa.ipc.new_stream(self.docs_out, self.docs_schema)
        self.held, self.n_held, self.n_tokens, self.n_docs, self.index = [], 0, 0, 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.n_tokens, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        self.n_docs += 1
        if self.n_held >= self.seq_len * self.batch_rows:
            self._flush(False)
        if len(self.index) >= 65_536:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        flat = np.concatenate([np.empty(0, self.dtype), *self.held])
        size = self.seq_len * self.batch_rows
        whole = len(flat) if last else len(flat) // size * size
        for at in range(0, whole, size):
            part = flat[at : min(at + size, whole)]
            rows = -(-len(part) // self.seq_len)
            ids, mask = np.zeros(rows * self.seq_len, self.dtype), np.zeros(rows * self.seq_len, bool)
            ids[: len(part)], mask[: len(part)] = part, True
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask)]
            self.stream.write_batch(pa.record_batch(columns, schema=self.schema))
        self.held, self.n_held = [flat[whole:].copy()], len(flat) - whole

    def _flush_index(self) -> None:
        columns = [pa.array(c, pa.int64()) for c in zip(*self.index, strict=True)] if self.index else []
        if columns:
            self.docs_stream.write_batch(pa.record_batch(columns, schema=self.docs_schema))
        self.index = []

    def close(self) -> None:
        self._flush(True)
        self._flush_index()
        for x in (self.stream, self.docs_stream, self.out, self.docs_out):
            x.close()


class ShardReader:
    """A shard's sequences and documents; local files are memory-mapped and not copied."""

    def __init__(self, stem: str) -> None:
        fs, path = pafs.FileSystem.from_uri(stem)
        opened = pa.memory_map if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
        self.sources = [opened(f"{path}.{kind}.arrows") for kind in ("sequences", "documents")]
        with pa.ipc.open_stream(self.sources[0]) as s:
            self.schema, self.batches = s.schema, list(s)
        with pa.ipc.open_stream(self.sources[1]) as s:
            self.documents = s.read_all()
        self.seq_len = self.schema.field("ids").type.list_size
        self.flat = [b.column("ids").values.to_numpy() for b in self.batches]
        self.size = len(self.flat[0]) if self.flat else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The ids (a view of the file) and the mask of sequence i."""
        batch, row = divmod(i, self.size // self.seq_len)
        mask = self.batches[batch].column("mask").values.slice(row * self.seq_len, self.seq_len)
        return self.flat[batch][row * self.seq_len : (row + 1) * self.seq_len], mask

    def tokens(self, start: int, n: int) -> np.ndarray:
        """The n ids from ``start`` on: a view within a batch, else a copy."""
        found = []
        while n > 0:
            batch, at = divmod(start, self.size)
            found.append(self.flat[batch][at : at + n])
            start, n = start + len(found[-1]), n - len(found[-1])
        return found[0] if len(found) == 1 else np.concatenate([np.empty(0, "uint16"), *found])


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    dtype: str = "uint16",
    seq_len: int = SEQ_LEN,
) -> list[tuple[int, str, int, int]]:
    """Writes the ids of ``docs`` in ascending doc_id order as shards under ``path``; gives (shard, stem, docs, tokens).

    A null text counts as empty and gets its end id alone; a null doc_id comes first; rows with one doc_id stand in an
    order of their texts' hashes and may be in several shards; an empty table gives no shard; long texts are written
    whole; other columns are ignored, whatever their names. Each attempt of a task writes files of its own, and only
    those of attempts that succeeded are listed, so lost executors leave no half-written shard in it. ``dtype`` must
    hold every id, or a ValueError is raised. The list has one row for each range partition.
    """
    spark = docs.sparkSession
    ready(spark)
    if max(encoder(tokenizer).largest(), end_id) > np.iinfo(dtype).max:
        raise ValueError(f"{dtype} does not hold every id of the tokenizer")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, code = TaskContext.get().partitionId(), None, encoder(tokenizer)
        stem = f"{path}/{shard:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], dtype)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                writer = writer or ShardWriter(stem, dtype, seq_len)
                ids = np.frombuffer(code.encode(text.as_py()), "<u4").astype(dtype)
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer:
            writer.close()
            row = [pa.array([shard], pa.int32()), *(pa.array([x]) for x in (stem, writer.n_docs, writer.n_tokens))]
            yield pa.RecordBatch.from_arrays(row, names=["shard", "stem", "n_docs", "n_tokens"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    ordered = keyed.repartitionByRange(partitions(spark), "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    done = ordered.select("doc_id", "text").mapInArrow(write, "shard int, stem string, n_docs long, n_tokens long")
    return sorted(tuple(r) for r in done.collect())


def read_documents(spark: SparkSession, shards: list[tuple[int, str, int, int]]) -> DataFrame:
    """doc_id, start (in all documents), n_tokens and ids_crc32 of every document, from the files alone."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    rows, base = [], 0
    for _, stem, _, n_tokens in shards:
        rows.append((stem, base))
        base += n_tokens
    jobs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "stem string, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stem, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shard = ShardReader(stem)
                for d in shard.documents.to_batches(max_chunksize=20_000):
                    start, n = d.column("start").to_numpy(), d.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(shard.tokens(s, k).astype("<u4")) for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                    columns = [d.column("doc_id"), pa.array(start + base), d.column("n_tokens"), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return jobs.mapInArrow(read, schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_token_files(table(spark, sf_dir, "documents"), shared_dir(spark, "token-files"))
    return read_documents(spark, shards)


QUERIES = {"op2_token_files": op2_token_files}
SQL: dict[str, str] = {}
