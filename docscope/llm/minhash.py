"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

Each document's shingle set gets ``HASHES`` minima. Bands of the full minima give candidates; of each minimum two
low bits are kept, packed into a signature, and the share of equal pairs of bits, corrected for chance
collisions, estimates the similarity. Candidates far below the threshold by this estimate are dropped; the rest
are confirmed on the full sets.

Documents with one set are one node. Three steps find every link that matters for the components:

1. In each bucket (documents that agree in a band) all members are compared with the smallest. A group of n
   near copies costs n comparisons a band here, not n squared.
2. Members of one bucket in different components after this are compared with each other by their signatures, in
   blocks, inside a task; the ``CLOSEST`` of each member by estimate are confirmed. Members of the bucket's largest
   component are compared with those outside it only.
3. All pairs still in different components that the estimate leaves standing are confirmed.

A link within a component that is found already is not needed. No bucket is capped. Joins by a leader, a band or a set
that many rows share are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, drop, partitions, ready, spread_join, staged, table
from .words import mix, word_hashes

BANDS, ROWS, SHINGLE, PERCENT = 22, 4, 4, 80
HASHES = 128
#: Candidates whose estimate is under this are dropped: 4.7 standard deviations below 0.8 with 128 hashes.
ESTIMATE = 0.6
BLOCK, CLOSEST, CLOSEST_ROUNDS = 4096, 2, 1
#: Members of buckets with several components get wide signatures, whose estimates err by a third as much.
WIDE, WIDE_ESTIMATE = 1024, 0.74
#: Forests of so many links are solved by one task; larger ones by rounds of joins.
FOREST_LINKS = 300_000
#: Rows of an Arrow batch that holds two full sets a row, and bytes of sets that a task gives at a time.
SET_ROWS, SET_BYTES = 100, 4 << 20
_ODD = np.random.default_rng(7).integers(1, 1 << 63, (2, HASHES), dtype=np.uint64) | np.uint64(1)
_WIDE_ODD = np.random.default_rng(8).integers(1, 1 << 63, (2, WIDE), dtype=np.uint64) | np.uint64(1)
FEATURES = "doc_id long, n_shingles long, set_a long, set_b long, sig binary, bands array<long>"


def shingle_sets(column: pa.Array, words: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each whole text the sorted distinct 64-bit hashes of its shingles; with fewer words, of the whole sequence.

    Words are runs of other bytes than ASCII white space, with A-Z lower-cased.
    """

    def joined(h: np.ndarray, k: int) -> np.ndarray:
        s = h[: len(h) - k + 1]
        with np.errstate(over="ignore"):
            for i in range(1, k):
                s = mix(s) + h[i : len(h) - k + 1 + i] * np.uint64(2 * i + 1)
        return mix(s + np.uint64(k))

    for _, _, h, bounds in word_hashes(column):
        every = joined(h, words) if len(h) >= words else None
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo >= words:
                yield np.unique(every[lo : hi - words + 1])
            else:
                yield joined(h[lo:hi], hi - lo) if hi > lo else np.empty(0, np.uint64)


def signature(s: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The packed two low bits of each minimum, and the hash of each band of minima."""
    mixed = minima(s, _ODD)
    with np.errstate(over="ignore"):
        band = np.zeros(BANDS, np.uint64)
        for r in range(ROWS):
            band = mix(band * np.uint64(3) + mixed[r : BANDS * ROWS : ROWS])
        band = mix(band + np.arange(BANDS, dtype=np.uint64))
    return packed(mixed), band.view(np.int64)


def packed(mixed: np.ndarray) -> bytes:
    bits = (mixed & np.uint64(3)).astype(np.uint8).reshape(-1, 4)
    return (bits[:, 0] | bits[:, 1] << 2 | bits[:, 2] << 4 | bits[:, 3] << 6).astype(np.uint8).tobytes()


def minima(s: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The mixed minimum of each hash over a set."""
    found = np.empty(odd.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 16):
            a, b = (x[at : at + 16, None] for x in odd)
            low = None
            for part in range(0, len(s), 4096):  # bounded memory for very long texts
                x = s[None, part : part + 4096] * a
                x = (x ^ (x >> np.uint64(32))) * b
                m = x.min(axis=1)
                low = m if low is None else np.minimum(low, m)
            found[at : at + 16] = low
    return mix(found)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures (rows of bytes) by counting equal pairs of bits."""
    x = one ^ many
    differ = np.bitwise_count((x | x >> 1) & np.uint8(0x55)).sum(axis=-1, dtype=np.int64)
    return ((1 - differ / (4 * one.shape[-1])) - 0.25) / 0.75


def _rows(c: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1)


def features(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            sets, sigs, bands = np.zeros((b.num_rows, 2), np.uint64), [], []
            for i, s in enumerate(shingle_sets(b.column(1), words)):
                n[i] = len(s)
                if len(s):
                    whole = xxhash.xxh3_128_intdigest(s)
                    sets[i] = whole >> 64, whole & (1 << 64) - 1
                    sig, band = signature(s)
                    sigs.append(sig)
                    bands.append(band)
                else:
                    sigs.append(None)
            none = n == 0
            columns = [b.column(0), pa.array(n), *(pa.array(x.view(np.int64), mask=none) for x in np.ascontiguousarray(sets.T)), pa.array(sigs, pa.binary())]
            flat = np.concatenate([np.empty(0, np.int64), *bands])
            at = np.concatenate([[0], np.cumsum(~none)]).astype(np.int32) * BANDS
            columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FEATURES)


def _with_sides(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Staged ``pairs`` (a, b) with the columns of both documents as <column>_a and <column>_b; a document in many pairs is dealt."""
    rows = pairs.count()
    for side in ("b", "a"):
        n = pairs.groupBy(side).agg(F.count("*").alias("__n"))
        right = table.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)).join(n, side)
        given = pairs if side == "b" else out
        out = spread_join(given, right, [side], "__n", rows, ["a", "b"]).drop("__n")
    return out


def _near(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate and sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = estimates(_rows(b.column("sig_a")), _rows(b.column("sig_b"))) >= ESTIMATE - (80 - percent) / 100
                yield b.select(["a", "b"]).filter(pa.array(ok))

    sizes = (100 * F.least("n_shingles_a", "n_shingles_b")) >= percent * F.greatest("n_shingles_a", "n_shingles_b")
    sides = _with_sides(pairs, sigs, ["sig", "n_shingles"])
    return sides.where(sizes).select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _holding(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids: texts are not shuffled unless there are too many ids to broadcast."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")


def _wide(docs: DataFrame, sigs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles and wide signature of the members of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [packed(minima(s, _WIDE_ODD)) for s in shingle_sets(b.column(1), words)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["doc_id", "sig"])

    ids = members.select("doc_id").distinct()
    texts = _holding(docs, staged(ids, "wide-ids"))
    wide = texts.mapInArrow(run, "doc_id long, sig binary").dropDuplicates(["doc_id"])
    return staged(wide.join(sigs.select("doc_id", "n_shingles", "bands"), "doc_id"), "wide-signatures")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame | None:
    """Pairs (a, b) that are linked by their full sets; None of none. Only texts of documents in pairs are shuffled."""
    pairs = staged(pairs, "near-pairs")
    if not pairs.limit(1).count():
        return None
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-ids")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, held, size = 0, [], 0
            for i, s in enumerate(shingle_sets(b.column(1), words)):
                held.append(s.tobytes())
                size += len(held[-1])
                if size > SET_BYTES or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0)[first : i + 1], pa.array(held, pa.binary())], names=["doc_id", "set"])
                    first, held, size = i + 1, [], 0

    full = staged(_holding(docs, ids).mapInArrow(sets, "doc_id long, set binary"), "near-sets", (ids,))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(small) else 0
                ok.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    linked = staged(_with_sides(pairs, full, ["set"]).mapInArrow(check, "a long, b long"), "links", (pairs, full), SET_ROWS)
    return linked if linked.limit(1).count() else None


def forest(edges: DataFrame) -> DataFrame:
    """(doc_id, component) by union-find over each partition's links: of one partition, the components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = up = root[up]
                x = up
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        if root:
            nodes = list(root)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([find(x) for x in nodes])], names=["doc_id", "component"])

    return edges.select("a", "b").mapInArrow(run, "doc_id long, component long")


def components(edges: DataFrame, rounds: int = 50, at_once: int = FOREST_LINKS) -> DataFrame:
    """(doc_id, component) of every node in ``edges`` (a, b): the smallest node reachable.

    Up to ``at_once`` links are solved by one task. More are first reduced to a forest in each partition; then each
    round takes the smallest label among the neighbours and that label's own label until nothing changes.
    Labels are written to the shared folder each round.
    """
    ready(edges.sparkSession)
    edges = staged(edges, "edges")
    if edges.count() <= at_once:
        return staged(forest(edges.coalesce(1)), "labels", (edges,))
    edges = forest(edges).where("doc_id <> component").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
    edges = staged(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("doc_id")).agg(F.least("doc_id", F.min("b")).alias("component")), "labels")
    for _ in range(rounds):
        near = edges.join(labels, edges.b == labels.doc_id).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near, labels.doc_id == near.a).select("doc_id", F.least("component", "near").alias("low"), "component")
        low = staged(low, "labels-low")
        jump = low.select(F.col("doc_id").alias("low"), F.col("low").alias("lower"))
        new = staged(
            low.join(jump, "low", "left").select("doc_id", F.coalesce("lower", "low").alias("new"), "component"), "labels"
        )
        changed = new.where("new <> component").limit(1).count()
        labels = new.select("doc_id", F.col("new").alias("component"))
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def _mixed(postings: DataFrame, comps: DataFrame | None) -> DataFrame:
    """band, doc_id, component of the members of buckets with several components, the bucket's largest one and blocks."""
    rows = postings.count()
    labelled = postings.select("band", "doc_id", F.col("doc_id").alias("component"))
    if comps is not None:
        known = comps.select(F.col("doc_id").alias("node"), F.col("component").alias("label"))
        labelled = postings.join(known, postings.doc_id == known.node, "left").select(
            "band", "doc_id", F.coalesce("label", "doc_id").alias("component")
        )
    each = labelled.groupBy("band", "component").agg(F.count("*").alias("n"))
    mixed = each.groupBy("band").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select(
        "band", "n", F.col("most.component").alias("main"), blocks(F.col("most.n")).alias("main_blocks"), blocks(F.col("n") - F.col("most.n")).alias("blocks")
    )
    return staged(spread_join(labelled, mixed, ["band"], "n", rows, ["doc_id"]).drop("n"), "mixed-buckets")


def _across(mixed: DataFrame, sigs: DataFrame, percent: int, closest: int | None) -> DataFrame:
    """Pairs in one bucket but in different components that the estimate leaves standing, block against block.

    With ``closest``, only so many of each member and block, by estimate.
    """
    rows = mixed.join(sigs, "doc_id")
    # A member of block i is sent to the tasks of all pairs of blocks with i: buckets of one block go to one task.
    # Blocks of the largest component come last, and are paired with those outside it only.
    inside, member = F.col("component") == F.col("main"), F.xxhash64("doc_id", "band")
    block = F.when(inside, F.col("blocks") + F.pmod(member, F.col("main_blocks"))).otherwise(F.pmod(member, F.col("blocks"))).cast("int")
    last = F.when(inside, F.col("blocks") - 1).otherwise(F.col("blocks") + F.col("main_blocks") - 1)
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select(
        "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "component", "sig", "n_shingles", "bands"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task of blocks; one such group is held at a time."""
        held: list[pa.RecordBatch] = []
        key = None

        def pairs() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            ids, comp, block, n = (t.column(c).to_numpy() for c in ("doc_id", "component", "block", "n_shingles"))
            sig = _rows(t.column("sig"))
            bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            before = bands[:, : int(np.argmax(bands[0] == key[0]))]  # a pair is compared in the first band it shares
            i, j = key[1:]
            for at in range(len(ids)):
                ok = (comp != comp[at]) & (100 * np.minimum(n, n[at]) >= percent * np.maximum(n, n[at]))
                if i == j and not closest:
                    ok &= ids > ids[at]
                elif i != j:
                    ok &= block != block[at] if closest or block[at] == i else False
                where = np.flatnonzero(ok)
                where = where[~(before[where] == before[at]).any(axis=1)]
                if len(where):
                    near = estimates(sig[at], sig[where])
                    where, near = where[good := near >= WIDE_ESTIMATE - (80 - percent) / 100], near[good]
                    if closest and len(where) > closest:
                        where = where[np.argpartition(-near, closest - 1)[:closest]]
                if len(where):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(ids[at], ids[where])), pa.array(np.maximum(ids[at], ids[where]))], names=["a", "b"]
                    )

        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("band", "i", "j")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if b.num_rows else []
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if hi > lo:
                    new = tuple(int(c[lo]) for c in cols)
                    if new != key and held:
                        yield from pairs()
                        held = []
                    key = new
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield from pairs()

    n = partitions(mixed.sparkSession)
    dealt = rows.repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    Null, empty and wordless texts have no shingles and are linked with nothing. Rows with one doc_id are one
    document's copies if their sets are equal and otherwise rows of one component. Rows with a null doc_id are linked
    by equal sets alone; without an equal set their component is null and they are kept. Ties cannot occur: the
    smallest doc_id of a component is kept. Long texts are read whole. An empty table gives no rows; other
    columns are ignored. Sets are compared by 64-bit hashes of their shingles.
    """
    spark = docs.sparkSession
    ready(spark)
    feats = staged(features(docs, words), "minhash")
    some = feats.where("n_shingles > 0")
    firsts = some.groupBy("set_a", "set_b").agg(
        F.min_by(F.struct("n_shingles", "sig", "bands"), "doc_id").alias("x"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")
    )
    reps = staged(firsts.select("set_a", "set_b", "copies", "doc_id", "x.*"), "minhash-sets")
    sigs = reps.select("doc_id", "n_shingles", "sig", "bands").where("doc_id is not null")
    postings = reps.where("doc_id is not null").select("doc_id", F.explode("bands").alias("band"))
    leaders = postings.groupBy("band").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    dealt = spread_join(postings, leaders, ["band"], "n", BANDS * reps.count(), ["doc_id"])
    postings = staged(dealt.select("band", "doc_id", "a"), "postings")
    pairs = staged(postings.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "leader-pairs")
    texts = docs.select("doc_id", "text")
    edges = _confirmed(_near(pairs, sigs, percent), texts, percent, words)
    comps = components(edges) if edges else None
    members = mixed = _mixed(postings, comps)
    wide = _wide(texts, sigs, members, words)
    for closest in (*[CLOSEST] * CLOSEST_ROUNDS, None):
        more = _confirmed(_across(mixed, wide, percent, closest), texts, percent, words)
        if more:
            edges = edges.union(more) if edges else more
            comps = components(edges)
            mixed = _mixed(members.select("band", "doc_id"), comps)
    for old in (postings, pairs, wide, members, mixed):
        drop(old)
    if comps is None:
        comps = spark.createDataFrame([], "doc_id long, component long")
    comps = comps.select(F.col("doc_id").alias("node"), "component")
    nodes = reps.select("set_a", "set_b", "copies", F.col("doc_id").alias("node"))
    sets = nodes.join(comps, "node", "left").select("set_a", "set_b", "copies", F.coalesce("component", "node").alias("component"))
    rows = feats.select("doc_id", "n_shingles", "set_a", "set_b")
    out = spread_join(rows, sets, ["set_a", "set_b"], "copies", rows.count(), ["doc_id"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_minhash": op3_minhash}
SQL: dict[str, str] = {}
