"""URL rules, and exact list membership by a cascade of Bloom filters.

Level 1 encodes the listed keys; level 2 the keys of the corpus that level 1 takes for listed by mistake; level 3
the listed keys that level 2 holds by mistake; and so on until no key of the corpus is mistaken. For every key of
that universe the cascade then gives the exact answer, so the corpus needs no join with the list. To build it, every
key of the corpus is looked up in level 1, which is made of the list alone; only the keys that it holds, those listed
and about one in twenty others, are compared with the list.

Keys are dealt to shards by their hash, about ``keys_per_shard`` each, and each shard has a cascade of its own, built
by one task. Filters of up to ``broadcast_bytes`` together are broadcast. Beyond that the rows are dealt by shard and
a salt (a hot key spreads over tasks), and each task reads the filters of its shards from the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, partitions, ready, shared_dir, staged, table

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
HASHES, RATE = 4, 0.05
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _bits(h1: np.ndarray, h2: np.ndarray, level: int, i: int, m: int) -> np.ndarray:
    """The i-th bit of each key in a filter of m bits at a level: a fresh mix of the key's 128-bit hash."""
    with np.errstate(over="ignore"):
        x = h1.view(np.uint64) + h2.view(np.uint64) * np.uint64(2 * i + 1) + np.uint64(level * 64 + i + 1) * _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return (x ^ (x >> np.uint64(31))) % np.uint64(m)


def _held(words: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    held = np.ones(len(h1), bool)
    for i in range(HASHES):
        at = _bits(h1, h2, level, i, len(words) * 8)
        held &= (words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return held


def build_cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray, most: int | None = None) -> list[bytes]:
    """Filters by level, ``most`` at most, for the distinct keys of one shard."""
    levels: list[bytes] = []
    inside, outside = (h1[listed], h2[listed]), (h1[~listed], h2[~listed])
    while len(inside[0]) and len(levels) != most:
        m = max(64, int(-len(inside[0]) * HASHES / np.log(1 - RATE ** (1 / HASHES))))
        words = np.zeros(-(-m // 8), np.uint8)
        for i in range(HASHES):
            at = _bits(*inside, len(levels), i, len(words) * 8)
            np.bitwise_or.at(words, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        wrong = _held(words, *outside, len(levels))
        levels.append(words.tobytes())
        inside, outside = (outside[0][wrong], outside[1][wrong]), inside
    return levels


def in_cascade(levels: list[bytes], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact for the keys that the cascade was built over."""
    listed, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
    for level, words in enumerate(levels):
        held = _held(np.frombuffer(words, np.uint8), h1[open_], h2[open_], level)
        listed[open_[~held]] = level % 2 == 1
        open_ = open_[held]
    listed[open_] = len(levels) % 2 == 1
    return listed


def keyed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit("second")).alias("h2")]


class Filters:
    """Filters of all shards by level: broadcast up to ``broadcast_bytes`` together, else read by the tasks they concern."""

    def __init__(self, keys: DataFrame, shards: int, broadcast_bytes: int, most: int | None = None) -> None:
        """``keys``: distinct h1, h2 and whether they are listed."""

        def build(key: tuple, t: pa.Table) -> pa.Table:
            got = build_cascade(*(np.ascontiguousarray(t.column(c).to_numpy()) for c in ("h1", "h2", "listed")), most)
            shard = pa.array([key[0].as_py()] * len(got), pa.int32())
            return pa.table({"shard": shard, "level": pa.array(range(len(got)), pa.int32()), "bits": pa.array(got, pa.binary())})

        spark = keys.sparkSession
        dealt = keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
        self.path, self.shards = shared_dir(spark, "url-filters"), shards
        dealt.groupBy("shard").applyInArrow(build, "shard int, level int, bits binary").write.partitionBy("shard").parquet(self.path)
        stored = spark.read.schema("level int, bits binary, shard int").parquet(self.path)
        self.small = (stored.agg(F.sum(F.length("bits"))).first()[0] or 0) <= broadcast_bytes
        held: dict[int, list[bytes]] = {}
        if self.small:
            for r in sorted(stored.collect(), key=lambda r: r["level"]):
                held.setdefault(r["shard"], []).append(r["bits"])
        self.known = spark.sparkContext.broadcast(held if self.small else None)

    def look_up(self, rows: DataFrame, h1: str, h2: str, out: str, salts: int) -> DataFrame:
        """``rows`` without their hashes h1 and h2, with ``out``: whether the filters hold them (null hashes: false)."""
        path, shards, small, known = self.path, self.shards, self.small, self.known
        names = [c for c in rows.columns if c not in (h1, h2)]
        if not small:
            shard = F.pmod(h1, F.lit(shards))
            deal = F.pmod(F.hash(*rows.columns), F.lit(salts))  # a hot key spreads over tasks
            rows = rows.repartition(partitions(rows.sparkSession), shard, deal).sortWithinPartitions(shard)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded: dict[int, list[bytes]] = {}
            for b in batches:
                x, y = (b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in (h1, h2))
                held, shard = np.zeros(len(x), bool), x % shards
                for s in np.unique(shard).tolist():
                    if not small and s not in loaded:
                        loaded = {s: _load(path, s)}
                    levels = known.value.get(s, []) if small else loaded[s]
                    at = np.flatnonzero(shard == s)
                    held[at] = in_cascade(levels, x[at], y[at])
                held &= b.column(h1).is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(held)], names=[*names, out])

        return rows.mapInArrow(look, rows.select(*names, F.lit(True).alias(out)).schema)


def _load(path: str, shard: int) -> list[bytes]:
    import pyarrow.dataset as ds
    import pyarrow.fs as pafs

    fs, at = pafs.FileSystem.from_uri(f"{path}/shard={shard}")
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return []
    rows = ds.dataset(at, filesystem=fs, format="parquet").to_table(["level", "bits"]).to_pylist()
    return [r["bits"] for r in sorted(rows, key=lambda r: r["level"])]


def with_listed(
    df: DataFrame, key: Column, listed: DataFrame, keys_per_shard: int = 500_000, broadcast_bytes: int = 64 << 20, salts: int = 64
) -> DataFrame:
    """``df`` with ``listed``: whether its key is in the one-column table ``listed``; exact, null keys are not listed.

    A column of ``df`` named ``listed`` gives way.
    """
    spark = df.sparkSession
    ready(spark)
    on_list = listed.where(F.col(listed.columns[0]).isNotNull()).select(*keyed(F.col(listed.columns[0]))).distinct()
    on_list = staged(on_list.withColumn("listed", F.lit(True)), "url-list")
    shards = max(1, -(-on_list.count() // keys_per_shard))
    first = Filters(on_list, shards, broadcast_bytes, 1)
    seen = df.where(key.isNotNull()).select(*keyed(key)).distinct()
    held = first.look_up(seen.select("h1", "h2", F.col("h1").alias("k1"), F.col("h2").alias("k2")), "k1", "k2", "held", salts)
    wrong = held.where("held").select("h1", "h2").join(on_list, ["h1", "h2"], "left_anti").withColumn("listed", F.lit(False))
    keys = staged(on_list.union(wrong), "url-keys", (on_list,))
    filters = Filters(keys, shards, broadcast_bytes)
    rows = df.drop("listed")
    h1, h2 = fresh(rows, "h1"), fresh(rows, "h2")
    hashes = [F.when(key.isNotNull(), c).alias(n) for c, n in zip(keyed(key), (h1, h2), strict=True)]
    return filters.look_up(rows.select("*", *hashes), h1, h2, "listed", salts)


def filter_urls(pages: DataFrame, listed_hosts: DataFrame, rules: tuple = RULES, **sizes: int) -> DataFrame:
    """page_id, host, path, rule, verdict, listed: a rule's verdict, else block for listed hosts and allow for others.

    A null url, or one without ``://``, has empty host and path, fits no rule and is on no list: allow. Repeated
    rows are judged alike, whatever their ids (null too); of rules of one length the later in ``rules`` wins; long urls are
    read whole; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    judged = with_listed(parsed, F.nullif(F.col("host"), F.lit("")), listed_hosts, **sizes)
    chosen = F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", rule.alias("rule"), chosen.alias("verdict"), "listed")


def stand_in_list(pages: DataFrame) -> DataFrame:
    """Stands in for a host list, which the tables lack: hosts whose MD5 starts with 0 to 3, about one in four."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    return hosts.where(F.md5(F.col("host").cast("binary")) < "4")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, stand_in_list(pages))


def _sql() -> str:
    fits = {f"{h}{p}": f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in RULES}
    what = {f"{h}{p}": w for w, h, p in RULES}
    order = sorted(fits, key=len, reverse=True)
    rule = " ".join(f"WHEN {fits[r]} THEN '{r}'" for r in order)
    verdict = " ".join(f"WHEN {fits[r]} THEN '{what[r]}'" for r in order)
    return f"""
WITH parsed AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '{URL}', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '{URL}', 2), '') AS path
  FROM pages),
judged AS (SELECT *, host <> '' AND md5(host) < '4' AS listed FROM parsed)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM judged"""


QUERIES = {"op8_url_filter": op8_url_filter}
SQL = {"op8_url_filter": _sql()}
