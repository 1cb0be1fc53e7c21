"""Joins of ratings, scores and indexes by normal ids, with the rules for what repeats or is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscope.functions.ids import norm_id, year_of

KEY = "_id"


def keyed(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with its normal id as ``_id``; rows without one are dropped."""
    return df.withColumn(KEY, norm_id(F.col(id_col))).where(F.col(KEY) != "")


def sheets(frames: dict[str, DataFrame], id_col: str = "doi_folder") -> DataFrame:
    """The rows of all sheets that hold ratings: not instructions, with an id column; headers are trimmed, blank ids dropped."""
    kept = []
    for name, df in frames.items():
        df = df.withColumnsRenamed({c: c.strip() for c in df.columns})
        if not name.lower().startswith("01") and "instruction" not in name.lower() and id_col in df.columns:
            kept.append(keyed(df, id_col))
    if not kept:
        raise ValueError(f"no sheet has a column {id_col}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)


def first_per_id(df: DataFrame, *order: Column) -> DataFrame:
    """One row of each id: the first by ``order``, as one struct a row and without a sort."""
    rest = [c for c in df.columns if c != KEY]
    return df.groupBy(KEY).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(KEY, "x.*")


def aligned(left: DataFrame, right: DataFrame, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """The ids of both sides with their columns; names that both have get the suffixes. Repeated ids multiply."""
    both = (set(left.columns) & set(right.columns)) - {KEY}
    left, right = (df.withColumnsRenamed({c: c + s for c in both}) for df, s in zip((left, right), suffixes, strict=True))
    return left.join(right, KEY)


def three_way(model: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    return aligned(first, second, ("_1", "_2")).join(model, KEY)


def pick_column(df: DataFrame, *candidates: str) -> str | None:
    """The first of some column names that is there, whatever its case."""
    known = {c.lower(): c for c in df.columns}
    return next((known[c.lower()] for c in candidates if c.lower() in known), None)


def index_meta(index: DataFrame, id_col: str, years: tuple[str, ...], domains: tuple[str, ...]) -> DataFrame:
    """_id, year, domain of an index by the first matching column names; what is missing is null. Of repeated ids the least."""
    d = keyed(index, id_col)
    year, domain = pick_column(d, *years), pick_column(d, *domains)
    y = year_of(F.col(year)) if year else F.lit(None).cast("int")
    name = F.nullif(F.trim(F.col(domain)), F.lit("")) if domain else F.lit(None).cast("string")
    return d.groupBy(KEY).agg(F.min(y).alias("year"), F.min(name).alias("domain"))


def with_year(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """Pairs with a known year; others are dropped."""
    return pairs.join(meta.where("year is not null").select(KEY, "year"), KEY)


def with_domain(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """All pairs with their domain, NA where it is unknown."""
    return pairs.join(meta.select(KEY, "domain"), KEY, "left").withColumn("domain", F.coalesce("domain", F.lit("NA")))


def work_items(dois: DataFrame, images: DataFrame, figures: DataFrame) -> DataFrame:
    """doi with image path and figure map, blank and empty where there is none."""
    d = dois.join(images, KEY, "left").join(figures, KEY, "left")
    return d.withColumns({"image": F.coalesce("image", F.lit("")), "figures": F.coalesce("figures", F.create_map().cast("map<string,string>"))})


def slice_items(items: DataFrame, start: int = 0, end: int | None = None, limit: int | None = None) -> DataFrame:
    """Items from ``start`` to ``end`` in the order of their ids, ``limit`` at most: the slices of a run."""
    n = None if end is None else max(0, end - start)
    n = limit if n is None else n if limit is None else min(n, limit)
    ordered = items.orderBy(KEY).offset(start)
    return ordered if n is None else ordered.limit(n)


def completed(items: DataFrame, results: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """One row for each item even where a run gave none: its status is crash_error there, other fields their defaults."""
    d = items.join(results, KEY, "left").withColumn("status", F.coalesce("status", F.lit("crash_error")))
    return d.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in defaults.items()})


def pending(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items without a result yet: what a resumed run still has to do."""
    return items.join(done.select(KEY).distinct(), KEY, "left_anti")


def complete_papers(files: DataFrame, needed: list[str]) -> DataFrame:
    """doi_safe of the papers all of whose ``needed`` artifacts are among ``files`` (doi_safe, artifact)."""
    there = files.where(F.col("artifact").isin(needed)).groupBy("doi_safe").agg(F.count_distinct("artifact").alias("n"))
    return there.where(F.col("n") == len(set(needed))).select("doi_safe")


def best_by_model(rows: DataFrame) -> DataFrame:
    """model, best spearman and qwk of either kind (srp, baseline) and their differences, for (model, kind, spearman, qwk)."""
    wide = rows.groupBy("model").pivot("kind", ["srp", "baseline"]).agg(F.max("spearman").alias("spearman"), F.max("qwk").alias("qwk"))
    delta = {f"delta_{m}": F.round(F.col(f"srp_{m}") - F.col(f"baseline_{m}"), 6) for m in ("spearman", "qwk")}
    return wide.withColumns(delta).orderBy(F.desc_nulls_last("srp_spearman"))
