"""Agreement of raters: confusion, kappa, rank correlation, distributions, severity and consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qwk(a: Column, b: Column) -> Column:
    """Quadratic-weighted kappa from sums alone; null where its denominator is 0. Incomplete pairs do not count."""
    ok = a.isNotNull() & b.isNotNull()
    a, b = (F.when(ok, x).cast("double") for x in (a, b))
    n = F.count(a)
    bottom = n * F.sum(a * a) + n * F.sum(b * b) - 2 * F.sum(a) * F.sum(b)
    return F.when(bottom != 0, 1 - n * F.sum((a - b) * (a - b)) / F.nullif(bottom, F.lit(0.0)))


def exact_pct(a: Column, b: Column) -> Column:
    return F.round(100.0 * F.avg((a == b).cast("double")), 2)


def confusion(pairs: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """Dense k by k counts; values out of range and incomplete pairs are dropped."""
    inside = pairs.where(F.col(a).between(0, k - 1) & F.col(b).between(0, k - 1))
    cells = [F.count_if(F.col(b) == j).alias(f"b{j}") for j in range(k)]
    spine = pairs.sparkSession.range(k).select(F.col("id").alias("a"))
    got = inside.groupBy(F.col(a).alias("a")).agg(*cells)
    return spine.join(F.broadcast(got), "a", "left").na.fill(0)


def distribution(pairs: DataFrame, columns: dict[str, str], k: int = 5) -> DataFrame:
    """method, level, n, pct on a dense spine of levels, for each named column."""
    kinds = F.array(*(F.struct(F.lit(m).alias("method"), F.col(c).alias("level")) for m, c in columns.items()))
    long = pairs.select(F.explode(kinds).alias("x")).select("x.*").where("level is not null")
    counts = long.groupBy("method").agg(*(F.count_if(F.col("level") == j).alias(str(j)) for j in range(k)), F.count("*").alias("total"))
    levels = F.explode(F.array(*(F.struct(F.lit(j).alias("level"), F.col(str(j)).alias("n")) for j in range(k))))
    flat = counts.select("method", "total", levels.alias("y"))
    return flat.select("method", "y.level", "y.n", F.round(100.0 * F.col("y.n") / F.col("total"), 2).alias("pct"))


def disagreement(pairs: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """Dense histogram of a - b from -(k-1) to k-1."""
    counts = pairs.agg(*(F.count_if(F.col(a) - F.col(b) == d).alias(str(d)) for d in range(1 - k, k)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(d).alias("diff"), F.col(str(d)).alias("n")) for d in range(1 - k, k)))).alias("x")).select("x.*")


def average_rank(value: str, *by: str) -> Column:
    """Rank with ties at their mean. Levels are few, so this is over counts of values, not rows: see ``spearman``."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.sum("n").over(w) - (F.col("n") - 1) / 2.0


def spearman(pairs: DataFrame, a: str, b: str, least: int = 3) -> DataFrame:
    """One row: n and the rank correlation, null under ``least`` pairs or for a constant side.

    Rows are first counted by pair of values, so what is ranked is as many rows as there are different values.
    """
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))

    def ranks(v: str, r: str) -> DataFrame:
        return cells.groupBy(v).agg(F.sum("n").alias("n")).select(v, average_rank(v, F.lit(1)).alias(r))

    d = cells.join(ranks("x", "rx"), "x").join(ranks("y", "ry"), "y")
    n, sx, sy = F.sum("n"), F.sum(F.col("n") * F.col("rx")), F.sum(F.col("n") * F.col("ry"))
    sxx, syy, sxy = (F.sum(F.col("n") * F.col(p) * F.col(q)) for p, q in (("rx", "rx"), ("ry", "ry"), ("rx", "ry")))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    rho = F.when((n >= least) & (vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(F.nullif(vx * vy, F.lit(0.0))))
    return d.agg(n.alias("n"), F.round(rho, 6).alias("spearman"))


def compare_levels(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """n, mean levels, difference, exact %, within-1 %, higher % and weighted kappa by group; complete pairs only."""
    x, y = F.col(a), F.col(b)
    d = pairs.where(x.isNotNull() & y.isNotNull())
    return d.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg(x), 4).alias("mean_a"),
        F.round(F.avg(y), 4).alias("mean_b"),
        F.round(F.avg(x) - F.avg(y), 4).alias("diff"),
        exact_pct(x, y).alias("exact_pct"),
        F.round(100.0 * F.avg((F.abs(x - y) <= 1).cast("double")), 2).alias("within1_pct"),
        F.round(100.0 * F.avg((x > y).cast("double")), 2).alias("higher_pct"),
        F.round(qwk(x, y), 6).alias("qwk"),
    )


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and unweighted kappa, null where chance agreement is 1."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    px = cells.groupBy(F.col("x").alias("v")).agg(F.sum("n").alias("nx"))
    py = cells.groupBy(F.col("y").alias("v")).agg(F.sum("n").alias("ny"))
    chance = px.join(py, "v").agg(F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0)).alias("both"))
    total = cells.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n"))), F.lit(0)).alias("same"))
    n = F.col("n").cast("double")
    pe, po = F.col("both") / (n * n), F.col("same") / n
    kappa = F.when(pe != 1, (po - pe) / F.nullif(1 - pe, F.lit(0.0)))
    one = F.lit(1).alias("one")
    return total.select("*", one).join(chance.select("*", one), "one").select("n", F.round(kappa, 6).alias("kappa"))


def relation_agreement(points: DataFrame) -> DataFrame:
    """n, exact % and weighted kappa of (relation, a, b) by relation, with a pooled row over all."""
    pairs = points.where("a is not null and b is not null").rollup("relation")
    return pairs.agg(F.count("*").alias("n"), exact_pct(F.col("a"), F.col("b")).alias("exact_pct"), F.round(qwk(F.col("a"), F.col("b")), 6).alias("qwk")).select(
        F.coalesce("relation", F.lit("POOLED")).alias("relation"), "n", "exact_pct", "qwk"
    )


def severity(ratings: DataFrame, k: int = 5) -> DataFrame:
    """Mean level and % at each level by annotator."""
    pct = [F.round(100.0 * F.count_if(F.col("level") == j) / F.count("level"), 2).alias(f"pct_{j}") for j in range(k)]
    return ratings.where("level is not null").groupBy("annotator").agg(F.count("*").alias("n"), F.round(F.avg("level"), 4).alias("mean_level"), *pct)


def consensus(pairs: DataFrame, model: str, a: str, b: str) -> DataFrame:
    """The model against each annotator, their rounded mean and the subset on which they agree."""
    m, x, y = F.col(model), F.col(a), F.col(b)
    kinds = {"annotator_1": x, "annotator_2": y, "mean": F.bround((x + y) / 2, 0), "agreed": F.when(x == y, x)}
    long = pairs.select(m.alias("m"), F.explode(F.array(*(F.struct(F.lit(k).alias("reference"), v.cast("double").alias("level")) for k, v in kinds.items()))).alias("r"))
    long = long.select("m", "r.*").where("level is not null and m is not null")
    return long.groupBy("reference").agg(F.count("*").alias("n"), exact_pct(F.col("m"), F.col("level")).alias("exact_pct"), F.round(qwk(F.col("m"), F.col("level")), 6).alias("qwk"))
