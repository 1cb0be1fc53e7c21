"""Scores of judgments: section coverage, composite completeness, summaries and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY_SCORES = {"explicit": 1.0, "implied": 0.5, "absent": 0.0}
LINK_SCORES = {"traceable": 1.0, "partially_traceable": 0.5, "not_traceable": 0.0}
W_SECTIONS, W_RELATIONS = 0.7, 0.3


def scored(verdict: Column, scores: dict[str, float]) -> Column:
    """A verdict's score; null for a verdict that is not valid."""
    out = F.lit(None).cast("double")
    for k, v in scores.items():
        out = F.when(verdict == k, F.lit(v)).otherwise(out)
    return out


def _coverage() -> Column:
    return F.coalesce(F.avg(scored(F.col("verdict"), ENTITY_SCORES)), F.lit(0.0))


def section_coverage(entities: DataFrame) -> DataFrame:
    """Mean entity score by paper and section over valid verdicts (0 if none), with counts by verdict."""
    counts = [F.count_if(F.col("verdict") == k).alias(f"n_{k}") for k in ENTITY_SCORES]
    return entities.groupBy("doc_id", "section").agg(F.round(_coverage(), 4).alias("coverage"), *counts)


def score_eval(entities: DataFrame, verdicts: DataFrame, relations: DataFrame) -> DataFrame:
    """s, r, c_weighted, c_unweighted, level and n_relations_scored of each paper.

    A section without entities counts as 0; relations count over valid verdicts; the level is the number of
    sections whose own verdict is explicit or implied.
    """
    link = scored(F.col("verdict"), LINK_SCORES)
    # Means are rounded where they are shown, not before they are added up.
    s = entities.groupBy("doc_id", "section").agg(_coverage().alias("mean")).groupBy("doc_id").agg((F.sum("mean") / 4).alias("s"))
    level = verdicts.groupBy("doc_id").agg(F.count_if(F.col("verdict").isin("explicit", "implied")).alias("level"))
    r = relations.groupBy("doc_id").agg(F.coalesce(F.avg(link), F.lit(0.0)).alias("r"), F.count(link).alias("n_relations_scored"))
    d = level.join(s, "doc_id", "left").join(r, "doc_id", "left").na.fill(0)
    return d.select(
        "doc_id",
        F.round("s", 4).alias("s"),
        F.round("r", 4).alias("r"),
        F.round(W_SECTIONS * F.col("s") + W_RELATIONS * F.col("r"), 4).alias("c_weighted"),
        F.round((F.col("s") + F.col("r")) / 2, 4).alias("c_unweighted"),
        "level",
        "n_relations_scored",
    )


def method_summary(scores: DataFrame, method: Column) -> DataFrame:
    """Papers, scored papers and mean scores by method."""
    means = [F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("s", "r", "c_weighted", "level")]
    return scores.groupBy(method.alias("method")).agg(F.count("*").alias("n_total"), F.count_if(F.col("n_relations_scored") > 0).alias("n_scored"), *means)


def coverage_breakdown(items: DataFrame, by: str, verdicts: tuple[str, ...]) -> DataFrame:
    """Counts and percentages of each verdict by section or relation; of none, percentages are 0."""
    n = F.greatest(F.count_if(F.col("verdict").isin(*verdicts)), F.lit(1))
    columns = []
    for v in verdicts:
        k = F.count_if(F.col("verdict") == v)
        columns += [k.alias(f"n_{v}"), F.round(100.0 * k / n, 2).alias(f"pct_{v}")]
    return items.groupBy(by).agg(*columns)
