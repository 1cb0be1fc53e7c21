"""Structure of papers: section labels, figures and sections, label parsing, quality predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def imrad_summary(sections: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Labels found and missing of each paper, in canonical order."""
    found = sections.groupBy("doc_id").agg(F.collect_set("imrad").alias("have"), F.count("*").alias("n_sections"))
    known = F.array(*map(F.lit, order))
    text = lambda c: F.array_join(c, ",")
    return found.select(
        "doc_id", "n_sections", text(F.array_intersect(known, "have")).alias("found"), text(F.array_except(known, "have")).alias("missing")
    )


#: A qualifier, kind, prefix, separator, number and panel; the first label in a text counts.
LABEL = (
    r"(?iU)((?:supplement(?:ary|al)?|suppl?|supp|extended\s+data|appendix|online)\.?\s+)?"
    r"(fig(?:ure|s|\.|\b)|tab(?:les|le|\.|\b)|sch(?:emes|eme|\.|\b))\s*\.?\s*([SAE])?(\.?)(\d{1,3})([a-z])?(?![0-9])"
)


def parsed_label(label: str) -> Column:
    """kind, prefix, number, panel, key and id of the first label in a column's text; null where there is none."""
    c = F.col(label)
    part = lambda i: F.regexp_extract(c, LABEL, i)
    kind = F.when(part(2).rlike("(?i)^fig"), "figure").when(part(2).rlike("(?i)^tab"), "table").otherwise("scheme")
    implied = F.when(part(1).rlike("(?i)^(supp|online)"), "S").when(part(1).rlike("(?i)^ext"), "E").when(part(1).rlike("(?i)^app"), "A").otherwise("")
    prefix = F.when(part(3) != "", F.upper(part(3))).otherwise(implied)
    number = part(5).cast("int").cast("string")
    short = F.when(kind == "figure", "fig").otherwise(kind)
    plain = F.concat(short, F.lit("_"), F.lpad(number, 2, "0"))
    plain = F.when(F.length(number) > 2, F.concat(short, F.lit("_"), number)).otherwise(plain)
    marked = F.concat(short, F.lit("_"), prefix, F.when(part(4) == ".", "_").otherwise(""), number)
    found = F.struct(
        kind.alias("kind"), prefix.alias("prefix"), number.alias("number"), F.lower(part(6)).alias("panel"),
        F.concat_ws(":", kind, prefix, number).alias("key"), F.when(prefix == "", plain).otherwise(marked).alias("id"),
    )
    return F.when(c.rlike(LABEL), found)


def figure_key(label: str) -> Column:
    """kind:prefix:number of a label column, the key under which labels are compared."""
    return parsed_label(label)["key"]


def asof_section(figures: DataFrame, sections: DataFrame) -> DataFrame:
    """The labelled section that starts last at or before each figure's page; of equal pages the first section."""
    s = sections.where("imrad is not null").select("doc_id", F.col("page").alias("s_page"), "ord", "imrad")
    pairs = figures.select("doc_id", "n", "page").join(s, "doc_id", "left")
    fits = F.when(F.col("s_page") <= F.col("page"), F.struct("s_page", -F.col("ord")))
    return pairs.groupBy("doc_id", "n").agg(F.max_by("imrad", fits).alias("assigned"))


def asof_table(figures: DataFrame, sections: DataFrame) -> DataFrame:
    """The last section at or before each page, of equal pages the last; if none, the first section with a page."""
    s = sections.select("doc_id", F.col("page").alias("s_page"), "ord")
    pairs = figures.select("doc_id", "n", "page").join(s, "doc_id", "left")
    fits = F.when(F.col("s_page") <= F.col("page"), F.struct("s_page", "ord"))
    return pairs.groupBy("doc_id", "n").agg(F.coalesce(F.max_by("ord", fits), F.min("ord")).alias("section_ord"))


def nearest_anchor(figures: DataFrame, anchors: DataFrame) -> DataFrame:
    """The label of the anchor (doc_id, at, page, label) nearest by page to each figure.

    At equal distance the last anchor at or after the page counts, and if all lie before it the first.
    """
    a = anchors.select("doc_id", F.col("page").alias("a_page"), "at", "label")
    pairs = figures.select("doc_id", "n", "page").join(a, "doc_id", "left")
    after = F.col("a_page") >= F.col("page")
    rank = F.struct(F.abs(F.col("a_page") - F.col("page")), (~after).cast("int"), F.when(after, -F.col("at")).otherwise(F.col("at")))
    return pairs.groupBy("doc_id", "n").agg(F.min_by("label", F.when(F.col("page").isNotNull(), rank)).alias("nearest"))


def duplicate_boxes(figures: DataFrame) -> DataFrame:
    """Figures that share a rounded box and a paper with another."""
    same = Window.partitionBy("doc_id", *(F.round(c) for c in "xywh"))
    return figures.withColumn("sharing", F.count("*").over(same)).where("sharing > 1").select("doc_id", "n", "sharing")


def suspect_figures(figures: DataFrame) -> DataFrame:
    """Reasons to distrust a figure's image or box, for figures that have one."""
    kb, w, h = F.col("image_kb"), F.col("w"), F.col("h")
    reasons = {
        "missing_image": kb.isNull(), "small_image": kb < 8, "short": h < 50, "narrow": w < 60, "small_area": w * h < 5000,
        "extreme_aspect": F.greatest(w / h, h / w) > 10,
    }
    found = F.concat_ws(",", *(F.when(c, F.lit(k)) for k, c in reasons.items()))
    return figures.select("doc_id", "n", found.alias("reasons")).where("reasons <> ''")


def figure_stats(figures: DataFrame) -> DataFrame:
    tables = F.col("label").startswith("Table")
    return figures.groupBy("doc_id").agg(
        F.count_if(~tables).alias("n_figures"), F.count_if(tables).alias("n_tables"),
        F.count_if(F.col("image_kb").isNull()).alias("n_missing"), F.count_if((F.col("w") < 80) | (F.col("h") < 80)).alias("n_absurd"),
    )


def missing_keys(mentioned: DataFrame, extracted: DataFrame) -> DataFrame:
    """Keys that are mentioned in a paper but were not extracted from it."""
    return mentioned.select("doc_id", "key").distinct().join(extracted.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti")


def merge_new(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first`` and those rows of ``second`` whose key it lacks, one for each key; rows without key are dropped."""
    w = Window.partitionBy("doc_id", "key").orderBy("n")
    extra = second.where("key is not null").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return first.unionByName(extra.join(first.select("doc_id", "key"), ["doc_id", "key"], "left_anti"))


def duplicate_suffix(df: DataFrame, base: str, order: str) -> DataFrame:
    """Distinct ids: the second of a base gets _dup2, the third _dup3, by order."""
    r = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return df.select(order, F.when(r == 1, F.col(base)).otherwise(F.concat(base, F.lit("_dup"), r)).alias("safe_id"))


def digit_ratio(text: Column) -> Column:
    return F.round(F.regexp_count(text, F.lit(r"[0-9]")) / F.greatest(F.length(text), F.lit(1)), 4)


def content_score(text: Column, pattern: str) -> Column:
    """Hits of a pattern, normalised by length in units of 1500 characters (at least one unit)."""
    return F.round(F.regexp_count(text, F.lit(pattern)) / F.greatest(F.lit(1.0), F.length(text) / 1500.0), 4)
