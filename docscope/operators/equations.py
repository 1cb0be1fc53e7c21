"""Equations of papers: fragments merged, formulas split at their numbers, scored, deduplicated and numbered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docscope.functions import equations as E
from docscope.functions.captions import numbered_placeholder
from docscope.functions.cleaning import cleaned


def merged_fragments(equations: DataFrame) -> DataFrame:
    """Equations (doc_id, ord, id, raw) of a section with the closing fragment after them; merged_from has the ids.

    A fragment goes to the equation before it if that lacks a bracket or the fragment is short; one that was taken takes
    none itself. What is left of fragments is marked ``unmerged``.
    """
    w = Window.partitionBy("doc_id", "ord").orderBy("id")
    d = equations.withColumn("raw", E.spaced(F.col("raw"))).withColumns({"next": F.lead("raw").over(w), "next_id": F.lead("id").over(w)})
    opens, closes = F.regexp_count("raw", F.lit(r"\(")), F.regexp_count("raw", F.lit(r"\)"))
    fits = E.is_continuation(F.col("next")) & ((opens > closes) | F.col("raw").endswith("(") | (F.length("next") <= 4))
    # In a run of equations that could take the next one, the first takes the second, the third the fourth, and so on.
    d = d.withColumn("fits", F.coalesce(fits, F.lit(False)))
    d = d.withColumn("run", F.sum((~F.col("fits")).cast("int")).over(w))
    d = d.withColumn("nth", F.sum(F.col("fits").cast("int")).over(Window.partitionBy("doc_id", "ord", "run").orderBy("id")))
    d = d.withColumn("takes", F.col("fits") & (F.col("nth") % 2 == 1))
    d = d.withColumn("taken", F.coalesce(F.lag("takes").over(w), F.lit(False))).where("not taken")
    both = F.when(F.col("takes"), F.array("id", "next_id")).otherwise(F.array("id"))
    raw = F.when(F.col("takes"), E.spaced(F.concat_ws(" ", "raw", "next"))).otherwise(F.col("raw"))
    loose = ~F.col("takes") & E.is_continuation(F.col("raw"))
    return d.withColumns({"merged_from": both, "unmerged": loose, "raw": raw}).drop("next", "next_id", "fits", "run", "nth", "takes", "taken")


def extracted(equations: DataFrame) -> DataFrame:
    """equation_id, num, raw, clean, latex_like, confidence, needs_review, reasons, label, placeholder by paper, in order.

    ``equations`` has doc_id, ord, id, raw and page (null: unknown). Fragments that nothing took and formulas that are
    none go; of equal number and text (220 characters) the first stays.
    """
    d = merged_fragments(cleaned(equations, "raw")).where("not unmerged")
    d = d.withColumn("parts", E.numbered_parts(F.col("raw"))).withColumn("split", F.size("parts") > 1)
    d = d.select("doc_id", "ord", "id", "page", "merged_from", "split", F.posexplode("parts").alias("part", "raw")).withColumn("clean", F.col("raw"))
    d = cleaned(d, "clean", equations=True).withColumn("clean", E.spaced(F.col("clean")))
    d = d.withColumn("num", F.coalesce(E.printed_number(F.col("clean")), E.printed_number(F.col("raw"))))
    repaired = (F.size("merged_from") > 1) | F.col("split")
    d = d.withColumn("c", E.confidence(F.col("raw"), F.col("clean"), repaired)).where("c.status <> 'rejected'")
    place = F.struct("ord", "id", "part")
    same = Window.partitionBy("doc_id", F.coalesce(F.col("num").cast("string"), F.lit("")), F.lower(F.substring("clean", 1, 220))).orderBy(place)
    d = d.withColumn("copy", F.row_number().over(same)).where("copy = 1")
    lost = F.col("page").isNull()
    status = F.when(lost & (F.col("c.status") == "clean"), "needs_review").otherwise(F.col("c.status"))
    reasons = F.when(lost, F.array_append("c.reasons", "page_not_recovered")).otherwise(F.col("c.reasons"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(place))
    d = d.withColumns({"nth": nth, "confidence": status, "reasons": reasons})
    number = F.coalesce("num", "nth")
    return d.select(
        "doc_id", F.format_string("eq%03d", "nth").alias("equation_id"), "ord", "page", "num", "raw", "clean", E.latex_like(F.col("clean")).alias("latex_like"),
        "confidence", (F.col("confidence").isin("needs_review", "repaired") | F.col("page").isNull()).alias("needs_review"), "reasons",
        F.concat(F.lit("Equation "), number.cast("string")).alias("label"), numbered_placeholder("Equation", number).alias("placeholder"), "merged_from",
    )


def stats(rows: DataFrame) -> DataFrame:
    """Equations of each paper by confidence, and those without a page."""
    kinds = [F.count_if(F.col("confidence") == k).alias(k) for k in ("clean", "repaired", "needs_review")]
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), *kinds, F.count_if(F.col("page").isNull()).alias("without_page"))
