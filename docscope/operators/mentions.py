"""Mentions of figures and tables in running text, and the sections that figures belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscope.functions import headings as H

from .imrad import effective
from .papers import LABEL, parsed_label

KINDS = ("figure", "table", "scheme")
#: Numbers over this are no references; a range spans no more than the second.
MOST_NUMBER, MOST_SPAN = 50, 30
SEPARATOR = r"\s*(?:(?:,|;)\s*(?:and\s+)?|\s+and\s+|\s*&\s*)"
WORDS = {"figure": r"\bFig(?:s|ures?)?", "table": r"\bTab(?:les?)?"}


def _range(kind: str) -> str:
    return rf"(?i){WORDS[kind]}\.?\s*(\d+)\s*(?:-|–|—|to)\s*(\d+)(?![0-9])"


def _list(kind: str) -> str:
    return rf"(?i){WORDS[kind]}\.?\s*(\d+(?:{SEPARATOR}\d+)+)(?![0-9])"


def anchors(text: Column) -> Column:
    """Every single label of a text, in order, as it is written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LABEL), F.lit(0))


def label_rows(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, kind, prefix, number, panel, key, id, at of every label in a text."""
    found = df.select(*keep, F.posexplode(anchors(F.col(text))).alias("at", "label"))
    return found.select(*keep, "at", parsed_label("label").alias("x")).select(*keep, "at", "x.*")


def _numbers(array: Column) -> Column:
    return F.transform(array, lambda n: n.cast("long"))


def _ranges(text: Column, kind: str) -> Column:
    """(low, high) of every range of a kind in a text."""
    t = F.coalesce(text, F.lit(""))
    low, high = (_numbers(F.regexp_extract_all(t, F.lit(_range(kind)), F.lit(i))) for i in (1, 2))
    return F.arrays_zip(low.alias("low"), high.alias("high"))


def _lists(text: Column, kind: str) -> Column:
    """The distinct numbers of every list of a kind in a text."""
    t = F.coalesce(text, F.lit(""))
    one = lambda x: F.array_distinct(_numbers(F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0))))
    return F.transform(F.regexp_extract_all(t, F.lit(_list(kind)), F.lit(1)), one)


def referenced(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, kind, key: the distinct figures, tables and schemes that a text refers to, alone, in ranges or in lists."""
    single = label_rows(df, text, *keep).where((F.col("prefix") != "") | (F.col("number").cast("int") <= MOST_NUMBER)).select(*keep, "kind", "key")
    frames = [single]
    for kind in WORDS:
        span = lambda r: (r["low"] > 0) & (r["low"] <= r["high"]) & (r["high"] <= MOST_NUMBER) & (r["high"] - r["low"] <= MOST_SPAN)
        inside = F.flatten(F.transform(F.filter(_ranges(F.col(text), kind), span), lambda r: F.sequence(r["low"], r["high"])))
        listed = F.filter(F.flatten(_lists(F.col(text), kind)), lambda n: n.between(1, MOST_NUMBER))
        numbers = df.select(*keep, F.explode(F.concat(inside, listed)).alias("n"))
        frames.append(numbers.select(*keep, F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}::"), F.col("n")).alias("key")))
    out = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return out.distinct()


def missing(sections: DataFrame, figures: DataFrame) -> DataFrame:
    """doc_id, kind, key: what a paper's text refers to and its extracted figures and tables (label, type) lack."""
    have = figures.select("doc_id", F.coalesce("type", F.lit("figure")).alias("type"), parsed_label("label").alias("x")).where("x.kind = type")
    want = referenced(sections, "text", "doc_id")
    return want.join(have.select("doc_id", F.col("x.kind").alias("kind"), F.col("x.key").alias("key")).distinct(), ["doc_id", "kind", "key"], "left_anti")


def plain_numbers(keys: Column) -> Column:
    """The sorted numbers of those of some keys that have no prefix."""
    plain = F.filter(keys, lambda k: k.rlike(r"^[a-z]+::\d+$"))
    return F.array_sort(F.array_distinct(F.transform(plain, lambda k: F.regexp_extract(k, r"(\d+)$", 1).cast("int"))))


def mention_counts(sections: DataFrame, most: int = 999) -> DataFrame:
    """doc_id, ord, key, n: how often each section's text mentions a label, ranges and lists included.

    A number counts once for each label, for each range around it and for each list that has it, so the first of a
    list counts twice. Labels have three digits at most: ranges are read up to there.
    """
    rows = label_rows(sections, "text", "doc_id", "ord").select("doc_id", "ord", "key")
    for kind in WORDS:
        wide = F.filter(_ranges(F.col("text"), kind), lambda r: (r["low"] <= r["high"]) & (r["low"] <= most))
        inside = F.flatten(F.transform(wide, lambda r: F.sequence(r["low"], F.least(r["high"], F.lit(most).cast("long")))))
        numbers = sections.select("doc_id", "ord", F.explode(F.concat(inside, F.flatten(_lists(F.col("text"), kind)))).alias("n"))
        rows = rows.unionByName(numbers.select("doc_id", "ord", F.concat(F.lit(f"{kind}::"), F.col("n")).alias("key")))
    return rows.groupBy("doc_id", "ord", "key").agg(F.count("*").alias("n"))


def without_captions(sections: DataFrame, figures: DataFrame, chars: int = 80, least: int = 20) -> DataFrame:
    """``sections`` whose text has lost the beginnings of the paper's captions, so that captions are no mentions."""
    head = F.trim(F.substring(F.coalesce("caption", F.lit("")), 1, chars))
    heads = figures.select("doc_id", "n", head.alias("head")).where(F.length("head") > least)
    heads = heads.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "head"))), lambda x: x["head"]).alias("heads"))
    text = F.aggregate(F.coalesce("heads", F.array().cast("array<string>")), F.coalesce("text", F.lit("")), lambda t, c: F.replace(t, c, F.lit(" ")))
    return sections.join(heads, "doc_id", "left").withColumn("text", text).drop("heads")


def figure_ids(figures: DataFrame) -> DataFrame:
    """doc_id, n, figure_id: the label's id, a running name where there is no label; a repeated id gets letters from b on."""
    kind = F.coalesce("type", F.lit("figure"))
    short = F.when(kind.isin("table", "scheme"), kind).otherwise("fig")
    label = F.coalesce(F.nullif("label", F.lit("")), F.col("caption"), F.lit(""))
    d = figures.withColumn("__label", label)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))
    base = F.coalesce(parsed_label("__label")["id"], F.concat(short, F.lit("_unlabeled_"), F.lpad(place.cast("string"), 2, "0")))
    d = d.select("doc_id", "n", base.alias("base"))
    r = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("n"))
    return d.select("doc_id", "n", F.when(r == 1, F.col("base")).otherwise(F.concat("base", F.char(F.lit(96) + r))).alias("figure_id"))


def assign_sections(figures: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, n, figure_id, assigned_section, assignment_method, mentions of every figure (n, label, type, caption, page).

    The section that mentions a figure most (of equal counts the first by name); else the labelled section that starts
    last at or before its page; else the label of the nearest page of a figure that was assigned by mentions, at equal
    distance the last one at or after the page, else the first.
    """
    named = effective(sections)
    label = figures.select("doc_id", "n", F.col("page").cast("long").alias("page"), F.coalesce("type", F.lit("figure")).alias("type"), parsed_label("label").alias("x"))
    counts = mention_counts(without_captions(sections, figures)).withColumnRenamed("n", "times")
    counts = counts.join(named.withColumnRenamed("key", "section"), ["doc_id", "ord"]).groupBy("doc_id", "key", "section").agg(F.sum("times").alias("times"))
    own = label.where("x.kind = type").select("doc_id", "n", F.col("x.key").alias("key")).join(counts, ["doc_id", "key"])
    own = own.groupBy("doc_id", "n").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "times")))).alias("mentions"),
        F.min_by("section", F.struct(-F.col("times"), F.col("section"))).alias("most"),
    )
    paged = sections.join(named, ["doc_id", "ord"]).where(F.col("effective").isNotNull() & F.col("page").isNotNull())
    starts = F.array_sort(F.collect_list(F.struct(F.col("page").cast("long").alias("page"), (-F.col("ord")).alias("o"), F.col("effective").alias("label"))))
    anchors_ = label.select("doc_id", "n", "page").join(own, ["doc_id", "n"]).where(F.col("most").isin(*H.LABELS) & F.col("page").isNotNull())
    near = F.array_sort(F.collect_list(F.struct("n", "page", F.col("most").alias("label"))))
    d = label.select("doc_id", "n", "page").join(own, ["doc_id", "n"], "left")
    d = d.join(paged.groupBy("doc_id").agg(starts.alias("starts")), "doc_id", "left").join(anchors_.groupBy("doc_id").agg(near.alias("near")), "doc_id", "left")
    before = F.get(F.reverse(F.filter("starts", lambda s: s["page"] <= F.col("page"))), F.lit(0))["label"]
    distance = F.array_min(F.transform("near", lambda a: F.abs(a["page"] - F.col("page"))))
    closest = F.filter("near", lambda a: F.abs(a["page"] - F.col("page")) == distance)
    after = F.filter(closest, lambda a: a["page"] >= F.col("page"))
    nearest = F.coalesce(F.get(F.reverse(after), F.lit(0))["label"], F.get(closest, F.lit(0))["label"])
    by_page = F.when(F.col("page").isNotNull(), F.coalesce(before, nearest))
    method = F.when(F.col("most").isNotNull(), "mention_based").when(by_page.isNotNull(), "page_proximity").otherwise("unassigned")
    out = d.select("doc_id", "n", F.coalesce("most", by_page).alias("assigned_section"), method.alias("assignment_method"), "mentions")
    return out.join(figure_ids(figures), ["doc_id", "n"])
