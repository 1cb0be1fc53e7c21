"""Captions and placeholders of figures, tables and equations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscope.operators.papers import LABEL, parsed_label

from .cleaning import cleaned
from .headings import stripped
from .rules import caption_badness, is_incomplete_caption

BODY_TEXT = r"(?i)\b(?:In this paper|In this section|The remainder of this paper|CRediT authorship|Declaration of competing interest|References)\b"
# Where a caption turns into body text or another block, and the most characters it keeps.
TRIM_MARKERS = r"(?i:\bAs shown in\s+(?:Fig|Figure|Table)\b|\bFrom\s+(?:Fig|Figure|Table)\.?\s+\d|\bIn\s+(?:Fig|Figure|Table)\.?\s+\d)|\b(?:Fig|Figure|Table|Scheme|Algorithm)\.?\s+\d+\s+[A-Z]"
HARD_STOP = (
    r"(?i)^\s*(?:\d+(?:\.\d+)*\.?\s+[A-Z][A-Za-z]|Table\s+\d|Fig(?:ure)?\.?\s+\d|CRediT authorship|Declaration of competing interest"
    r"|Acknowledg(?:e)?ments?|Appendix\b|References\b|Funding\b|Data availability|Supplementary\b|Supporting information"
    r"|usertype\b|protocol\b|send_\d+|role\s+\w+)"
)
BODY_START = (
    r"(?i)^\s*(?:In the|For the|The scheme|The first|The second|The last|Then|Next|After|Before|As already|In case|In turn|Please note"
    r"|We |Our |This |These |Those |Also,|Moreover|Furthermore|Finally,|The tool|Table \d+ presents|Fig\. \d+ shows)\b"
)
LATER_BLOCK = r"(?i)\b(?:CRediT authorship|Declaration of competing interest|Acknowledg(?:e)?ments?|Appendix\s+[A-Z]|References\b|usertype\b|protocol\s+\w+\(|send_\d+)\b"
LATER_BODY = r"(?is)^(.{60,}?)\s+(?:In the|For the|The scheme|The first|Then|Next|After executing|As already mentioned|Please note)\b"
MOST_TRIMMED, MOST_CLEAN, MOST_LINES = 400, 650, 700
#: A caption of no more characters is a stub; another must be longer by the factor to replace a whole one.
STUB, LONGER = 25, 1.15
_MARK = "\u0001"


def caption_quality(caption: Column) -> Column:
    """status (good, suspicious or missing) and reasons of a caption."""
    c = stripped(caption)
    words = F.regexp_count(c, F.lit(r"(?U)\w+"))
    reasons = F.array_compact(F.array(
        F.when(words < 5, "very_short_caption"), F.when((words > 250) | (F.length(c) > 1400), "suspiciously_long_caption"),
        F.when(c.rlike(BODY_TEXT), "possible_body_text_leakage"),
    ))
    none = F.struct(F.lit("missing").alias("status"), F.array(F.lit("empty_caption")).alias("reasons"))
    return F.when(c == "", none).otherwise(F.struct(F.when(F.size(reasons) > 0, "suspicious").otherwise("good").alias("status"), reasons.alias("reasons")))


def _last(text: Column, mark: str) -> Column:
    """The position, from 0, at which a mark stands last; -1 for none."""
    pattern = rf"(?s)^(.*){mark}"
    return F.when(text.rlike(pattern), F.length(F.regexp_extract(text, pattern, 1))).otherwise(-1)


def trimmed_caption(caption: Column) -> Column:
    """A caption of over 400 characters up to where it turns into body text, else to its last sentence end; blank for null."""
    c = stripped(caption)
    body = F.regexp_extract(c, rf"(?s)^(.{{20,}}?)(?:{TRIM_MARKERS})", 1)
    bare = lambda x: F.regexp_replace(x, r"[ .,;:]+\z", "")
    cut = _last(F.left(c, F.lit(MOST_TRIMMED)), r"\. ")
    cut = F.when(cut < MOST_TRIMMED // 2, MOST_TRIMMED).otherwise(cut)
    return F.when(F.length(c) <= MOST_TRIMMED, c).when(body != "", bare(body)).otherwise(F.concat(bare(F.left(c, cut)), F.lit(".")))


def sentence_cut(text: Column) -> Column:
    """The first 650 characters up to their last sentence end, if that leaves 80."""
    head = F.left(text, F.lit(MOST_CLEAN))
    cut = F.greatest(*(_last(head, m) for m in (r"\. ", r"\); ", r"\] ")))
    cut = F.when(cut < 80, MOST_CLEAN).otherwise(cut)
    return F.when(F.length(text) <= MOST_CLEAN, text).otherwise(F.regexp_replace(F.left(text, cut + 1), r"[ ,;:]+\z", ""))


def clean_captions(df: DataFrame, caption: str) -> DataFrame:
    """``df`` with its captions cleaned and cut where the next block or body text begins; blank for null."""
    lines = F.filter(F.transform(F.split(F.col(caption), "\n"), stripped), lambda x: x != "")
    chars = lambda n: F.length(F.array_join(F.slice(lines, F.lit(1), n), " "))
    ends = lambda x, i: (i > 0) & (x.rlike(HARD_STOP) | (x.rlike(BODY_START) & (chars(i) > 35)))
    first = lambda f: F.array_min(F.transform(lines, f))
    end = F.least(first(lambda x, i: F.when(ends(x, i), i)), first(lambda x, i: F.when(chars(i + 1) > MOST_LINES, i + 1)))
    kept = F.array_join(F.slice(lines, F.lit(1), F.coalesce(end, F.size(lines))), "\n")
    df = cleaned(cleaned(df, caption).withColumn(caption, kept), caption)
    bare = lambda x: F.regexp_replace(x, r"[ ,;:]+\z", "")
    c = F.col(caption)
    at = F.regexp_instr(c, F.lit(LATER_BLOCK)) - 1
    df = df.withColumn(caption, F.when(at > 25, bare(F.left(c, at))).otherwise(c))
    body = F.regexp_extract(c, LATER_BODY, 1)
    return df.withColumn(caption, sentence_cut(F.when(body != "", bare(body)).otherwise(c)))


def figure_placeholder(label: Column, figure_id: Column, kind: Column) -> Column:
    """[Figure 3 here]: the label, with its kind before it if it does not say so itself."""
    name = F.coalesce(F.nullif(label, F.lit("")), F.nullif(figure_id, F.lit("")), F.lit("FIGURE"))
    name = stripped(F.regexp_replace(name, r"(?U)\s+", " "))
    word = F.when(kind == "scheme", "Scheme ").when(kind == "table", "Table ").otherwise("Figure ")
    return F.concat(F.lit("["), F.when(name.rlike(r"(?i)^(fig|figure|scheme|table)\b"), name).otherwise(F.concat(word, name)), F.lit(" here]"))


def numbered_placeholder(word: str, number: Column) -> Column:
    """[Equation 5 here] or [Equation here]."""
    return F.concat(F.lit(f"[{word}"), F.when(number.isNotNull(), F.concat(F.lit(" "), number.cast("string"))).otherwise(""), F.lit(" here]"))


def split_captions(df: DataFrame, caption: str, *keep: str) -> DataFrame:
    """keep, at, id, key, caption: a caption that holds several is cut at its labels; of one id the longest, in their order."""
    text = F.regexp_replace(F.coalesce(F.col(caption), F.lit("")), r"\s+", " ")
    parts = F.split(F.regexp_replace(text, LABEL, _MARK + "$0"), _MARK)
    rows = df.select(*keep, F.posexplode(F.slice(parts, 2, 1_000_000)).alias("at", "part")).select(*keep, "at", "part", parsed_label("part").alias("x"))
    body = F.regexp_replace("part", r"^[ .;:]+|[ .;:]+$", "")
    rows = rows.select(*keep, "at", F.col("x.id").alias("id"), F.col("x.key").alias("key"), body.alias("caption"))
    longest = F.max_by("caption", F.struct(F.length("caption"), -F.col("at")))
    return rows.groupBy(*keep, "id", "key").agg(F.min("at").alias("at"), longest.alias("caption"))


def enriched_captions(figures: DataFrame, others: DataFrame) -> DataFrame:
    """``figures`` (doc_id, n, label, caption) with the longest caption of ``others`` (doc_id, label, caption) for their key, and caption_source.

    It replaces a stub, a caption that is much shorter, or one with more broken text; not if it is cut off itself.
    """
    other = others.select("doc_id", parsed_label("label")["key"].alias("key"), stripped(F.col("caption")).alias("other")).where(F.length("other") > STUB)
    other = other.groupBy("doc_id", "key").agg(F.max_by("other", F.struct(F.length("other"), F.col("other"))).alias("other"))
    own = stripped(F.col("caption"))
    d = figures.withColumn("key", parsed_label("label")["key"]).join(other, ["doc_id", "key"], "left")
    better = (F.length(own) <= STUB) | (F.length("other") > F.length(own) * LONGER) | (caption_badness(own) > caption_badness(F.col("other")))
    take = F.coalesce(better & ~is_incomplete_caption(F.col("other")), F.lit(False))
    return d.select(
        *(c for c in figures.columns if c != "caption"), F.when(take, F.col("other")).otherwise(own).alias("caption"),
        F.when(take, "tei_enriched").otherwise("own").alias("caption_source"),
    )


def without_missing_supplements(figures: DataFrame) -> DataFrame:
    """Figures without those of a supplement whose image is missing (label, image_file_missing)."""
    return figures.where(~(F.coalesce("image_file_missing", F.lit(False)) & F.coalesce(F.col("label").rlike(r"(?i)\b(?:Fig\.?|Figure)\s*S\d+\b"), F.lit(False))))


def without_caption_text(sections: DataFrame, figures: DataFrame) -> DataFrame:
    """``sections`` whose text has each figure's caption once replaced by its placeholder (tables excepted), and ``removed``."""
    c = F.regexp_replace(stripped(F.col("caption")), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    flex = F.concat(F.lit("(?is)"), F.regexp_replace(F.regexp_replace(c, r"\s+", r"\\s+"), r"\s*(:|\\\.)\s*", r"\\s*$1\\s*"))
    mark = F.concat(F.lit(" "), figure_placeholder(F.col("label"), F.lit(None).cast("string"), F.col("type")), F.lit(" "))
    f = figures.where((F.coalesce("type", F.lit("figure")) != "table") & (stripped(F.col("caption")) != ""))
    f = f.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", flex.alias("p"), mark.alias("m")))).alias("caps"))
    start = F.struct(F.coalesce("text", F.lit("")).alias("t"), F.lit(0).alias("k"))

    def step(a: Column, x: Column) -> Column:
        found = F.regexp_substr(a["t"], x["p"])
        place = F.instr(a["t"], found)
        new = F.concat(F.substring(a["t"], F.lit(1), place - 1), x["m"], F.substring(a["t"], place + F.length(found), F.length(a["t"])))
        return F.when(found.isNotNull() & (found != ""), F.struct(new.alias("t"), (a["k"] + 1).alias("k"))).otherwise(a)

    d = sections.join(f, "doc_id", "left")
    done = F.when(F.col("caps").isNotNull(), F.aggregate("caps", start, step)).otherwise(start)
    return d.withColumn("done", done).withColumns({"text": F.col("done.t"), "removed": F.col("done.k")}).drop("done", "caps")


def suffixed(df: DataFrame, base: str, order: str, *by: str) -> DataFrame:
    """``df`` with ids made distinct: the second of a base gets _2, the third _3."""
    r = F.row_number().over(Window.partitionBy(*by, base).orderBy(order))
    return df.withColumn(base, F.when(r == 1, F.col(base)).otherwise(F.concat(base, F.lit("_"), r)))
