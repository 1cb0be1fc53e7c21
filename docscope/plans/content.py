"""Queries over paper content (code, captions, crops, glyphs, TEI, quality reports) and their SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.functions import glyphs as G
from docscope.functions import rules as R
from docscope.sources import tei

from . import views as V

CAPTIONS = ("Figure 1. See", "Overview of the  measured values for all of the samples, for details see", "a b c d e f emove � tep", "Figure 3. Results in the supplementary material")
TITLES = ("Results", "x = y + z", "Rate n + rate", "Mean of all the sample values = total", "Methods/Data")


def _captions(spark: SparkSession, d: str) -> DataFrame:
    return V.figures(spark, d).withColumn("caption", V.pick(CAPTIONS, (F.col("doc_id") + F.col("n")) % 4))


def _caption_checks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("caption")
    checks = {"incomplete": R.is_incomplete_caption(c), "badness": R.caption_badness(c), "cross_reference": R.is_cross_reference(c)}
    kind = R.figure_type(F.when(F.col("label").startswith("Table"), "Table").otherwise("Figure"), c)
    return _captions(spark, d).select("doc_id", "n", kind.alias("type"), *(v.alias(k) for k, v in checks.items()))


def _code(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", R.is_code_block(F.col("text")).alias("is_code"))


def _equation_headings(spark: SparkSession, d: str) -> DataFrame:
    h = V.sections(spark, d).select("doc_id", "ord", V.pick(TITLES, (F.col("doc_id") + F.col("ord")) % 5).alias("h"))
    return h.select("doc_id", "ord", R.is_equation_heading(F.col("h")).alias("is_equation"))


def _crops(spark: SparkSession, d: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("n")
    quality = V.pick(("good", "page_render", "header_strip"), (i + n) % 3)
    method = V.pick(("crop", "pymupdf_full_page"), F.when(i % 7 == 0, 1).otherwise(0))
    reasons = F.when(n % 4 == 1, F.array(F.lit("Duplicate bbox of another")))
    crop = R.crop_quality(quality, method, reasons)
    return V.figures(spark, d).select("doc_id", "n", crop.alias("crop_quality"), (crop == "good").alias("vlm_ready"))


def _quality_report(spark: SparkSession, d: str) -> DataFrame:
    """A paper's text, labels, figures and tables: failed, needs_review or pass; the worst one is the overall status."""
    s = V.sections(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.count_distinct("imrad").alias("n_labels"))
    label = F.col("label").startswith("Table")
    f = V.figures(spark, d).groupBy("doc_id").agg(F.count_if(F.col("image_kb").isNull()).alias("missing"), F.count_if(label).alias("n_tables"))
    text = F.when(F.col("n_sections") == 0, "failed").otherwise("pass")
    tables = R.review(F.greatest(F.lit(0), F.col("doc_id") % 3 - F.col("n_tables")) > 0)
    statuses = {"text": text, "imrad": R.review(F.col("n_labels") < 4), "figures": R.review(F.col("missing") > 0), "tables": tables}
    return s.join(f, "doc_id").select("doc_id", *(c.alias(k) for k, c in statuses.items()), R.overall(*statuses.values()).alias("overall"))


def _glyph_text(spark: SparkSession, d: str) -> DataFrame:
    """Symbol-font text of each document: three codes, the last of them not always known."""
    code = lambda n: F.decode(F.unhex(F.concat(F.lit("F0"), F.lpad(F.hex(n), 2, "0"))), "UTF-16BE")
    i = F.col("doc_id")
    return V.table(spark, d, "documents").select("doc_id", F.concat_ws(" ", code(32 + i % 95), code(160 + i % 80), code(127 + i % 9)).alias("raw"))


def _abstracts(spark: SparkSession, d: str) -> DataFrame:
    abstract = F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    got = R.abstract_or_introduction(abstract, F.coalesce("text", F.lit("")), "From the introduction: ")
    return V.table(spark, d, "documents").select("doc_id", F.md5(got).alias("abstract_md5"))


def _table_quality(spark: SparkSession, d: str) -> DataFrame:
    """The texts of documents judged as if they were table bodies."""
    q = R.table_quality(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    return V.table(spark, d, "documents").select("doc_id", q.alias("q")).select("doc_id", "q.score", "q.needs_review", F.array_join("q.reasons", ",").alias("reasons"))


def _mean_relations(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = (F.col(n) for n in "abc")
    c = F.when(F.col("doc_id") % 4 != 0, c)
    return V.levels(spark, d).select("doc_id", F.round(R.mean_known(a, b, c), 6).alias("mean"))


def _tei(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.lit("<div><head>"), F.col("heading"), F.lit("</head><p>Section "), F.col("ord"), F.lit("</p></div>"))
    one = F.struct("ord", head.alias("div"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["div"]), "")
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>'), body, F.lit("</body></text></TEI>"))
    papers = V.sections(spark, d).groupBy("doc_id").agg(xml.alias("xml"))
    return tei.tei_sections(tei.parse_tei(papers)).select("doc_id", "ord", "heading", "imrad")


QUERIES = {
    "caption_checks": _caption_checks,
    "code_block": _code,
    "equation_heading": _equation_headings,
    "crop_quality": _crops,
    "quality_report": _quality_report,
    "glyph_remap": lambda s, d: _glyph_text(s, d).select("doc_id", G.remap_glyphs(F.col("raw")).alias("plain")),
    "unmapped_glyphs": lambda s, d: G.unmapped_glyphs(_glyph_text(s, d), "doc_id", "raw"),
    "abstract_fallback": _abstracts,
    "table_quality": _table_quality,
    "mean_relation": _mean_relations,
    "pearson_level": lambda s, d: V.levels(s, d).agg(F.round(F.corr("a", "b"), 6).alias("pearson")),
    "tei_sections": _tei,
}

_CAPTION = "[" + ", ".join(f"'{c}'" for c in CAPTIONS) + "][(doc_id+n)%4+1]"
_TITLE = "[" + ", ".join(f"'{c}'" for c in TITLES) + "][(doc_id+ord)%5+1]"
_TAIL = r"regexp_replace(lower(c), '[ .;:,)]+$', '')"
_GLYPH = """SELECT doc_id, chr((61472+doc_id%95)::INT)||' '||chr((61600+doc_id%80)::INT)||' '||chr((61567+doc_id%9)::INT) AS raw FROM documents"""
_FROM = "".join(c for c in G.GLYPHS if "\uf000" <= c <= "\uf8ff")
_COUNT = "len(regexp_extract_all(c, '{}'))".format

SQL = {
    "caption_checks": V.with_views(
        f"""SELECT doc_id, n, CASE WHEN label LIKE 'Table%' THEN 'table' WHEN regexp_matches(c, '(?i)^\\s*scheme\\b') THEN 'scheme' ELSE 'figure' END AS type,
        length(c)<40 OR regexp_matches(c, '{R.CUT_CAPTION}') OR regexp_matches({_TAIL}, '(see|for details)$') AS incomplete,
        5*{_COUNT("�")}+{_COUNT("  ")}+{_COUNT(R.BROKEN_WORDS)}+{_COUNT(chr(92) + "b[a-z]" + chr(92) + "b")}//3 AS badness,
        regexp_matches(c, '{R.CROSS_REFERENCE}') AS cross_reference FROM (SELECT *, {_CAPTION} AS c FROM v_figures)""",
        "figures",
    ),
    "code_block": f"""SELECT doc_id, coalesce(n >= 6 AND 2*code >= n, false) AS is_code FROM (SELECT doc_id, len(lines) AS n,
        len(list_filter(lines, lambda x: regexp_matches(x, '{"|".join(f"(?:{p})" for p in R.CODE_LINE)}'))) AS code
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: regexp_matches(x, '\\S')) AS lines FROM documents))""",
    "equation_heading": V.with_views(
        f"""SELECT doc_id, ord, regexp_matches(h, '{R.MATH_HEADING}') AND len(regexp_extract_all(h, '[A-Za-z]{{3,}}')) < 5
        AND NOT regexp_matches(h, '(?i)\\bn\\s*\\+\\s*rate\\b') AS is_equation FROM (SELECT *, {_TITLE} AS h FROM v_sections)""",
        "sections",
    ),
    "crop_quality": V.with_views(
        """SELECT doc_id, n, q AS crop_quality, q='good' AS vlm_ready FROM (SELECT doc_id, n, CASE WHEN (doc_id+n)%3=1 OR doc_id%7=0 THEN 'page_render'
        WHEN (doc_id+n)%3=2 OR n%4=1 THEN 'suspicious' ELSE 'good' END AS q FROM v_figures)""",
        "figures",
    ),
    "quality_report": V.with_views(
        """SELECT *, CASE WHEN text='failed' THEN 'failed' WHEN 'needs_review' IN (imrad, figures, tables) THEN 'needs_review' ELSE 'pass' END AS overall
        FROM (SELECT doc_id, CASE WHEN n=0 THEN 'failed' ELSE 'pass' END AS text, CASE WHEN labels<4 THEN 'needs_review' ELSE 'pass' END AS imrad,
          CASE WHEN missing>0 THEN 'needs_review' ELSE 'pass' END AS figures, CASE WHEN doc_id%3>n_tables THEN 'needs_review' ELSE 'pass' END AS tables
          FROM (SELECT doc_id, count(*) AS n, count(DISTINCT imrad) AS labels FROM v_sections GROUP BY 1)
          JOIN (SELECT doc_id, count_if(image_kb IS NULL) AS missing, count_if(label LIKE 'Table%') AS n_tables FROM v_figures GROUP BY 1) USING (doc_id))""",
        "sections",
        "figures",
    ),
    "glyph_remap": f"SELECT doc_id, translate(raw, '{_FROM}', '{''.join(G.GLYPHS[c] for c in _FROM)}') AS plain FROM ({_GLYPH})",
    "unmapped_glyphs": f"""SELECT doc_id, 'U+'||upper(to_hex(unicode(c))) AS glyph, count(*) AS n FROM (SELECT doc_id,
        unnest(string_split(replace(raw, ' ', ''), '')) AS c FROM ({_GLYPH})) WHERE c <> '' AND NOT contains('{_FROM}', c) GROUP BY 1, 2""",
    "abstract_fallback": """SELECT doc_id, md5(CASE WHEN doc_id%3=0 AND trim(coalesce(source, ''))<>'' THEN source
        ELSE 'From the introduction: '||substring(coalesce(text, ''), 1, 1500) END) AS abstract_md5 FROM documents""",
    "mean_relation": V.with_views(
        """SELECT doc_id, round(list_avg(list_filter([a, b, CASE WHEN doc_id%4<>0 THEN c END], lambda x: x IS NOT NULL)), 6) AS mean FROM v_levels""",
        "levels",
    ),
    "pearson_level": V.with_views("SELECT round(corr(a, b), 6) AS pearson FROM v_levels", "levels"),
}
