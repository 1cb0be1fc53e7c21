"""Queries over page lines, recognised words, long captions and nested JSON, and their SQL for the checks.

The inputs are made by arithmetic on document numbers; the SQL says what must come out and reads none of the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.functions import captions, key_search
from docscope.operators import ocr, table_lines

from . import views as V

PROSE = "The results show that the mass of each sample was almost constant in the test."
AFTER = ("Fig. 2 A plot", "2. Methods", PROSE, "References")


def pages(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, page, text: a caption, a head, none to four lines of data, what comes after the table, and one more such line."""
    i = F.col("doc_id")
    head = F.concat(F.lit("A mention of Table 1 here\nTable "), 1 + i % 4, F.lit(". Values of set "), i % 7, F.lit("\nName  Mass Loss\n"))
    line = lambda j: F.concat(F.lit("A"), j, F.lit(" "), i % 90, F.lit(".5 "), j, F.lit(".25\n"))
    data = F.array_join(F.transform(F.slice(F.sequence(F.lit(1), F.lit(4)), F.lit(1), (i % 5).cast("int")), line), "")
    rows = V.table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("page"))
    first = F.concat(head, data, V.pick(AFTER, i % 4), F.lit("\nB1 1.5 2.5"))
    second = F.concat(F.lit("Table "), 1 + i % 4, F.lit(" Continued\nC1 7.5 "), i % 90, F.lit("\nC2 8.5 9.5\nFunding"))
    return rows.select("doc_id", "page", F.when(F.col("page") == 1, first).otherwise(second).alias("text"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table_lines.table_blocks(pages(spark, d)).select("doc_id", "page", "num", "text", "caption_only")


def _tables(spark: SparkSession, d: str) -> DataFrame:
    return table_lines.tables_of_pages(pages(spark, d)).select("doc_id", "num", "page", "caption", "body", "caption_only")


def _grids(spark: SparkSession, d: str) -> DataFrame:
    """Regions of one to four rows of two words; a single row has one column."""
    i, r, c = F.col("doc_id"), F.col("r"), F.col("c")
    w = V.table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), (1 + i % 4).cast("int"))).alias("r"))
    w = w.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(1))))
    text = F.concat(F.when(c == 0, "a").otherwise("b"), r)
    w = w.select("doc_id", (10 + c * 100 + i % 3).alias("x"), (r * 20 + (i + c) % 3).alias("y"), F.lit(10).alias("h"), text.alias("text"))
    return ocr.table_grids(w, "doc_id").withColumn("reasons", F.array_join("reasons", ","))


def _trimmed(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", captions.trimmed_caption(F.col("text")).alias("caption"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    deep = F.struct(F.array(F.struct(F.concat(F.lit("deep "), i).alias("Title"))).alias("items"))
    blank = F.when(i % 3 == 0, F.concat(F.lit(" top  "), i)).otherwise(" ")
    j = F.to_json(F.struct(deep.alias("a"), blank.alias("TITLE"), F.lit(1).alias("n")))
    df = V.table(spark, d, "documents").select("doc_id", F.when(i % 7 == 0, "{").otherwise(j).alias("j"))
    return key_search.with_found(df, "j", "found", "title", "heading").select("doc_id", "found")


QUERIES = {"table_blocks": _blocks, "tables_of_pages": _tables, "ocr_table_grids": _grids, "trimmed_captions": _trimmed, "recursive_key": _found}

_PARTS = """WITH p AS (SELECT doc_id, 'Table '||(1+doc_id%4)||'. Values of set '||(doc_id%7) AS cap, (1+doc_id%4)::VARCHAR AS num,
  coalesce(array_to_string(list_transform(generate_series(1, doc_id%5), lambda j: chr(10)||'A'||j||' '||(doc_id%90)||'.5 '||j||'.25'), ''), '') AS data,
  CASE WHEN doc_id%4=2 AND doc_id%5=0 THEN chr(10)||'The results show that the mass of each sample was almost constant in the test.'||chr(10)||'B1 1.5 2.5' ELSE '' END AS more,
  'C1 7.5 '||(doc_id%90)||chr(10)||'C2 8.5 9.5' AS next FROM documents)"""

SQL = {
    "table_blocks": _PARTS
    + """ SELECT doc_id, 1 AS page, num, cap||chr(10)||'Name Mass Loss'||data||more AS text, data='' AND more='' AS caption_only FROM p
    UNION ALL SELECT doc_id, 2, num, 'Table '||num||' Continued'||chr(10)||next, false FROM p""",
    "tables_of_pages": _PARTS
    + """ SELECT doc_id, num, 1 AS page, cap AS caption, 'Name Mass Loss'||data||more||chr(10)||next AS body, false AS caption_only FROM p""",
    "ocr_table_grids": """SELECT doc_id, CASE WHEN r=1 THEN 'a1 b1' ELSE array_to_string(list_transform(generate_series(1, r), lambda j: 'a'||j||' | b'||j), chr(10)) END AS markdown,
    CASE WHEN r=1 THEN 0.24 ELSE round(0.35+0.09*r, 3) END::DOUBLE AS structure, CASE WHEN r=1 THEN 'few_rows,weak_column_alignment' ELSE '' END AS reasons
    FROM (SELECT doc_id, 1+doc_id%4 AS r FROM documents)""",
    "trimmed_captions": r"""WITH c AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS c FROM documents),
    b AS (SELECT doc_id, c, regexp_extract(c, '(?s)^(.{20,}?)(?:(?i:\bAs shown in\s+(?:Fig|Figure|Table)\b|\b(?:From|In)\s+(?:Fig|Figure|Table)\.?\s+\d)|\b(?:Fig|Figure|Table|Scheme|Algorithm)\.?\s+\d+\s+[A-Z])', 1) AS body,
      left(c, 400) AS head FROM c),
    e AS (SELECT *, CASE WHEN contains(head, '. ') THEN 400-instr(reverse(head), ' .')-1 ELSE -1 END AS cut FROM b)
    SELECT doc_id, CASE WHEN length(c)<=400 THEN c WHEN body<>'' THEN rtrim(body, ' .,;:') ELSE rtrim(left(c, CASE WHEN cut<200 THEN 400 ELSE cut END), ' .,;:')||'.' END AS caption FROM e""",
    "recursive_key": "SELECT doc_id, CASE WHEN doc_id%7=0 THEN '' WHEN doc_id%3=0 THEN 'top '||doc_id ELSE 'deep '||doc_id END AS found FROM documents",
}
