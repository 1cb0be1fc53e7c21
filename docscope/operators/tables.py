"""Tables of papers: numbers, references, order, documents of tables, and where text stands in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscope.functions.headings import stripped

NUMBER = r"((?:S\s*)?\d+[A-Za-z]?|[A-Z]\.\s*\d+|[IVXLC]+)"
REFERENCE = rf"(?i)\b(?:Supplementary\s+)?Table\s+{NUMBER}\b"
CAPTION = rf"(?im)^\s*(?:Supplementary\s+)?Table\s+{NUMBER}\b\.?"
RANGE = r"(?i)\bTables\s+(\d+)\s*[-–—]\s*(\d+)\b"
PAIR = r"(?i)\bTables\s+(\d+)\s+(?:and|,)\s*(\d+)\b"
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")
MATH_OR_DIGIT = r"\d|[=+\-*/×÷∑∏√∫∂∇≤≥≈≠±%]"
WINDOWS, MOST_WINDOWS, LEAST_CHARS = (12, 9, 7, 5), 80, 16


def table_number(num: Column) -> Column:
    """S 3 is S3, a.1 is A1; blank for null."""
    s = F.regexp_replace(F.upper(stripped(num)), r"\s+", "")
    return F.when(s.rlike(r"^[A-Z]\.\d+"), F.replace(s, F.lit("."))).otherwise(s)


def table_label(num: Column) -> Column:
    n = table_number(num)
    return F.when(n != "", F.concat(F.lit("Table "), n)).otherwise("Table")


def table_numbers(text: Column) -> Column:
    """The distinct numbers of tables that a text refers to, alone, in ranges (up to 50) and in pairs."""
    t = F.coalesce(text, F.lit(""))
    every = lambda p, i: F.regexp_extract_all(t, F.lit(p), F.lit(i))
    single = F.filter(F.transform(every(REFERENCE, 1), table_number), lambda n: n != "")
    bounds = F.arrays_zip(every(RANGE, 1).alias("a"), every(RANGE, 2).alias("b"))
    fits = F.filter(bounds, lambda r: (r["a"].cast("long") > 0) & (r["a"].cast("long") <= r["b"].cast("long")) & (r["b"].cast("long") <= 50))
    ranges = F.flatten(F.transform(fits, lambda r: F.transform(F.sequence(r["a"].cast("int"), r["b"].cast("int")), lambda n: n.cast("string"))))
    pairs = F.transform(F.concat(every(PAIR, 1), every(PAIR, 2)), lambda n: n.cast("long").cast("string"))
    return F.array_distinct(F.concat(single, ranges, pairs))


def expected_tables(*texts: DataFrame) -> DataFrame:
    """doc_id, num: the distinct table numbers that pages and sections (doc_id, text) refer to."""
    rows = [t.select("doc_id", F.explode(table_numbers(F.col("text"))).alias("num")) for t in texts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.distinct()


def table_order(num: Column) -> Column:
    """Sort key of table numbers: plain ones, then by letter, then of supplements; Roman ones by value, others last."""
    s = table_number(num)
    part = lambda i: F.regexp_extract(s, r"^(S?)([A-Z]?)(\d+)([A-Z]?)", i)
    letter = lambda c, base: F.ascii(c) - base
    value = F.nullif(part(3), F.lit("")).cast("double") + F.when(part(1) != "", 2000).otherwise(0)
    value = value + F.when(part(2) != "", 1000 + letter(part(2), 65) * 100).otherwise(0) + F.when(part(4) != "", letter(part(4), 64) / 100).otherwise(0.0)
    roman = F.array_position(F.array(*map(F.lit, ROMAN)), s)
    return F.struct(F.coalesce(value, F.when(roman > 0, roman.cast("double")), F.lit(9999.0)).alias("value"), s.alias("num"))


def natural_order(figure_id: Column) -> Column:
    """Sort key of figure ids: their first number, those without one last."""
    n = F.nullif(F.regexp_extract(F.coalesce(figure_id, F.lit("")), r"(\d+)", 1), F.lit(""))
    return F.struct(F.coalesce(n.cast("long"), F.lit(10**9)).alias("n"), figure_id.alias("id"))


def table_documents(tables: DataFrame) -> DataFrame:
    """Tables (doc_id, at, num, raw, caption, page, recovered) once each, in order, as table01, table02, ...

    Of equal number and text (160 characters) the first stays; tables without text and caption go.
    """
    raw, num = stripped(F.col("raw")), F.coalesce("num", F.lit(""))
    d = tables.withColumn("raw", raw).where((F.col("raw") != "") | (F.coalesce("caption", F.lit("")) != ""))
    once = Window.partitionBy("doc_id", F.lower(num), F.lower(F.substring("raw", 1, 160))).orderBy("at")
    d = d.withColumn("copy", F.row_number().over(once)).where("copy = 1").drop("copy")
    first = F.coalesce(F.nullif(F.regexp_extract(num, r"(\d+)", 1), F.lit("")).cast("long"), F.lit(10**6))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(first, num, F.coalesce("page", F.lit(0)), "at"))
    return d.withColumn("table_id", F.format_string("table%02d", nth))


def table_totals(documents: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, table_count, expected_count, expected_unrecovered, tables_unrecovered of each paper."""
    have = documents.groupBy("doc_id").agg(F.count("*").alias("table_count"), F.count_if("recovered").alias("recovered"))
    want = expected.groupBy("doc_id").agg(F.count("*").alias("expected_count"))
    d = have.join(want, "doc_id", "full").na.fill(0)
    lost = F.col("table_count") - F.col("recovered")
    short = F.when(F.col("expected_count") > 0, F.greatest(F.lit(0), F.col("expected_count") - F.col("recovered"))).otherwise(lost)
    return d.select("doc_id", "table_count", "expected_count", short.alias("expected_unrecovered"), F.greatest(lost, short).alias("tables_unrecovered"))


def markdown(rows: Column) -> Column:
    """A grid of cells as a Markdown table: ragged rows are filled up, the first row is the head; blank for none."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    full = lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    lines = F.transform(rows, lambda r: line(full(r)))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1_000_000)), "\n")).otherwise("")


def table_boxes(tables: DataFrame, detections: DataFrame) -> DataFrame:
    """tables (doc_id, table_id, num, page) with the box of the detection of their number, else of the first on their page."""
    number = F.lower(F.nullif(F.regexp_extract(F.coalesce("caption", F.lit("")), r"(?i)\bTable\s+((?:[A-Z]\.?)?\d+[A-Za-z]?|[IVXLC]+)\b", 1), F.lit("")))
    d = detections.where("box is not null").select("doc_id", "at", F.col("page").alias("d_page"), number.alias("d_num"), "box")
    by_num = d.where("d_num is not null").groupBy("doc_id", F.col("d_num").alias("l_num")).agg(F.min_by(F.struct("box", "d_page"), "at").alias("a"))
    by_page = d.groupBy("doc_id", F.col("d_page").alias("page")).agg(F.min_by(F.struct("box", "d_page"), "at").alias("b"))
    t = tables.withColumn("l_num", F.lower("num")).join(by_num, ["doc_id", "l_num"], "left").join(by_page, ["doc_id", "page"], "left")
    hit = F.coalesce("a", "b")
    return t.select("doc_id", "table_id", "num", "page", hit["box"].alias("box"), F.coalesce(hit["d_page"], "page").alias("box_page"))


def search_text(text: Column) -> Column:
    t = F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" "))
    return F.lower(stripped(F.regexp_replace(t, r"\s+", " ")))


def search_windows(text: Column) -> Column:
    """Up to 80 distinct runs of 12, 9, 7 and 5 words of a text that have a digit or a sign."""
    words = F.split(search_text(text), " ")
    runs = []
    for w in WINDOWS:
        starts = F.when(F.size(words) >= w, F.sequence(F.lit(1), F.size(words) - w + 1)).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(starts, _run(words, w)))
    fit = F.filter(F.concat(*runs), lambda x: (F.length(x) >= LEAST_CHARS) & x.rlike(MATH_OR_DIGIT))
    return F.slice(F.array_distinct(fit), 1, MOST_WINDOWS)


def _run(words: Column, w: int):
    return lambda i: F.array_join(F.slice(words, i, F.lit(w)), " ")


def page_of_text(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """``queries`` (doc_id, id, text) with the first page (doc_id, page, text) that holds the text, else the first of its runs of words that a page holds."""
    p = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", search_text(F.col("text")).alias("t")))).alias("pages"))
    q = queries.withColumn("q", search_text(F.col("text"))).join(p, "doc_id", "left")
    holds = lambda w: F.get(F.filter("pages", lambda x: F.contains(x["t"], w)), F.lit(0))["page"]
    runs = F.get(F.filter(F.transform(search_windows(F.col("text")), holds), lambda x: x.isNotNull()), F.lit(0))
    found = F.when(F.length("q") >= LEAST_CHARS, F.coalesce(holds(F.col("q")), runs))
    return q.select("doc_id", "id", found.alias("page"))


def caption_page(pages: DataFrame, numbers: DataFrame) -> DataFrame:
    """doc_id, num, page: the first page with a caption of a table, else the first that mentions it."""
    found = lambda p: F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), F.lit(1)), table_number)
    kinds = F.concat(*(F.transform(F.array_distinct(found(p)), _ranked(r)) for r, p in enumerate((CAPTION, REFERENCE))))
    rows = pages.select("doc_id", "page", F.explode(kinds).alias("x")).select("doc_id", "page", "x.*")
    best = rows.groupBy("doc_id", "num").agg(F.min(F.struct("rank", "page")).alias("x")).select("doc_id", "num", "x.page")
    return numbers.withColumn("num", table_number(F.col("num"))).join(best, ["doc_id", "num"], "left")


def _ranked(rank: int):
    return lambda n: F.struct(n.alias("num"), F.lit(rank).alias("rank"))


def box_of_regions(coords: Column) -> Column:
    """The box around all regions (page,x,y,w,h;...) on the first region's page; null for none."""
    regions = F.filter(F.transform(F.split(F.coalesce(coords, F.lit("")), ";"), lambda r: F.split(r, ",")), lambda r: F.size(r) >= 5)
    number = lambda r, i: r[i].cast("double")
    page = F.get(regions, F.lit(0))[0]
    same = F.filter(regions, lambda r: r[0] == page)
    most = lambda f: F.array_max(F.transform(same, f))
    least = lambda i: F.array_min(F.transform(same, lambda r: number(r, i)))
    x, y = least(1), least(2)
    right, low = most(lambda r: number(r, 1) + number(r, 3)), most(lambda r: number(r, 2) + number(r, 4))
    return F.when(F.size(regions) > 0, F.struct(page.cast("int").alias("page"), x.alias("x"), y.alias("y"), (right - x).alias("w"), (low - y).alias("h")))
