"""Tables in the text of pages: what each line is, the blocks from a caption to where the table stops, and their parts.

A page is scanned with windows over its lines, so that no task holds more than a page. Pages without a caption are
left out before their lines are dealt. Null texts and texts without a caption give no rows; rows of one document and
page are taken as one page in an order of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscope.functions import rules as R
from docscope.functions.headings import stripped

# The patterns of captions, of lines that stop a table and of prose.
CAPTION_LINE = r"(?i)^\s*Table\s+((?:[A-Z]\.?)?\d+[A-Za-z]?|[IVXLC]+)\b\.?(.*)$"
MENTION = (
    r"(?i)^\s*Table\s+(?:(?:S\s*)?\d+[A-Za-z]?|[A-Z]\.\s*\d+|[IVXLC]+)\b\.?\s*"
    r"(?:shows?|presents?|lists?|summari[sz]es?|reports?|provides?|indicates?|illustrates?|demonstrates?|contains?"
    r"|is|are|was|were|has|have|and|or|for|in|from|with|without|of|to)\b"
)
SAYS = (
    r"(?i)^(?:for more details|presents?|shows?|lists?|reports?|provides?|summari[sz]es?|indicates?|illustrates?"
    r"|is|are|was|were|has|have)\b"
)
SECTION_LINE = r"^\s*\d+(?:\.\d+)*\.?\s+[A-Z][A-Za-z]"
FIGURE_LINE = r"(?i)^\s*Fig(?:ure)?\.?\s+\d"
PAGE_NUMBER = r"^\s*\d{1,4}\s*$"
FOOT_LINE = (
    r"^\s*(?:\d{1,4}\s+)?(?:[A-Z]\.?\s+[A-Z][a-z]+.*\bet al\.?|[A-Z](?:\.[A-Z])+.*\s*/\s*[^/]+\s+\d+.*"
    r"|[A-Z][A-Za-z .-]+\s+et\s+al\.?"
    r"|.*\b(?:ScienceDirect|Elsevier|Contents lists available|journal homepage|Transportation Research Part"
    r"|Computer Communications|Ad Hoc Networks|Acta Biomaterialia)\b.*"
    r"|.*\b(?:https?://|doi\.org|creativecommons|Published by Elsevier)\b.*)\s*$"
)
BACK_LINE = (
    r"(?i)^\s*(?:CRediT authorship|Declaration of competing interest|Acknowledg(?:e)?ments?|Appendix|References|Funding"
    r"|Data availability|Supplementary|Supporting information)\b"
)
STRONG_PROSE = (
    r"(?i)^\s*(?:The |This |These |Those |There |Here |Hence |Thus |Therefore|Moreover|Furthermore|In addition|In contrast"
    r"|Overall|Finally|Next|Also|We |Our |A |An |For |As |From )\b"
)
AFTER_TABLE = (
    r"(?i)^\s*(?:Intruder\b|The mentioned tool\b|Next,?\b|Also,?\b|Then,?\b|Here we\b|Table\s+\d+\s+presents\b"
    r"|For these results\b|Please note\b|We included\b|We numbered\b|The first execution\b|In other executions\b"
    r"|In the rest of\b|the adversarial model\b"
    r"|[A-Z]?[A-Za-z0-9-]+(?:,\s*[A-Z]?[A-Za-z0-9-]+)+\s+(?:is|are|was|were|has|have|show|shows|showed|exhibited)\b)"
)
PROSE_OPENING = (
    r"(?i)^\s*(?:As shown|As can be seen|The results|These results|This|These|Therefore|Moreover|Furthermore|In addition"
    r"|A summary|We |Our |It is |municipal |explored for |and the variations)\b"
)
VERBS = r"(?i)\b(?:is|are|was|were|has|have|had|shows?|showed|measured|observed|exhibited|indicated)\b"
SIGNS = "[\\p{Nd}²³¹⁰⁴-⁹₀-₉%±.,/()=<>|:;–-]"
NEXT_BLOCK = r"(?i)^(?:Fig(?:ure)?\.?\s+\d+|Table\s+\d+|\d+(?:\.\d+)*\.?\s+[A-Z])\b"
CAPTION_BODY = r"^(?:The|This|These|Those|There|In|For|As|We|Our)\b"
CAPTION_LEAK = r"(?i)\b(?:Eqs?\.\s*\(|Calculation indexes|Determination of the total)\b"
CAPTION_END = r"(?i)\b(?:Eqs?\.\s*\(|Calculation indexes|Determination of|For more details)\b"
RUNNING_LINE = r"(?i)^\s*(?:\d+\s*)?(?:[A-Z]\.?\s*)?[A-Z][A-Za-z .-]+\s+et\s+al\.?\s*$|^\s*[A-Z][A-Za-z &-]+\s+\d+\s*\([^)]*\)\s*\d+[-–]\d+\s*$"
OTHER_BLOCK = r"(?i)^(?:Fig(?:ure)?\.?\s+\d+|References|Declaration of competing interest|CRediT authorship|Acknowledg)"
CAPTION_CHARS, HEAD_CHARS = 500, 120

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def _share(s: Column) -> Column:
    return F.coalesce(F.regexp_count(s, F.lit(SIGNS)) / F.nullif(F.length(s), F.lit(0)), F.lit(0.0))


def _words(s: Column) -> Column:
    return F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")


def holds_data(line: Column) -> Column:
    """A tenth of digits and signs, or two short words in a line that is not prose."""
    s = stripped(line)
    prose = (F.length(s) >= 60) & (_share(s) < 0.12) & (F.regexp_count(s, F.lit("[A-Za-z]{4,}")) >= 8)
    short = F.size(F.filter(_words(s), lambda w: F.length(w) <= 14))
    return (s != "") & ((_share(s) >= 0.10) | ((short >= 2) & ~prose))


def is_stop(line: Column) -> Column:
    return F.lit(False) | line.rlike(FIGURE_LINE) | line.rlike(SECTION_LINE) | line.rlike(FOOT_LINE) | line.rlike(BACK_LINE) | line.rlike(AFTER_TABLE)


def is_sentence(line: Column) -> Column:
    """A piece of a sentence, by its opening or its words, of 28 characters or more."""
    s = stripped(line)
    words, opens = F.regexp_count(s, F.lit("[A-Za-z]{3,}")), s.rlike(PROSE_OPENING)
    by_words = ((words >= 7) & s.rlike(VERBS)) | ((words >= 8) & (s.rlike(STRONG_PROSE) | s.rlike(r"^\p{Ll}"))) | opens
    return (F.length(s) >= 28) & (s.rlike(BACK_LINE) | s.rlike(AFTER_TABLE) | ((_share(s) < 0.22) & by_words))


def continues_table(line: Column) -> Column:
    """Blank, or no stop and no sentence, with some digits or eight words at most and no full stop."""
    s = stripped(line)
    fits = (_share(s) >= 0.08) | ((F.size(_words(s)) <= 8) & ~s.endswith("."))
    return (s == "") | (~is_stop(s) & ~is_sentence(s) & fits)


def caption_number(line: Column, after: Column) -> Column:
    """The number of the table whose caption begins here; null for other lines and for mentions of a table."""
    rest = stripped(F.regexp_extract(line, CAPTION_LINE, 2))
    plain = F.regexp_replace(F.translate(line, " −–—", " ---"), r"[ \t]+", " ")
    mention = plain.rlike(MENTION) | rest.rlike(SAYS) | rest.rlike(r"^[)\].,;:]|^\p{Ll}") | ((rest == "") & after.rlike(SECTION_LINE))
    return F.when(line.rlike(CAPTION_LINE) & ~mention, F.regexp_extract(line, CAPTION_LINE, 1))


def continues_caption(line: Column) -> Column:
    s = stripped(line)
    like = s.rlike(r"[.;:]$") | ((F.regexp_count(s, F.lit("[A-Za-z]{3,}")) >= 5) & (_share(s) < 0.12)) | s.rlike(r"^\p{Ll}")
    return (s != "") & ~is_stop(s) & like


def spaces(text: Column) -> Column:
    """Runs of blanks as one, none around line ends."""
    return stripped(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t]+", " "), r" *\n *", "\n"))


def table_blocks(pages: DataFrame) -> DataFrame:
    """doc_id, page, at, num, text, caption_only: from each caption of ``pages`` (doc_id, page, text) to where its table stops.

    It stops at the next caption, heading, figure, footer or back matter, and at prose once two lines of data are seen.
    """
    held = pages.where(F.col("text").rlike("(?im)^\\s*Table\\s")).select("doc_id", "page", F.split("text", LINE_END).alias("lines"))
    pair = lambda x, i: F.struct(i.alias("k"), x.alias("line"), F.coalesce(F.get("lines", i + 1), F.lit("")).alias("after"))
    rows = held.select("doc_id", "page", F.explode(F.transform("lines", pair)).alias("x")).select("doc_id", "page", "x.*")
    line = F.col("line")
    opens, sentence = line.rlike(PROSE_OPENING), is_sentence(line)
    facts = {
        "num": caption_number(line, F.col("after")), "data": holds_data(line), "stop": is_stop(line), "sentence": sentence, "opens": opens,
        "prose": sentence | (line.rlike(STRONG_PROSE) & ~continues_table(line)),
        "noise": is_stop(line) | line.rlike(PAGE_NUMBER) | opens | sentence | line.rlike("(?i)continued on next page"),
    }
    by_page = Window.partitionBy("doc_id", "page").orderBy("k")
    rows = rows.withColumns(facts).withColumn("at", F.count("num").over(by_page)).where("at > 0")
    block = Window.partitionBy("doc_id", "page", "at").orderBy("k")
    rows = rows.withColumn("n", F.row_number().over(block) - 1)
    rows = rows.withColumn("seen", F.count_if(F.col("data") & (F.col("n") > 0)).over(block))
    before = F.col("seen") - F.col("data").cast("int")
    ends = (F.col("n") > 0) & (F.col("stop") | ((before >= 2) & F.col("prose")))
    ends = ends | ((F.col("n") >= 3) & (F.col("seen") >= 2) & (F.col("opens") | F.col("sentence")))
    rows = rows.withColumn("ended", F.max(ends).over(block)).where("not ended")
    kept = F.array_sort(F.collect_list(F.struct("n", "line", "data", "noise")))
    blocks = rows.groupBy("doc_id", "page", "at").agg(F.first("num", ignorenulls=True).alias("num"), kept.alias("x"))
    last = F.array_max(F.transform(F.filter("x", lambda r: ~r["noise"]), lambda r: r["n"]))
    blocks = blocks.withColumn("x", F.slice("x", F.lit(1), F.coalesce(last + 1, F.lit(0))))
    n_data = F.size(F.filter("x", lambda r: r["data"] & (r["n"] > 0)))
    text = spaces(F.array_join(F.transform("x", lambda r: r["line"]), "\n"))
    return blocks.select("doc_id", "page", "at", "num", text.alias("text"), (n_data < 2).alias("caption_only")).where("text <> ''")


def _full_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, LINE_END), stripped), lambda x: x != "")


def _plain(text: Column) -> Column:
    return spaces(F.translate(F.coalesce(text, F.lit("")), " −–—", " ---"))


def _first_at(array: Column, test) -> Column:
    """The position, from 0, of the first item that passes ``test`` (item, position); the size for none."""
    hits = F.filter(F.transform(array, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.size(array))


def clean_caption(caption: Column) -> Column:
    """text and reasons: the lines of a caption up to the next block, body text, an equation or 500 characters."""
    lines = _full_lines(_plain(caption))
    chars = lambda n: F.length(F.array_join(F.slice(lines, F.lit(1), n), " "))
    block = _first_at(lines, lambda x, i: (i > 0) & x.rlike(NEXT_BLOCK))
    body = _first_at(lines, lambda x, i: (i > 0) & x.rlike(CAPTION_BODY) & (chars(i) > 30))
    leak = _first_at(lines, lambda x, i: x.rlike(CAPTION_LEAK))
    long = _first_at(lines, lambda x, i: chars(i + 1) > CAPTION_CHARS) + 1
    end = F.least(block, body, leak, long)
    why = F.when(long <= F.least(block, body, leak), "caption_truncated_long").when(block == end, "caption_cut_at_next_block")
    why = why.when(body == end, "caption_body_leakage_removed").otherwise("caption_equation_or_body_leakage_removed")
    reasons = F.when(F.size(lines) == 0, F.array(F.lit("empty_caption"))).when((end < F.size(lines)) | (long == end), F.array(why))
    text = _plain(F.array_join(F.slice(lines, F.lit(1), end), "\n"))
    return F.struct(text.alias("text"), F.coalesce(reasons, F.array().cast("array<string>")).alias("reasons"))


def clean_body(body: Column) -> Column:
    """text and sorted reasons: the lines of a table without running lines, up to another block or prose after two lines of data."""
    runs = lambda x: x.rlike(R.FOOTER) | x.rlike(RUNNING_LINE)
    lines = _full_lines(_plain(body))
    rows = F.filter(lines, lambda x: ~runs(x))
    data = F.filter(F.transform(rows, lambda x, i: F.when(R.is_data_line(x), i)), lambda i: i.isNotNull())
    second = F.coalesce(F.get(data, F.lit(1)), F.size(rows))
    other = _first_at(rows, lambda x, i: x.rlike(OTHER_BLOCK))
    prose = _first_at(rows, lambda x, i: (i > second) & R.is_prose_line(x))
    end = F.least(other, prose)
    # Running lines after the end are not counted: they are looked for among the lines before it only.
    nth = _first_at(lines, lambda x, i: ~runs(x) & (F.size(F.filter(F.slice(lines, F.lit(1), i + 1), lambda y: ~runs(y))) == end + 1))
    removed = F.exists(F.slice(lines, F.lit(1), nth), runs)
    reasons = F.sort_array(F.array_compact(F.array(
        F.when(removed, "removed_header_footer_line"), F.when((other == end) & (end < F.size(rows)), "cut_at_non_table_block"),
        F.when((prose == end) & (prose < other), "removed_trailing_prose"),
    )))
    return F.struct(_plain(F.array_join(F.slice(rows, F.lit(1), end), "\n")).alias("text"), reasons.alias("reasons"))


def caption_and_body(text: Column) -> tuple[Column, Column]:
    """The caption of a block, with the lines that go on with it, and the rest of it, both cleaned."""
    lines = _full_lines(text)
    rest = F.slice(lines, F.lit(2), F.size(lines))
    n = _first_at(rest, lambda x, i: ~continues_caption(x) | x.rlike(CAPTION_END)) + 1
    join = lambda start, size: F.array_join(F.slice(lines, start, size), "\n")
    return clean_caption(spaces(join(F.lit(1), n)))["text"], clean_body(join(n + 1, F.size(lines)))["text"]


def is_weak_body(body: Column) -> Column:
    """Fewer than three lines or two of data, or as many sentences as data."""
    lines = _full_lines(F.coalesce(body, F.lit("")))
    data, sentences = F.size(F.filter(lines, holds_data)), F.size(F.filter(lines, is_sentence))
    return (F.size(lines) < 3) | (data < 2) | ((sentences >= 2) & (sentences >= data))


def tables_of_pages(pages: DataFrame) -> DataFrame:
    """One row for each table number of a document: doc_id, num, page, caption, body, text, caption_only, low_confidence, score, reasons.

    The first block of a number gives its page, caption and score; bodies of later blocks of it, on this page or others,
    are added in order unless they are there already or begin like an earlier one. Rows with a null doc_id are left out:
    they are of no document, and may be many.
    """
    blocks = table_blocks(pages.where("doc_id is not null"))
    caption, body = caption_and_body(F.col("text"))
    # A noop cut of the expression: without it the optimizer copies the cleaning into each of its uses.
    b = blocks.withColumn("p", F.explode(F.array(F.struct(caption.alias("caption"), body.alias("body")))))
    more = F.coalesce(F.nullif(F.col("p.body"), F.lit("")), F.col("text"))
    head = F.lower(spaces(F.substring(more, 1, HEAD_CHARS)))
    one = F.struct("page", "at", "num", "text", F.col("p.caption").alias("caption"), F.col("p.body").alias("body"), "caption_only", more.alias("more"), head.alias("head"))
    t = b.groupBy("doc_id", F.lower("num").alias("key")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    t = t.withColumn("first", F.get("x", F.lit(0)))
    start = F.struct(F.col("first.body").alias("body"), F.array(F.col("first.head")).alias("heads"), F.lit(False).alias("grown"))

    def add(s: Column, r: Column) -> Column:
        known = F.array_contains(s["heads"], r["head"])
        fresh = ~known & ~F.contains(s["body"], r["more"])
        longer = stripped(F.concat(stripped(s["body"]), F.lit("\n"), stripped(r["more"])))
        heads = F.when(known, s["heads"]).otherwise(F.array_append(s["heads"], r["head"]))
        return F.struct(F.when(fresh, longer).otherwise(s["body"]).alias("body"), heads.alias("heads"), (s["grown"] | fresh).alias("grown"))

    t = t.withColumn("s", F.aggregate(F.slice("x", F.lit(2), F.size("x")), start, add))
    text = stripped(F.concat_ws("\n", F.col("first.caption"), F.col("s.body")))
    q = R.table_quality(F.col("first.body"), F.col("first.caption"))
    t = t.withColumn("q", q)
    low = F.when(F.col("s.grown"), is_weak_body(F.col("s.body"))).otherwise(F.col("q.needs_review") | F.col("first.caption_only"))
    return t.select(
        "doc_id", F.col("first.num").alias("num"), F.col("first.page").alias("page"), F.col("first.caption").alias("caption"), F.col("s.body").alias("body"),
        F.when(F.col("s.grown"), text).otherwise(F.col("first.text")).alias("text"), (F.col("first.caption_only") & ~F.col("s.grown")).alias("caption_only"),
        low.alias("low_confidence"), F.col("q.score").alias("score"), F.col("q.reasons").alias("reasons"),
    )
