"""Predicates and scores of paper content as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of a line of code, of a mathematical heading and of captions.
CODE_LINE = (
    r"^\s*#",
    r"^\s*(?:def|class|import|from|return|elif|else:|for |while |if |try:|except)\b",
    r"\bGPIO\.|\bself\.|\bprint\s*\(|\brange\s*\(|\bimport\b",
    r"^\s*[A-Za-z_][A-Za-z0-9_]*\s*=\s*[^=]",
    r"[;{}]\s*$",
)
MATH_HEADING = r"(?i)[=∫∑∏√λσψ∂ημνκΩ]|\b(?:dα|dmu|dx|dt)\b|[+*/^]"
CROSS_REFERENCE = (
    r"(?i)^\s*(?:fig(?:ure)?|table|scheme)\s+[SAE]?\d+\b[^.]{0,40}\b(?:available\s+online|in\s+the\s+(?:supplement|appendix)|supplementary)"
)
CUT_CAPTION = r"(?i)(?:for details,? see|see|shown in|described in)\s*$"
BROKEN_WORDS = r"(?i)\b(?:s|vs|emove|tep|ntroduced|reen)\b"


def is_code_block(text: Column) -> Column:
    """At least six lines that are not blank, half of them like code; false for null."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: x.rlike(r"\S"))
    code = F.filter(lines, lambda x: x.rlike("|".join(f"(?:{p})" for p in CODE_LINE)))
    return F.coalesce((F.size(lines) >= 6) & (2 * F.size(code) >= F.size(lines)), F.lit(False))


def is_equation_heading(heading: Column) -> Column:
    words = F.regexp_count(heading, F.lit("[A-Za-z]{3,}"))
    return F.coalesce(heading.rlike(MATH_HEADING) & (words < 5) & ~heading.rlike(r"(?i)\bn\s*\+\s*rate\b"), F.lit(False))


def is_cross_reference(caption: Column) -> Column:
    return F.coalesce(caption.rlike(CROSS_REFERENCE), F.lit(False))


def is_incomplete_caption(caption: Column) -> Column:
    """Empty, under 40 characters, or cut after words like "see"."""
    c = F.trim(F.coalesce(caption, F.lit("")))
    tail = F.regexp_replace(F.lower(c), r"[ .;:,)]+$", "")
    return (F.length(c) < 40) | c.rlike(CUT_CAPTION) | tail.rlike(r"(?:see|for details)$")


def caption_badness(caption: Column) -> Column:
    """Five for each replacement character, one for each double blank and broken word, a third for single letters."""
    c = F.coalesce(caption, F.lit(""))
    count = lambda p: F.regexp_count(c, F.lit(p))
    return (5 * count("�") + count("  ") + count(BROKEN_WORDS) + F.floor(count(r"\b[a-z]\b") / 3)).cast("long")


def figure_type(kind: Column, caption: Column) -> Column:
    scheme = F.coalesce(caption.rlike(r"(?i)^\s*scheme\b"), F.lit(False))
    return F.when(F.lower(kind) == "table", "table").when(scheme, "scheme").otherwise("figure")


def crop_quality(quality: Column, method: Column, reasons: Column) -> Column:
    """page_render, suspicious or good; only good crops are ready for a vision model."""
    doubled = F.exists(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: F.lower(r).contains("duplicate bbox"))
    whole = (quality == "page_render") | (method == "pymupdf_full_page")
    return F.when(whole, "page_render").when(quality.isin("header_strip", "failed") | doubled, "suspicious").otherwise("good")


def first_path(json: Column, *paths: str) -> Column:
    """The first of some dotted paths in a JSON text that is there and not blank."""
    got = (F.trim(F.get_json_object(json, f"$.{p}")) for p in paths)
    return F.coalesce(*(F.when(g != "", g) for g in got), F.lit(""))


def abstract_or_introduction(abstract: Column, introduction: Column, prefix: str, chars: int = 1500) -> Column:
    """The abstract; if there is none, the start of the introduction after a prefix."""
    return F.when(F.trim(F.coalesce(abstract, F.lit(""))) != "", abstract).otherwise(F.concat(F.lit(prefix), F.substring(introduction, 1, chars)))


def mean_known(*values: Column) -> Column:
    """The mean of those of some columns that are not null."""
    n = sum(v.isNotNull().cast("int") for v in values)
    return F.when(n > 0, sum(F.coalesce(v.cast("double"), F.lit(0.0)) for v in values) / n)


def review(needed: Column) -> Column:
    return F.when(needed, "needs_review").otherwise("pass")


def overall(*statuses: Column) -> Column:
    """The worst of some statuses."""
    all_ = F.array(*statuses)
    return F.when(F.array_contains(all_, "failed"), "failed").otherwise(review(F.array_contains(all_, "needs_review")))


# What counts as a data line, as prose, and as text that is not a table's.
DATA_WORDS = r"(?i)\b(?:yes|no|linear fit|control|treated|untreated|mean|max|min|sd|cv|rate|grade)\b"
PROSE_VERBS = r"(?i)\b(?:is|are|was|were|has|have|had|show|shows|showed|indicates?|suggests?|observed|found)\b"
FOOTER = r"(?i)\b(?:ScienceDirect|Elsevier|journal homepage|Contents lists available|doi\.org|creativecommons|Published by|Accepted|Received|Available online)\b"
NOT_A_TABLE = r"(?i)\b(?:Equation|Eqs?\.\s*\(|Calculation indexes)\b"
NUMERIC = r"[0-9%.,+\-–—/()<>±=×:]"
HARD_REASONS = ("empty_table_body", "too_few_table_lines", "possible_prose_leakage", "equation_or_paragraph_leakage")


def numeric_ratio(line: Column) -> Column:
    return F.regexp_count(line, F.lit(NUMERIC)) / F.greatest(F.length(line), F.lit(1))


def is_data_line(line: Column) -> Column:
    """Digits and signs, or two to ten words without a full stop, or a word that tables use."""
    return (numeric_ratio(line) >= 0.10) | (F.size(F.split(line, r"\s+")).between(2, 10) & ~line.endswith(".")) | line.rlike(DATA_WORDS)


def is_prose_line(line: Column) -> Column:
    words = F.regexp_count(line, F.lit("[A-Za-z]{3,}"))
    return (F.length(line) >= 45) & (numeric_ratio(line) < 0.18) & (words >= 8) & line.rlike(PROSE_VERBS)


def table_quality(body: Column, caption: Column) -> Column:
    """score, needs_review and sorted reasons of a recovered table; a null body or caption counts as empty."""
    plain = F.translate(F.coalesce(body, F.lit("")), "\u00a0−–—", " ---")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r" *\n *", "\n"))
    lines = F.filter(F.transform(F.split(plain, "\n"), F.trim), lambda x: x.rlike(r"\S"))
    n, data, prose = F.size(lines), F.size(F.filter(lines, is_data_line)), F.size(F.filter(lines, is_prose_line))
    empty = n == 0
    short = ~empty & (n < 3)
    costs = {
        "missing_caption": (F.trim(F.coalesce(caption, F.lit(""))) == "", 0.10),
        "empty_table_body": (empty, 0.85),
        "too_few_table_lines": (short, 0.35),
        "very_short_recovered_table": (~empty & ~short & (n <= 6) & (F.length(plain) < 140), 0.30),
        "few_data_like_lines": (~empty & (data < 2), 0.25),
        "possible_prose_leakage": ((prose > 0) & (prose >= F.greatest(F.lit(2), data)), 0.25),
        "header_footer_leakage": (plain.rlike(FOOTER), 0.20),
        "equation_or_paragraph_leakage": (plain.rlike(NOT_A_TABLE), 0.20),
        "nested_table_caption_in_body": (plain.rlike(r"(?i)\bTable\s+\d+\b"), 0.10),
    }
    lost = sum(F.when(c, F.lit(v)).otherwise(0.0) for c, v in costs.values())
    score = F.round(F.greatest(F.lit(0.0), F.lit(0.85) - lost), 4)
    reasons = F.sort_array(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, (c, _) in costs.items()))))
    hard = F.arrays_overlap(reasons, F.array(*map(F.lit, HARD_REASONS)))
    return F.struct(score.alias("score"), ((score < 0.70) | hard).alias("needs_review"), reasons.alias("reasons"))
