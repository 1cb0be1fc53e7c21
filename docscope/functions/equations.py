"""Text of equations: spacing, printed numbers, what is none, confidence, and a form near to LaTeX."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .headings import stripped

# Signs and words that tell equations from rows of tables and from prose.
MATH = r"(?i)[=+\-*/×÷∑∏√∫∂∇≤≥≈≠±∞→←↔⇌ρσμλβθαπΔ%]|\b(?:sin|cos|tan|log|ln|exp|min|max)\b"
TABLE_WORDS = (
    r"(?i)\b(?:Description|Parameter|Parameters|Mean|Max|Min|SD|CV|Standard|Samples?|Rate|Grade|Template|Primer|Amplicon|Sequence|Genes?|"
    r"Expert|Index|weight|LEVEL|NUMBER|Sample codes|Conditions|Groups|Chewing|Smoking|Alcohol|Age/Gender|Patient code)\b"
)
PROSE_WORDS = (
    r"(?i)\b(?:Compared with|respectively|calculated according|shown in|described by|represents|indicates|where|therefore|because|however|"
    r"moreover|furthermore|supplementary|Figure|Table|Appendix|References|Acknowledgements|Declaration|CRediT)\b"
)
SENTENCE_VERBS = r"(?i)\b(?:is|are|was|were|has|have|had|shows?|showed|represents?|indicates?|calculated|determined)\b"
CHECKMARKS = r"[✓✔☑]"
GRADE_ROW = r"(?i)(?:\b[A-G]\b\s+){4,}\d+(?:\.\d+)?\s*(?:±|\+/-)\s*\d+(?:\.\d+)?"
NAMED_ROWS = r"(?i)(?:\b(?:complex|sample|compound|control|mesotrione|parameter|index|grade)\s*[-_]?\w*\b.*?){2,}"
PUBLISHER = r"(?i)\b(?:et al\.?|journal homepage|ScienceDirect|Published by|creativecommons)\b"
STRONG_MATH = r"(?i)=|∑|∏|√|∫|∂|∇|\b(?:sin|cos|tan|log|ln|exp)\b"
COMMANDS = {
    "×": "times", "÷": "div", "∑": "sum", "∏": "prod", "√": "sqrt{}", "∂": "partial", "∇": "nabla", "ρ": "rho", "σ": "sigma", "μ": "mu",
    "λ": "lambda", "β": "beta", "θ": "theta", "α": "alpha", "π": "pi", "Δ": "Delta", "≤": "le", "≥": "ge", "≈": "approx", "≠": "ne",
    "±": "pm", "→": "to", "←": "leftarrow", "↔": "leftrightarrow", "⇌": "rightleftharpoons",
}
INDICES = r"\b([A-Za-z])\s+(hkl|tot|app|skel|max|min|ij|ji|i|j|n|m)\b"
CONTINUATION = r"^\s*[)\]}]+\s*(?:\(?(\d{1,3})\)?)?\s*$"


def spaced(text: Column) -> Column:
    """Single blanks, none before commas, and one around each sign; blank for null."""
    t = stripped(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" ")), r"\s+", " "))
    t = F.regexp_replace(F.regexp_replace(t, r"\s+([,;:])", "$1"), "([=+×÷*/])", " $1 ")
    return stripped(F.regexp_replace(t, r"\s{2,}", " "))


def printed_number(text: Column) -> Column:
    """The last number in brackets, else a number at the end; null for none."""
    t = F.coalesce(text, F.lit(""))
    bracketed = F.regexp_extract_all(t, F.lit(r"\((\d{1,3})\)"), F.lit(1))
    last = F.regexp_extract(t, r"(?:^|\s)(\d{1,3})\s*$", 1)
    return F.coalesce(F.get(F.reverse(bracketed), F.lit(0)), F.nullif(last, F.lit(""))).cast("int")


def _count(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern))


def reject_reasons(text: Column) -> Column:
    """rejected and reasons: whether a formula is a row of a table or prose."""
    t = spaced(text)
    words, signs, digits, size = _count(t, "[A-Za-z]{3,}"), _count(t, MATH), _count(t, r"\d"), F.length(t)
    tests = {
        "checkmark_table_cells": t.rlike(CHECKMARKS), "grade_letter_table_sequence": t.rlike(GRADE_ROW),
        "repeated_table_row_sequence": t.rlike(NAMED_ROWS) & (signs <= 2), "table_like_words": t.rlike(TABLE_WORDS),
        "prose_like_words": t.rlike(PROSE_WORDS), "long_prose_without_math_symbols": (words >= 8) & (signs == 0),
        "sentence_like_formula": (words >= 10) & t.rlike(SENTENCE_VERBS) & (signs <= 1),
        "very_long_prose_like_formula": (size > 220) & (words > 18) & (signs <= 2), "header_footer_or_publisher_text": t.rlike(PUBLISHER),
    }
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in tests.items())))
    has = lambda *names: F.arrays_overlap(reasons, F.array(*map(F.lit, names)))
    hard = has(*list(tests)[:3]) | (has("table_like_words") & ((signs <= 2) | (words >= 5)))
    numeric = (size > 140) & (digits >= 18) & ~t.rlike(STRONG_MATH)
    soft = has(*list(tests)[5:])
    out = lambda no, why: F.struct(no.alias("rejected"), why.alias("reasons"))
    one = lambda name: F.array(F.lit(name))
    return (
        F.when(t == "", out(F.lit(True), one("empty_formula_text"))).when(size <= 3, out(F.lit(True), one("too_short")))
        .when(hard, out(F.lit(True), reasons)).when(numeric, out(F.lit(True), F.array_append(reasons, "long_numeric_table_row")))
        .otherwise(out(soft, reasons))
    )


def confidence(raw: Column, clean: Column, repaired: Column) -> Column:
    """status (clean, repaired, needs_review or rejected) and reasons of an equation."""
    best = F.coalesce(F.nullif(clean, F.lit("")), raw)
    t, no = spaced(best), reject_reasons(best)
    uneven = lambda a, b: _count(t, a) != _count(t, b)
    tests = {
        "unbalanced_parentheses": uneven(r"\(", r"\)"), "unbalanced_brackets": uneven(r"\[", r"\]"),
        "pdf_math_glyph_noise": F.coalesce(F.nullif(raw, F.lit("")), t).rlike("ffiffi|ð|Þ|Á|Ã|�"), "few_alphanumeric_symbols": _count(t, "[A-Za-z0-9]") < 3,
        "possible_lost_greek_symbol": t.rlike(r"(?i)\b(?:rho|sigma|alpha|beta)\b"), "possible_fraction_format_loss": t.rlike(r"\b\w+\s+\w+\s+\d+\s*/\s*\d+\b"),
    }
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in tests.items())))
    out = lambda status, why: F.struct(F.lit(status).alias("status"), why.alias("reasons"))
    return (
        F.when(no["rejected"], out("rejected", no["reasons"])).when(F.size(reasons) > 0, out("needs_review", reasons))
        .when(repaired, out("repaired", F.array(F.lit("merged_split_formula_or_repaired_numbering"))))
        .otherwise(out("clean", F.array().cast("array<string>")))
    )


def latex_like(text: Column) -> Column:
    t = spaced(text)
    for sign, name in COMMANDS.items():
        t = F.replace(t, F.lit(sign), F.lit("\\\\" + name))
    return F.regexp_replace(t, INDICES, "$1_{$2}")


def is_continuation(text: Column) -> Column:
    """A fragment of closing brackets, with or without a number."""
    return text.rlike(CONTINUATION)


def is_fragment(body: Column) -> Column:
    """Brackets and marks, a number alone, or three characters without a letter."""
    b = stripped(body)
    return (b == "") | b.rlike(r"^[()\[\]{}\s,.;:]+$") | b.rlike(r"^\(?\s*\d+[A-Za-z]?\s*\)?$") | ((F.length(b) <= 3) & ~b.rlike("[A-Za-zα-ωΑ-Ω∂]"))


def numbered_parts(text: Column) -> Column:
    """A formula with several printed numbers cut after each; what follows the last stays if it has a sign."""
    t = spaced(text)
    parts = F.transform(F.split(F.regexp_replace(t, r"(\(\d{1,3}\))", "$1\u0001"), "\u0001"), stripped)
    n = F.size(parts)
    kept = F.filter(parts, lambda p, i: (p != "") & ((i < n - 1) | p.rlike(MATH)))
    return F.when(t == "", F.array().cast("array<string>")).when(_count(t, r"\(\d{1,3}\)") > 1, kept).otherwise(F.array(t))
