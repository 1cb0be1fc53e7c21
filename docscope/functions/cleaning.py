"""Cleaning of extracted text: symbols that extraction breaks, compatibility forms, control characters, hyphenation, spacing."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscope.plans.shipping import ship_package

# What stands for what after extraction.
SYMBOLS = {
    "1⁄4": "=", "¼": "=", "À": "-", "þ": "+", "∕": "/", "\x02": "±", "\x03": "°", "\x04": "-", "‐": "-",
    "‑": "-", "‒": "-",
}
RULES = (
    (r"(?<=[0-9)\]])\s*Â\s*(?=[0-9A-Za-z(])", " × "), (r"(?<=[A-Za-z])\s+Â\s*(?=[0-9(])", " × "), (r"\bAE\s+SEM\b", "± SEM"),
    (r"(?<=\d)\s+AE\s+(?=\d)", " ± "),
)
SPACING = (
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "), (r"\b([A-Za-z]{3,})-\s+([a-z]{2,})\b", r"\1\2"), (r"\s+([,.;:!?])", r"\1"),
    (r"([(\[{])\s+", r"\1"), (r"\s+([)\]}])", r"\1"), (r"(?i)\bFig\s*\.\s*", "Fig. "), (r"(?i)\bEq\s*\.\s*", "Eq. "),
    (r"(?i)\bTab\s*\.\s*", "Table "),
)
EQUATION_SIGNS = str.maketrans({"•": " ", "−": "-", "–": "-", "—": "-", "Ã": "*", "ð": "(", "Þ": ")", "×": " × "})


def _symbols(s: str) -> str:
    for bad, good in SYMBOLS.items():
        s = s.replace(bad, good)
    for pattern, good in RULES:
        s = re.sub(pattern, good, s)
    return s


def clean(s: str | None) -> str:
    """One cleaned text; blank for null."""
    if not s:
        return ""
    s = _symbols(unicodedata.normalize("NFKC", _symbols(s))).replace("­", "").replace("�", "")
    for pattern, good in SPACING:
        s = re.sub(pattern, good, s)
    s = "\n".join(re.sub(r"[ \t]{2,}", " ", line).strip() for line in s.splitlines())
    return re.sub(r"\n{3,}", "\n\n", s).strip()


def clean_equation(s: str | None) -> str:
    s = re.sub(r"\s*([=+\-*/^])\s*", r" \1 ", clean(s).translate(EQUATION_SIGNS))
    return re.sub(r"\s+", " ", s).strip()


def cleaned(df: DataFrame, *columns: str, equations: bool = False) -> DataFrame:
    """``df`` with these text columns cleaned, in Arrow batches: compatibility forms have no built-in function."""
    ship_package(df.sparkSession)
    one = clean_equation if equations else clean

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return df.withColumns({c: run(F.col(c)) for c in columns})


def _loose(word: str) -> str:
    return r"\s*".join(word)


#: Layout markers whose letters extraction has set apart, with the name of what they mark.
MARKER_NAMES = "|".join([*map(_loose, ("End", "Start")), r"H\s*\d", r"P\b", *map(_loose, ("Table", "Figure", "Box", "List"))])
MARKERS = rf"(?i)(?:T\s+A\s+G\s+G\s+E\s+D)\s*(?:{MARKER_NAMES})?|Tagged\s*(?:{MARKER_NAMES})"


def without_markers(text: Column) -> Column:
    """Without layout markers, with single blanks; null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, MARKERS, " "), r"\s+", " "))
