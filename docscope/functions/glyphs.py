"""Remapping of symbol-font and mathematical glyphs to plain characters, on the JVM by ``translate``."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The symbol font's characters in code order, from U+F020, U+F0A0 and U+F0F1.
SYMBOLS = {
    0xF020: " !∀#∃%&∋()∗+,−./0123456789:;<=>?≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_‾αβχδεϕγηιφκλμνοπθρστυϖωξψζ{|}∼",
    0xF0A0: "€ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…|—↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓◊⟨®©™∑(⎜([⎢[{{{⎪",
    0xF0F1: "⟩∫⌠⎮⌡)⎟)]⎥]}}}",
}
#: Letters that Unicode placed outside the mathematical block.
LETTERLIKE = "ℎℬℰℱℋℐℒℳℛℯℊℴℭℌℑℜℨℂℍℕℙℚℝℤ"


def glyph_map() -> dict[str, str]:
    """Thirteen styles of 52 letters, five of 58 Greek signs and five of ten digits follow each other in Unicode."""
    found = {chr(start + i): c for start, signs in SYMBOLS.items() for i, c in enumerate(signs)}
    for i in range(13 * 52):
        found[chr(0x1D400 + i)] = chr(ord("A") + i % 52 if i % 52 < 26 else ord("a") + i % 52 - 26)
    plain = [*map(chr, range(0x1D6A8, 0x1D7CA)), *map(chr, range(0x1D7CE, 0x1D800)), *LETTERLIKE]
    return found | {c: unicodedata.normalize("NFKC", c) for c in plain}


GLYPHS = glyph_map()


def remap_glyphs(text: Column) -> Column:
    return F.translate(text, "".join(GLYPHS), "".join(GLYPHS.values()))


def unmapped_glyphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, glyph (like U+F8E5), n: private-use characters that the map does not know."""
    left = F.regexp_replace(remap_glyphs(F.col(text)), r"[^\uF000-\uF8FF]", "")
    one = df.select(key, F.explode(F.split(left, "")).alias("c")).where("c <> ''")
    code = F.conv(F.hex(F.encode("c", "UTF-16BE")), 16, 16)
    return one.groupBy(key, F.concat(F.lit("U+"), code).alias("glyph")).agg(F.count("*").alias("n"))
