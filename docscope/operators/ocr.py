"""Tables from the words that text recognition found in a region, with their boxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscope.plans.shipping import ship_package

#: Least distances, in pixels, at which words stand in another row or column, and the shares of height and gap beyond them.
ROW, ROW_SHARE, COLUMN, COLUMN_SHARE = 6.0, 0.65, 18.0, 2.5
MOST_COLUMNS = 12


def _middle(values: list[float]) -> float:
    return sorted(values)[len(values) // 2]


def _rows(words: list[tuple]) -> list[list[tuple]]:
    """Words (x, y, h, text) from top to bottom, each in the first row whose mean centre is near."""
    near = max(ROW, ROW_SHARE * _middle([max(1.0, h) for _, _, h, _ in words]))
    rows: list[list[tuple]] = []
    centres: list[float] = []
    for word in sorted(words, key=lambda w: (w[1], w[0])):
        centre = word[1] + word[2] / 2
        r = next((i for i, c in enumerate(centres) if abs(centre - c / len(rows[i])) <= near), len(rows))
        if r == len(rows):
            rows.append([])
            centres.append(0.0)
        rows[r].append(word)
        centres[r] += centre
    return [sorted(row, key=lambda w: w[0]) for row in rows]


def _columns(xs: list[float]) -> list[float]:
    """Places of columns: left edges in order, each drawn half way to the next edge that is near."""
    xs = sorted(xs)
    gaps = [b - a for a, b in zip(xs, xs[1:], strict=False)]
    near = max(COLUMN, COLUMN_SHARE * (_middle(gaps) if gaps else 20.0))
    places: list[float] = []
    for x in xs:
        if places and abs(x - places[-1]) <= near:
            places[-1] = (places[-1] + x) / 2
        else:
            places.append(x)
    return places


def grid(words: list[tuple]) -> tuple[str, float, list[str]]:
    """The lines of a region, its cells set apart by bars, how table-like it is (0 to 1), and what speaks against it."""
    words = [w for w in words if w[3]]
    if not words:
        return "", 0.0, ["no_ocr_words"]
    rows, places = _rows(words), _columns([w[0] for w in words])
    lines, wide = [], 0
    for row in rows:
        cells: dict[int, list[str]] = {}
        for x, _, _, text in row:
            cells.setdefault(min(range(len(places)), key=lambda k: abs(x - places[k])), []).append(text)
        line = [" ".join(cells.get(k, [])) for k in range(min(cells), max(cells) + 1)]
        wide += len(line) > 1
        lines.append(" | ".join(line))
    doubts = {"many_column_anchors": len(places) > MOST_COLUMNS, "few_rows": len(rows) < 2, "weak_column_alignment": wide < max(1, len(lines) // 3)}
    reasons = [k for k, v in doubts.items() if v]
    score = 0.35 + min(0.25, 0.04 * len(rows)) + min(0.25, 0.05 * wide) - (0.15 if reasons else 0.0)
    return "\n".join(lines), round(min(1.0, max(0.0, score)), 3), reasons


def table_grids(words: DataFrame, *by: str) -> DataFrame:
    """``by``, markdown, structure, reasons of each region of ``words`` (by, x, y, h, text).

    Rows and columns are found greedily, so a region is read whole by one task; it is a part of a page. Words with
    null places stand at 0. Regions of blank words alone give an empty text and the reason no_ocr_words.
    """
    ship_package(words.sparkSession)
    d = words.select(*by, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in "xyh"), F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    keys = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in by)

    def run(key: tuple, region: pd.DataFrame) -> pd.DataFrame:
        region = region.sort_values(["y", "x", "text"], kind="stable")
        return pd.DataFrame([(*key, *grid(list(region[["x", "y", "h", "text"]].itertuples(index=False, name=None))))])

    return d.groupBy(*by).applyInPandas(run, f"{keys}, markdown string, structure double, reasons array<string>")
