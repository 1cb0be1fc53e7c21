"""TEI papers to rows: the XML is read in Arrow batches, labels are carried over sections by a window."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docscope.functions import headings as H
from docscope.plans.shipping import ship_package

SECTION = pa.struct({"ord": pa.int32(), "depth": pa.int32(), "heading": pa.string(), "page": pa.int32(), "text": pa.string()})
FIGURE = pa.struct({"label": pa.string(), "caption": pa.string(), "page": pa.int32(), "coords": pa.string()})
EQUATION = pa.struct({"ord": pa.int32(), "id": pa.int32(), "raw": pa.string(), "coords": pa.string()})
TABLE = pa.struct({"ord": pa.int32(), "table_id": pa.string(), "cells": pa.list_(pa.list_(pa.string()))})
REFERENCE = pa.struct({"authors": pa.list_(pa.string()), "title": pa.string(), "year": pa.string()})
COLUMNS = {
    "parse_ok": pa.bool_(), "title": pa.string(), "abstract": pa.string(), "sections": pa.list_(SECTION), "figures": pa.list_(FIGURE),
    "equations": pa.list_(EQUATION), "tables": pa.list_(TABLE), "bibliography": pa.list_(REFERENCE),
}
DDL = (
    "doc_id long, parse_ok boolean, title string, abstract string, "
    "sections array<struct<ord int, depth int, heading string, page int, text string>>, "
    "figures array<struct<label string, caption string, page int, coords string>>, "
    "equations array<struct<ord int, id int, raw string, coords string>>, "
    "tables array<struct<ord int, table_id string, cells array<array<string>>>>, "
    "bibliography array<struct<authors array<string>, title string, year string>>"
)


def _text(e: ET.Element | None) -> str:
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def _page(*elements: ET.Element | None) -> int | None:
    """The page of the first element with coordinates (page,x,y,w,h;...)."""
    for e in elements:
        first = (e.get("coords") or "").split(",")[0].strip() if e is not None else ""
        if first.isdigit():
            return int(first)
    return None


def read_paper(xml: str) -> dict:
    """One paper; raises ``ET.ParseError`` for XML that is not well formed."""
    root = ET.fromstring(xml)
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else "comment"
    titles = root.findall(".//teiHeader//titleStmt/title")
    title = next((t for t in titles if t.get("type") == "main"), titles[0] if titles else None)
    paper = {"parse_ok": True, "title": _text(title), "sections": [], "equations": [], "tables": []}
    paper["abstract"] = "\n\n".join(filter(None, map(_text, root.findall(".//profileDesc/abstract//p"))))
    stack = [(d, 0) for d in reversed(root.findall(".//text/body/div"))]
    while stack:
        div, depth = stack.pop()
        stack += [(d, depth + 1) for d in reversed(div.findall("div"))]
        order, parts, head = len(paper["sections"]), [], div.find("head")
        for child in div:
            if child.tag == "formula":
                paper["equations"].append({"ord": order, "id": len(paper["equations"]) + 1, "raw": _text(child), "coords": child.get("coords")})
                parts.append(f"[[EQN:{len(paper['equations'])}]]")
            elif child.tag == "table":
                name = f"table{len(paper['tables']) + 1:02d}"
                paper["tables"].append({"ord": order, "table_id": name, "cells": [[_text(c) for c in r.findall("cell")] for r in child.iter("row")]})
                parts.append(f"[{name} here]")
            elif child.tag not in ("head", "div", "comment"):
                parts.append(_text(child))
        text = "\n\n".join(filter(None, parts))
        if text or _text(head):
            around = [x for c in div for x in (c, c.find("graphic"))]
            paper["sections"].append({"ord": order, "depth": depth, "heading": _text(head), "page": _page(head, *around), "text": text})
    paper["figures"] = [
        {
            "label": _text(f.find("head")) or _text(f.find("label")), "caption": _text(f.find("figDesc")), "page": _page(f.find("graphic")),
            "coords": None if f.find("graphic") is None else f.find("graphic").get("coords"),
        }
        for f in root.iter("figure")
    ]
    books = root.findall(".//back//listBibl/biblStruct") or root.findall(".//listBibl/biblStruct")
    paper["bibliography"] = [
        {
            "authors": [" ".join(filter(None, map(_text, a.iter("forename")))) + " " + _text(a.find(".//surname")) for a in b.iter("author")],
            "title": _text(b.find(".//title")), "year": next((d.get("when", "")[:4] for d in b.iter("date")), None),
        }
        for b in books
    ]
    return paper


def parse_tei(papers: DataFrame) -> DataFrame:
    """One row a paper of (doc_id, xml). Null, empty or malformed XML gives parse_ok false and nulls."""
    ship_package(papers.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for xml in b.column(1):
                try:
                    rows.append(read_paper(xml.as_py() or ""))
                except ET.ParseError:
                    rows.append({"parse_ok": False})
            got = [pa.array([r.get(n) for r in rows], t) for n, t in COLUMNS.items()]
            yield pa.RecordBatch.from_arrays([b.column(0), *got], names=["doc_id", *COLUMNS])

    return papers.select(F.col("doc_id").cast("long"), "xml").mapInArrow(run, DDL)


def tei_sections(parsed: DataFrame) -> DataFrame:
    """doc_id, ord, heading, page, text, imrad: methods, results and discussion carry on; back matter ends the carry."""
    s = parsed.select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.*")
    s = s.withColumn("own", H.classify(F.col("heading"))["label"]).withColumn("outside", H.is_outside(F.col("heading")))
    event = F.when(F.col("outside") | (F.col("own") == "introduction"), "").otherwise(F.col("own"))
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.nullif(F.last(event, ignorenulls=True).over(w), F.lit(""))
    return s.select("doc_id", "ord", "heading", "page", "text", F.coalesce("own", carried).alias("imrad"))
