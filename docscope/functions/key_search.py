"""Search for a key at any depth of JSON, which no built-in function does."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscope.plans.shipping import ship_package

from .headings import normal_text


def first_value(data: object, names: frozenset[str]) -> str:
    """The first value that is not blank under one of the lower-case names: those of an object before those within its values."""
    todo = [data]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            for key, value in node.items():
                shown = "" if value is None else str(value)
                if key.lower() in names and shown.strip():
                    return shown
            todo.extend(reversed(node.values()))
        elif isinstance(node, list):
            todo.extend(reversed(node))
    return ""


def with_found(df: DataFrame, text: str, out: str, *names: str) -> DataFrame:
    """``df`` with the text found under any of the names in its JSON, in Arrow batches; blank for null, bad JSON and no such key."""
    ship_package(df.sparkSession)
    wanted = frozenset(n.lower() for n in names)

    def one(t: str | None) -> str:
        try:
            return first_value(json.loads(t), wanted) if t else ""
        except (ValueError, RecursionError):
            return ""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    found: Column = run(F.col(text))
    return df.withColumn(out, normal_text(found))
