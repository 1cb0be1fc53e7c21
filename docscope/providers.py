"""Calls that leave the process (parsers, OCR, models) as one interface: a function from a row to a result, in Arrow batches.

A provider is any picklable function from a dict to a dict. Rows are given to a bounded number of threads in each task, a
provider that raises gives a row with its error, and every input row has one result row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docscope.plans.shipping import ship_package

Provider = Callable[[dict], dict]
LEAST_TEI, SPARE_TOKENS, LEAST_TOKENS = 500, 64, 256


def called(df: DataFrame, provider: Provider, key: str, out: str, at_once: int = 4) -> DataFrame:
    """key, status (success or crash_error), error and the columns of ``out`` (DDL) for every row of ``df``.

    ``at_once`` threads call the provider; results come in the order of their rows. What the provider leaves out is null.
    """
    ship_package(df.sparkSession)
    kind = dict(df.dtypes)[key]
    schema = StructType.fromDDL(f"{key} {kind}, status string, error string, {out}")
    arrow = to_arrow_schema(schema)

    def one(row: dict) -> dict:
        try:
            return {"status": "success", "error": None, **provider(row), key: row[key]}
        except Exception as e:  # noqa: BLE001: whatever a provider raises is a result
            return {"status": "crash_error", "error": f"{type(e).__name__}: {e}"[:500], key: row[key]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                rows = list(pool.map(one, b.to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def tei_problem(status: int, content: bytes) -> str | None:
    """Why a parser's answer is no TEI paper; None if it is one."""
    if status != 200:
        return f"HTTP {status}"
    if len(content) < LEAST_TEI:
        return f"suspiciously short response ({len(content)} bytes)"
    return None if b"<TEI" in content[:500] else "no <TEI> root"


def input_tokens(error: str | None) -> int | None:
    """The number of input tokens that a model's error names."""
    found = re.search(r"has (\d+) input tokens", error or "")
    return int(found[1]) if found else None


def is_overflow(error: str | None) -> bool:
    low = (error or "").lower()
    return "maximum context length" in low or "longer than the maximum model length" in low or input_tokens(error) is not None


def fitted(complete: Callable[..., str], context: int) -> Callable[..., str]:
    """``complete(messages, max_tokens)`` that is asked again once with as many tokens as the context leaves."""

    def run(messages: list[dict], max_tokens: int) -> str:
        try:
            return complete(messages, max_tokens)
        except Exception as e:
            n = input_tokens(str(e))
            fewer = None if n is None else max(LEAST_TOKENS, context - n - SPARE_TOKENS)
            if fewer is None or fewer >= max_tokens:
                raise
            return complete(messages, fewer)

    return run


def shedding(complete: Callable[[list[dict]], str], figures: list[dict]) -> tuple[str, int]:
    """The answer with as many figures as fit, and their number: the last one goes at each overflow."""
    for n in range(len(figures), -1, -1):
        try:
            return complete(figures[:n]), n
        except Exception as e:
            if not is_overflow(str(e)) or n == 0:
                raise
    raise AssertionError


def asked_again(complete: Callable[[list[dict]], str], messages: list[dict], problem_of: Callable[[str], str | None], instruction: str) -> tuple[str, bool]:
    """An answer, and whether it was asked for again: once, with the first answer's problem told."""
    first = complete(messages)
    problem = problem_of(first)
    if problem is None:
        return first, False
    more = [*messages, {"role": "assistant", "content": first}, {"role": "user", "content": instruction.format(problem=problem)}]
    second = complete(more)
    return (second, True) if second.strip() else (first, True)


def user_content(text: str, figures: list[dict], image: dict, lead: str = "Graphical abstract image:") -> list[dict]:
    return [{"type": "text", "text": text}, *figures, {"type": "text", "text": lead}, image]


def messages(system: str, content: list[dict], merged: bool = False) -> list[dict]:
    """System and user message; ``merged``: for models without a system role, the system text leads the user's."""
    if merged:
        return [{"role": "user", "content": [{"type": "text", "text": system}, *content]}]
    return [{"role": "system", "content": system}, {"role": "user", "content": content}]


def with_defaults(results: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """One row for each item, crash_error where the run gave none."""
    return items.select(key).join(results, key, "left").withColumn("status", F.coalesce("status", F.lit("crash_error")))
