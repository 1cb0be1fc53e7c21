"""What is written for papers and runs: documents, prompts, the master list, log lines and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docscope.functions.headings import LABELS, inline, normal_text
from docscope.functions.headings import builder_category, builder_label
from docscope.operators.imrad import kept_sections

from .files import write_csv

#: Columns of the master list, in order.
MASTER = (
    "pdf_path publisher journal doi status imrad_complete imrad_found n_figures n_schemes n_references n_fallback elapsed_seconds "
    "stage_failed error claimed_by claimed_at finished_at"
).split()
LOG_COUNTS = {
    "figs": "n_figures", "schemes": "n_schemes", "tbl": "n_tables", "tbl_ocr": "tables_ocr", "tbl_unrec": "tables_unrecovered",
    "eq_ocr": "equations_ocr", "cap_rm": "captions_removed_from_body", "refs": "n_references",
}
#: Caps of what a prompt shows: figures, tables, and characters of a caption and of a table.
MOST_FIGURES, MOST_TABLES, CAPTION_CHARS, TABLE_CHARS = 12, 8, 2500, 6000
NO_FIGURES = "No usable main-paper figures were extracted for this paper."
NO_TABLES = "No usable main-paper tables were extracted for this paper."


def commit(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Replaces a dataset as a whole: it is written beside the old one, which goes only when the new one is complete."""
    spark = df.sparkSession
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.tmp", path))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.mode("overwrite").format(form).save(f"{path}.tmp")
        fs.delete(old, True)
        if not fs.rename(new, old):
            raise OSError(f"{path}.tmp could not be renamed")
    finally:
        fs.delete(new, True)


def write_artifacts(frames: dict[str, DataFrame], root: str) -> None:
    """One dataset for each artifact of the papers (fulltext, tables, equations, ...)."""
    for name, df in frames.items():
        commit(df, f"{root}/{name}")


def fulltext(sections: DataFrame, references: DataFrame) -> DataFrame:
    """doc_id, n_sections, first_heading, full_text: sections with text under their headings, references numbered at the end."""
    body = kept_sections(sections).select("doc_id", "ord", F.coalesce("heading", F.lit("")).alias("heading"), "text")
    line = F.concat(F.lit("["), (F.col("i") + 1).cast("string"), F.lit("] "), F.col("citation"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("l")))), lambda x: x["l"])
    refs = references.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("text"))
    last = refs.select("doc_id", F.lit(2**31 - 1).alias("ord"), F.lit("References").alias("heading"), "text")
    part = F.when(F.col("heading") != "", F.concat(F.lit("## "), F.col("heading"), F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("ord", part.alias("p"), "heading")))
    d = body.unionByName(last).groupBy("doc_id").agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["p"]), "\n\n")
    return d.select("doc_id", F.size("parts").alias("n_sections"), F.get("parts", F.lit(0))["heading"].alias("first_heading"), text.alias("full_text"))


def imrad_documents(sections: DataFrame) -> DataFrame:
    """doc_id, document: the labelled sections of a paper as one JSON object; papers without any have none."""
    one = F.struct("ord", "heading", "imrad", "text")
    return kept_sections(sections, True).groupBy("doc_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("sections"))).alias("document"))


def _has(df: DataFrame, name: str, other: object) -> F.Column:
    return F.coalesce(F.col(name), F.lit(other)) if name in df.columns else F.lit(other)


def master(tasks: DataFrame) -> DataFrame:
    """All tasks in the columns of the master list by publisher, journal and path: blanks for what is missing, flags as 1 and 0."""
    found = F.array_join("imrad_found", "|") if "imrad_found" in tasks.columns else F.lit("")
    values = {c: _has(tasks, c, "").cast("string") for c in MASTER} | {c: _has(tasks, c, 0) for c in MASTER if c.startswith("n_")}
    values["elapsed_seconds"] = _has(tasks, "elapsed_seconds", 0.0)
    values["imrad_complete"] = F.when(_has(tasks, "imrad_complete", False), "1").otherwise("0")
    values["imrad_found"] = F.coalesce(found, F.lit(""))
    values["error"] = F.substring(F.regexp_replace(_has(tasks, "error", ""), "\n", " "), 1, 500)
    return tasks.select(*(v.alias(c) for c, v in values.items())).orderBy("publisher", "journal", "pdf_path")


def write_master(tasks: DataFrame, path: str) -> None:
    """The master list as JSON lines and as CSV."""
    rows = master(tasks)
    rows.write.mode("overwrite").json(f"{path}.json")
    write_csv(rows, f"{path}.csv", MASTER)


def log_lines(results: DataFrame, at: F.Column, worker: F.Column) -> DataFrame:
    """line: one tab-separated line for each result, its error on one line of 300 characters at most."""
    count = lambda c: _has(results, c, 0).cast("string")
    error = F.substring(F.regexp_replace(_has(results, "error", ""), "[\n\t]", " "), 1, 300)
    parts = [
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), worker, _has(results, "status", "?"), _has(results, "pdf_path", ""),
        F.format_string("%.2f", _has(results, "elapsed_seconds", 0.0).cast("double")),
        F.when(_has(results, "imrad_complete", False), "imrad_ok").otherwise("imrad_partial"),
        F.when(_has(results, "methods_inferred", False), "methods_inferred").otherwise("methods_direct"),
        (_has(results, "n_figures", 0) + _has(results, "n_schemes", 0)).cast("string"),
        *(F.concat(F.lit(f"{k}="), count(c)) for k, c in LOG_COUNTS.items()), _has(results, "stage_failed", ""), error,
    ]
    return results.select(F.concat_ws("\t", *parts).alias("line"))


def stats_block(tasks: DataFrame) -> str:
    """A text of the queue's counts, outcomes and failures by stage; of the tasks only these counts reach the driver."""
    state = lambda s: F.count_if(F.col("state") == s).alias(s)
    complete = F.count_if((F.col("state") == "done") & _has(tasks, "imrad_complete", False)).alias("complete")
    n = tasks.agg(F.count("*").alias("total"), *map(state, ("pending", "in_progress", "done", "failed")), complete).first()
    stage = F.coalesce(F.nullif("stage_failed", F.lit("")), F.lit("_unspecified")).alias("stage")
    failures = tasks.where("state = 'failed'").groupBy(stage).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stage").collect()
    processed = n.done + n.failed
    share = lambda a, b: 100.0 * a / b if b else 0.0
    lines = [
        f"Total in queue: {n.total}", f"Processed: {processed} ({share(processed, n.total):.2f}%)", f"Remaining: {n.pending + n.in_progress}",
        f"Success: {n.done}", f"Failed: {n.failed}", f"In progress: {n.in_progress}",
    ]
    if n.done:
        lines += [f"Full IMRaD: {n.complete} ({share(n.complete, n.done):.2f}%)", f"Partial IMRaD: {n.done - n.complete}"]
    return "\n".join([*lines, *(f"{r.stage}: {r.n}" for r in failures)])


def write_prompts(built: DataFrame, path: str) -> None:
    """Prompts, an index of those built, the skipped papers with their reasons, and counts by status."""
    built.where("status = 'valid'").select("doc_id", "prompt").write.mode("overwrite").json(f"{path}/prompts")
    write_csv(built.where("status = 'valid'").withColumn("chars", F.length("prompt")), f"{path}/index", ["doc_id", "chars"])
    write_csv(built.where("status <> 'valid'").withColumnRenamed("status", "reason"), f"{path}/skipped", ["doc_id", "reason"])
    built.groupBy("status").agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{path}/summary")


def section_name(value: F.Column) -> F.Column:
    """One of the four labels for an assigned section, by its name or as a heading; null for none."""
    kind = builder_category(value)
    return F.coalesce(builder_label(value), F.when(kind == "results_discussion", "results").when(kind.isin(*LABELS), kind))


def shortened(text: F.Column, chars: int) -> F.Column:
    t = normal_text(text)
    return F.when(F.length(t) > chars, F.concat(F.rtrim(F.substring(t, 1, chars)), F.lit("..."))).otherwise(t)


def resolved_images(figures: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, n, path: the first of a figure's places (candidates: array of paths) where a file is."""
    places = figures.select("doc_id", "n", F.posexplode("candidates").alias("at", "path"))
    return places.join(files.select("path").distinct(), "path").groupBy("doc_id", "n").agg(F.min_by("path", "at").alias("path"))


def _blocks(rows: DataFrame, block: F.Column, most: int, none: str, papers: DataFrame, *more: F.Column) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("n")
    d = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("r", block.alias("b")))), lambda x: x["b"])
    d = d.groupBy("doc_id").agg(F.array_join(texts, "\n\n").alias("block"), F.count("*").alias("used"), *more)
    return papers.join(d, "doc_id", "left").withColumns({"block": F.coalesce("block", F.lit(none)), "used": F.coalesce("used", F.lit(0))})


def figures_block(figures: DataFrame, papers: DataFrame) -> DataFrame:
    """doc_id, block, used, paths: the figures that a paper's prompt shows, twelve at most.

    Shown are figures with an image (path), of the main paper, no tables, with a section and a caption or label.
    """
    keep = F.col("path").isNotNull() & ~F.coalesce("is_supplementary", F.lit(False)) & (F.coalesce("type", F.lit("figure")) != "table")
    d = figures.withColumn("section", section_name(F.col("assigned_section"))).where(keep & F.col("section").isNotNull())
    d = d.where((inline(F.col("caption")) != "") | (inline(F.col("label")) != ""))
    name = F.coalesce(F.nullif(inline(F.col("figure_id")), F.lit("")), F.concat(F.lit("fig_"), F.lpad(F.col("r").cast("string"), 2, "0")))
    label = F.coalesce(F.nullif(inline(F.col("label")), F.lit("")), name)
    text = F.concat(
        F.lit("[Figure "), F.col("r").cast("string"), F.lit("]\nfigure_id: "), name, F.lit("\nlabel: "), label, F.lit("\nassigned_section: "), F.col("section"),
        F.lit("\ncaption: "), shortened(F.col("caption"), CAPTION_CHARS), F.lit("\nimage_input_id: "), name,
    )
    return _blocks(d, text, MOST_FIGURES, NO_FIGURES, papers, F.map_from_entries(F.collect_list(F.struct(name, F.col("path")))).alias("paths"))


def tables_block(tables: DataFrame, papers: DataFrame) -> DataFrame:
    """doc_id, block, used: the tables that a paper's prompt shows, eight at most, with a section and a caption or text."""
    d = tables.withColumn("section", section_name(F.col("section"))).where(F.col("section").isNotNull() & ~F.coalesce("is_supplementary", F.lit(False)))
    d = d.where((inline(F.col("caption")) != "") | (normal_text(F.col("content")) != ""))
    name = F.coalesce(F.nullif(inline(F.col("table_id")), F.lit("")), F.concat(F.lit("table_"), F.lpad(F.col("r").cast("string"), 2, "0")))
    text = F.concat(
        F.lit("[Table "), F.col("r").cast("string"), F.lit("]\ntable_id: "), name, F.lit("\nlabel: "), F.coalesce(F.nullif(inline(F.col("label")), F.lit("")), name),
        F.lit("\nassigned_section: "), F.col("section"), F.lit("\ncaption: "), shortened(F.col("caption"), CAPTION_CHARS), F.lit("\ncontent:\n"),
        shortened(F.col("content"), TABLE_CHARS),
    )
    return _blocks(d, text, MOST_TABLES, NO_TABLES, papers)
