"""Documents, prompts and lists as they are written, and providers with a fake in place of a service."""

import json

import pytest
from pyspark.sql import functions as F

from docscope import providers
from docscope.sources import files, sinks

SECTIONS = "doc_id long, ord int, heading string, text string, imrad string"


def test_documents(spark, tmp_path):
    sections = spark.createDataFrame([(1, 0, "Intro", "a", "introduction"), (1, 1, "", "b", None), (1, 2, "Empty", " ", "results")], SECTIONS)
    refs = spark.createDataFrame([(1, 1, "Two"), (1, 0, "One")], "doc_id long, i int, citation string")
    assert tuple(sinks.fulltext(sections, refs).first()) == (1, 3, "Intro", "## Intro\n\na\n\nb\n\n## References\n\n[1] One\n[2] Two")
    document = json.loads(sinks.imrad_documents(sections).first().document)
    assert document == {"sections": [{"ord": 0, "heading": "Intro", "imrad": "introduction", "text": "a"}]}
    path = f"file://{tmp_path}/out"
    for text in ("old", "new"):
        sinks.write_artifacts({"fulltext": spark.createDataFrame([(text,)], "t string")}, path)
    assert [r.t for r in spark.read.parquet(f"{path}/fulltext").collect()] == ["new"]
    broken = spark.range(1).select(F.raise_error(F.lit("stop")).cast("string").alias("t"))
    with pytest.raises(Exception, match="stop"):
        sinks.commit(broken, f"{path}/fulltext")
    assert [r.t for r in spark.read.parquet(f"{path}/fulltext").collect()] == ["new"] and not (tmp_path / "out/fulltext.tmp").exists()
    for _ in range(2):
        files.append_json_lines(spark.createDataFrame([(1,)], "k int"), f"{path}/lines")
    assert spark.read.json(f"{path}/lines").count() == 2


def test_lists(spark, tmp_path):
    rows = [("/b", "P", "done", "done", True, ["m", "r"], None), ("/a", "P", "failed", "failed", None, None, "x\ny" + "z" * 600)]
    tasks = spark.createDataFrame(rows, "pdf_path string, publisher string, state string, status string, imrad_complete boolean, imrad_found array<string>, error string")
    tasks = tasks.withColumn("stage_failed", F.lit(None).cast("string"))
    got = sinks.master(tasks).collect()
    assert [r.pdf_path for r in got] == ["/a", "/b"] and got[0].error.startswith("x yz") and len(got[0].error) == 500
    assert (got[1].imrad_complete, got[1].imrad_found, got[1].n_figures, got[1].journal) == ("1", "m|r", 0, "")
    sinks.write_master(tasks, f"file://{tmp_path}/master")
    assert spark.read.csv(f"file://{tmp_path}/master.csv", header=True).columns == sinks.MASTER
    block = sinks.stats_block(tasks).split("\n")
    assert block[:4] == ["Total in queue: 2", "Processed: 2 (100.00%)", "Remaining: 0", "Success: 1"] and block[-1] == "_unspecified: 1"


def test_prompt_blocks(spark, tmp_path):
    papers = spark.createDataFrame([(1,), (2,)], "doc_id long")
    rows = [(1, i, f"fig_{i:02d}", "Results and discussion", "c", f"Figure {i}", "figure", False, ["/x", f"/{i}.png"]) for i in range(1, 15)]
    rows += [(1, 20, "fig_20", "nowhere", "c", "l", "figure", False, ["/1.png"]), (2, 1, "fig_01", "results", "c", "l", "table", False, ["/1.png"])]
    f = spark.createDataFrame(rows, "doc_id long, n int, figure_id string, assigned_section string, caption string, label string, type string, is_supplementary boolean, candidates array<string>")
    paths = sinks.resolved_images(f, spark.createDataFrame([(f"/{i}.png",) for i in range(1, 15)], "path string"))
    got = {r.doc_id: r for r in sinks.figures_block(f.join(paths, ["doc_id", "n"], "left"), papers).collect()}
    assert got[1].used == 12 and got[1].block.startswith("[Figure 1]\nfigure_id: fig_01\nlabel: Figure 1\nassigned_section: results\ncaption: c\n") and got[1].paths["fig_03"] == "/3.png"
    assert (got[2].used, got[2].block) == (0, sinks.NO_FIGURES)
    t = spark.createDataFrame([(1, 1, "table01", "methods", "cap", "Table 1", False, "x" * 7000)], "doc_id long, n int, table_id string, section string, caption string, label string, is_supplementary boolean, content string")
    got = {r.doc_id: r for r in sinks.tables_block(t, papers).collect()}
    assert got[1].block.endswith("x" * 6000 + "...") and got[2].block == sinks.NO_TABLES
    built = spark.createDataFrame([(1, "valid", "text"), (2, "missing_doi", None)], "doc_id long, status string, prompt string")
    sinks.write_prompts(built, f"file://{tmp_path}/p")
    assert spark.read.json(f"file://{tmp_path}/p/prompts").count() == 1 and spark.read.csv(f"file://{tmp_path}/p/skipped", header=True).first().reason == "missing_doi"


def test_providers(spark):
    def fake(row):
        if row["k"] == 2:
            raise ValueError("no")
        return {"text": row["t"].upper()}

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, t string")
    got = providers.called(df, fake, "k", "text string, pages int").collect()
    assert sorted(tuple(r) for r in got) == [(1, "success", None, "A", None), (2, "crash_error", "ValueError: no", None, None), (3, "success", None, "C", None)]
    assert providers.tei_problem(200, b"<TEI" + b" " * 600) is None and providers.tei_problem(503, b"") == "HTTP 503" and "short" in providers.tei_problem(200, b"<TEI")
    asked = []

    def model(messages, tokens):
        asked.append(tokens)
        if tokens > 500:
            raise RuntimeError("This prompt has 600 input tokens")
        return "ok"

    assert providers.fitted(model, 1000)([], 900) == "ok" and asked == [900, 336]

    def crowded(figures):
        if len(figures) > 1:
            raise RuntimeError("maximum context length")
        return f"{len(figures)} figures"

    assert providers.shedding(crowded, [{}, {}, {}]) == ("1 figures", 1)
    answers = iter(["bad", "good"])
    again = providers.asked_again(lambda m: next(answers), [], lambda a: None if a == "good" else "it is bad", "Mend: {problem}")
    assert again == ("good", True)
    content = providers.user_content("t", [{"f": 1}], {"i": 1})
    assert [m["role"] for m in providers.messages("s", content)] == ["system", "user"] and len(providers.messages("s", content, True)[0]["content"]) == 5
