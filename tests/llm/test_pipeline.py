"""The pipeline: every stage keeps the columns, works on what its predecessor kept, and its decisions take effect."""

from pyspark.sql import functions as F

import corpus_pipeline
from docscope.llm.common import staged, table
from docscope.llm.decontamination import leaks
from docscope.llm.minhash import near_duplicates
from docscope.llm.quality import judge


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality_rules":
            want = {r.doc_id for r in judge(docs).where("kept").collect()}
        elif name == "near_dedup":
            want = {r.doc_id for r in near_duplicates(docs, words=5).where("kept").collect()}
        elif name == "decontamination":
            want = before - {r.doc_id for r in leaks(docs, table(spark, small, "benchmark")).collect()}
        else:
            want = before
        docs = staged(stage(spark, docs, small), "t")
        assert {r.doc_id for r in docs.select("doc_id").collect()} == want
        if name != "packing":
            assert docs.columns == columns
        kept.append(len(want))
    assert kept[0] >= kept[-1] > 0


def test_odd_documents(spark, small):
    """Null ids, repeated rows, null, empty and long texts, clashing columns and an empty table go through every stage."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
    rows = [(None, long, "en"), (None, long, "en"), (1, long, "en"), (1, long, "en"), (2, None, None), (3, "", "en"), (None, None, None)]
    full = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("n_lines", "spans", "kept", "item_id", "component_id", "n_shingles"):
        full = full.withColumn(c, F.lit("clash"))
    for docs in (full, full.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs.where("doc_id is null").count()
            out = staged(stage(spark, docs, small), "t")
            assert out.columns == docs.columns and out.where("doc_id is null").count() == before
            assert out.where("n_lines = 'clash' and kept = 'clash'").count() == out.count() <= n
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).select("doc_id").distinct().count() == min(n, 2)
