"""Model JSON, ids, joins and run reports on literal cases."""

import pytest
from pyspark.sql import functions as F

from docscope.functions import ids
from docscope.functions import model_json as J
from docscope.operators import joins, runs

EVAL = '{"visual_description":"d","component_evaluation":{%s},"relational_integrity":{%s}}' % (
    ",".join(f'"{s}":{{"verdict":"explicit","entity_coverage":[{{"entity":"e","verdict":"implied"}}]}}' for s in J.SECTIONS),
    ",".join(f'"{r}":{{"verdict":"traceable"}}' for r in J.RELATIONS),
)
CASES = {
    f"<think>x</think>```json\n{EVAL}\n```": ("raw", None),
    EVAL.replace('"implied"}]},"results"', '"maybe"}]},"results"'): ("raw", "component_evaluation[methods].entity_coverage[0].verdict invalid: maybe"),
    EVAL[:-1] + ",\n}": ("repaired", None),
    "none": ("failed", "eval root is not a JSON object"),
    "[1]": ("raw", "eval root is not a JSON object"),
    EVAL.replace('"e"', "3"): ("raw", "component_evaluation[introduction].entity_coverage[0].entity is not a string"),
    EVAL.replace('"methods"', '"method"'): ("raw", "component_evaluation missing section: methods"),
    EVAL.replace('"visual_description":"d",', ""): ("raw", "missing or non-string visual_description"),
}
SRP = (
    '{"doi":"d","title":"t","section_summaries":{"introduction":"a b","methods":"c","results":"d","Conclusion":"e f g"},"key_entities":'
    '{"introduction":[{"entity":"x","type":"y","visual_proxies":["p"]}],"methods":[],"results":[],"discussion":[{"entity":"x","type":"y"}]},'
    '"causal_relations":{"intro_to_methods":"a b"}}'
)


def test_evaluations(spark):
    df = J.parsed(spark.createDataFrame([(i, t) for i, t in enumerate([*CASES, None])], "i int, t string"), "t")
    got = df.orderBy("i").select("parse_mode", J.eval_problem(F.col("v"))).collect()
    assert [tuple(r) for r in got][:-1] == list(CASES.values()) and got[-1][0] == "failed"
    rows = [tuple(r) for r in J.eval_entities(df.where("i = 1"), "i").collect()]
    assert (1, "methods", 0, "e", None) in rows and len(rows) == 4


def test_profiles(spark):
    texts = [SRP, SRP.replace('"type":"y"', '"typ":"y"'), SRP.replace('"c"', "3")]
    got = J.parsed(spark.createDataFrame([(t,) for t in texts], "t string"), "t").select(J.profile_problem(F.col("v")).alias("p"), J.profile_metrics(F.col("v")).alias("m")).collect()
    assert [r.p for r in got] == [None, "key_entities[introduction][0] missing key: type", "section_summaries[methods] is not a string"]
    m = got[0].m
    assert (m.entity_count, m.total_visual_proxies, m.summary_words_discussion, m.summary_balance_std, m.causal_relations_present) == (2, 1, 3, 0.83, 1)
    assert (m.avg_visual_proxies_per_entity, m.causal_relation_avg_words, m.stage2_ready) == (0.5, 2.0, False)


def test_judgments(spark):
    text = '{"components_present":{"introduction":"yes","methods":1,"results":false,"discussion":true},"level":%s}'
    df = J.parsed(spark.createDataFrame([(text % x,) for x in ('"4"', "3", "3.0", "9", '"x"', "true")], "t string"), "t")
    got = [(r.x.level, r.x.corrected, r.x.coerced, r.x.problem) for r in df.select(J.judgment(F.col("v")).alias("x")).collect()]
    assert got == [
        (3, True, 3, None), (3, False, 2, None), (3, False, 3, None), (None, None, 2, "level out of range 0-4: 9"), (None, None, 2, "level is not an integer: x"),
        (None, None, 2, "level is not an integer: true"),
    ]
    one = spark.range(1).select(J.compact_sorted(F.expr("map('b','2','a','1')")), J.figure_paths(J.figure_map(F.lit('{"b":"2","a":"1","c":" "}'))), J.figure_map(F.lit("{")))
    assert one.first()[:2] == ('{"a":"1","b":"2"}', ["1", "2"])


def test_ids(spark):
    df = spark.createDataFrame([("https://doi.org/10.1/AB-c",), (" DOI: 10.2/x ",), ("",), (None,)], "d string")
    c = F.col("d")
    got = [tuple(r) for r in df.select(ids.norm_id(c), ids.safe_id(c), ids.file_id(c)).collect()]
    assert got[0] == ("10_1_ab_c", "https_doi_org_10_1_AB_c", "10_1_ab_c") and got[1] == ("10_2_x", "DOI_10_2_x", "10_2_x")
    assert got[2] == got[3] and got[2][2] == "missing_doi_da39a3ee5e6b"
    one = spark.range(1).select(
        ids.year_of(F.lit("2019-05")), ids.year_of(F.lit("abcd")), ids.year_of(F.lit("1850")), ids.level_of(F.lit("3.7")), ids.level_of(F.lit("x")), ids.level_of(F.lit("-0.5")),
        ids.image_type(F.lit("a.PNG")), ids.image_type(F.lit("a"), F.unhex(F.lit("FFD8FF00"))), ids.relation_score(F.lit(" Partially ")), ids.relation_score(F.lit("?")),
        ids.parse_flag(F.lit("False")), ids.parse_flag(F.lit(None).cast("string")), ids.half_even(F.lit(0.125), 2),
    ).first()
    assert tuple(one) == (2019, None, None, 3, None, 0, "image/png", "image/jpeg", 0.5, None, False, True, 0.12)


def test_joins(spark):
    a = spark.createDataFrame([("10.1/A", 2), ("10.1/a", 1), ("", 3)], "` doi_folder` string, level int")
    sheet = joins.sheets({"02 ratings": a, "01 Read me": a, "Instructions": a, "other": a.select("level")})
    assert sorted((r._id, r.level) for r in sheet.collect()) == [("10_1_a", 1), ("10_1_a", 2)]
    assert [(r._id, r.level) for r in joins.first_per_id(sheet, F.col("level")).collect()] == [("10_1_a", 1)]
    with pytest.raises(ValueError):
        joins.sheets({"x": a.select("level")})
    items = spark.createDataFrame([("a",), ("b",)], "_id string")
    work = joins.work_items(items, spark.createDataFrame([("a", "i.png")], "_id string, image string"), spark.createDataFrame([], "_id string, figures map<string,string>"))
    assert sorted((r._id, r.image, r.figures) for r in work.collect()) == [("a", "i.png", {}), ("b", "", {})]
    done = joins.completed(items, spark.createDataFrame([("a", "success", 5)], "_id string, status string, tokens int"), {"tokens": 0})
    assert sorted(tuple(r) for r in done.collect()) == [("a", "success", 5), ("b", "crash_error", 0)]
    files = spark.createDataFrame([("p", "tei"), ("p", "figures"), ("q", "tei"), ("q", "tei")], "doi_safe string, artifact string")
    assert [r[0] for r in joins.complete_papers(files, ["tei", "figures"]).collect()] == ["p"]
    best = spark.createDataFrame([("m", "srp", 0.5, 0.4), ("m", "srp", 0.6, 0.3), ("m", "baseline", 0.1, 0.2)], "model string, kind string, spearman double, qwk double")
    assert tuple(joins.best_by_model(best).first()) == ("m", 0.6, 0.4, 0.1, 0.2, 0.5, 0.2)


def test_runs(spark):
    rows = [("success", 2.0, 1.0, 10, 5, 3), ("success", 4.0, 0.0, 10, 5, 4), ("skipped", 0.0, 0.0, 0, 0, 0), ("timeout", 9.0, 0.0, 0, 0, 0)]
    schema = "status string, inference_time double, tokens_per_second double, input_tokens long, output_tokens long, component_count int"
    r = runs.run_report(spark.createDataFrame(rows, schema)).first()
    assert (r.selected, r.processed, r.success, r.failed, r.success_rate_processed, r.avg_time, r.median_time, r.avg_tokens_per_second) == (4, 3, 2, 1, 66.67, 3.0, 3.0, 1.0)
    assert (r.input_tokens, r.avg_components, r.error_breakdown) == (20, 3.5, {"timeout": 1})
    assert runs.run_report(spark.createDataFrame([], schema)).first().avg_time == 0.0
    tasks = spark.createDataFrame([(1, "in_progress", "w"), (2, "in_progress", "w"), (3, "done", "w")], "task_id int, state string, claimed_by string")
    got = runs.outcomes(tasks, spark.createDataFrame([(1, "failed", "e")], "task_id int, state string, error string"), "task_id")
    assert sorted((r.task_id, r.state, r.error) for r in got.collect()) == [(1, "failed", "e"), (2, "in_progress", None), (3, "done", None)]
    assert sorted((r.task_id, r.state, r.claimed_by) for r in runs.reset_orphans(tasks).collect()) == [(1, "pending", None), (2, "pending", None), (3, "done", "w")]
