"""Queries over model JSON, ids, joins, mentions, tables, equations and runs, and their SQL for the checks.

The JSON is made from the views, in the spellings that models use; the SQL says what must come out and reads none of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.functions import equations as E
from docscope.functions import headings as H
from docscope.functions import ids
from docscope.functions import model_json as J
from docscope.operators import joins, mentions, runs, scoring, tables
from docscope.sources import sinks

from . import views as V


def _by_name(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col(name), value.alias("v")))).alias("m"))


def evals(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, t: an evaluation as a model writes it: bare, fenced after thoughts, with a comma too many, within prose, or cut off."""
    covered = V.entities(spark, d).groupBy("doc_id", "section").agg(F.sort_array(F.collect_list(F.struct("k", "verdict"))).alias("e"))
    covered = covered.join(V.section_verdicts(spark, d), ["doc_id", "section"])
    entity = F.transform("e", lambda x: F.struct(F.concat(F.lit("e"), x["k"].cast("string")).alias("entity"), x["verdict"].alias("verdict")))
    parts = _by_name(covered, "section", F.struct("verdict", entity.alias("entity_coverage"))).withColumnRenamed("m", "component_evaluation")
    links = _by_name(V.relations(spark, d), "relation", F.struct("verdict")).withColumnRenamed("m", "relational_integrity")
    one = F.to_json(F.struct(F.lit("seen").alias("visual_description"), "component_evaluation", "relational_integrity"))
    j, way = F.col("j"), F.col("doc_id") % 5
    text = (
        F.when(way == 0, j).when(way == 1, F.concat(F.lit("<think>hm {</think>\n```json\n"), j, F.lit("\n```")))
        .when(way == 2, F.concat(j.substr(F.lit(1), F.length(j) - 1), F.lit(",\n}"))).when(way == 3, F.concat(F.lit("Here it is: "), j, F.lit(" done")))
        .otherwise(j.substr(F.lit(1), F.length(j) - 3))
    )
    return parts.join(links, "doc_id").select("doc_id", one.alias("j")).select("doc_id", text.alias("t"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return J.parsed(evals(spark, d), "t")


def _eval_check(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("doc_id", "parse_mode", J.eval_problem(F.col("v")).alias("problem"))


def _eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = _parsed(spark, d).where("v is not null").select("doc_id", J.eval_metrics(F.col("v")).alias("m"))
    return m.select("doc_id", "m.n_entities_methods", "m.n_explicit_total", "m.n_implied_total", "m.n_absent_total", "m.component_count_observed")


def _evals_scored(spark: SparkSession, d: str) -> DataFrame:
    p = _parsed(spark, d).where("v is not null")
    return scoring.score_eval(J.eval_entities(p, "doc_id"), J.eval_verdicts(p, "doc_id"), J.eval_relations(p, "doc_id"))


def _judgments(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    yes = lambda k: F.shiftright(i, k) % 2 == 1
    spelled = lambda k: F.when(i % 3 == 0, F.when(yes(k), "true").otherwise("false")).when(i % 3 == 1, F.when(yes(k), '"Present"').otherwise('"no"')).otherwise(F.when(yes(k), "1").otherwise("0"))
    parts = F.concat_ws(",", *(F.concat(F.lit(f'"{s}":'), spelled(k)) for k, s in enumerate(J.SECTIONS)))
    level = F.when(i % 2 == 0, (i % 6).cast("string")).otherwise(F.concat(F.lit('"'), (i % 6).cast("string"), F.lit('"')))
    text = F.concat(F.lit('{"components_present":{'), parts, F.lit('},"level":'), level, F.lit("}"))
    p = J.parsed(V.table(spark, d, "documents").select("doc_id", text.alias("t")), "t").select("doc_id", J.judgment(F.col("v")).alias("x"))
    return p.select("doc_id", "x.level", "x.reported", "x.corrected", "x.coerced", "x.problem")


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    words = lambda k: F.array_join(F.array_repeat(F.lit("w"), ((i + k) % 4).cast("int")), " ")
    last = F.when(i % 2 == 0, "discussion").otherwise(" Conclusions")
    summaries = [F.concat(F.lit(f'"{s}":"'), words(k), F.lit('"')) for k, s in enumerate(J.SECTIONS[:3])]
    summaries.append(F.concat(F.lit('"'), last, F.lit('":"'), words(3), F.lit('"')))
    proxies = F.when(i % 3 == 0, ',"visual_proxies":["p"]').when(i % 3 == 1, ',"visual_proxies":[]').otherwise("")
    entity = F.concat(F.lit('{"entity":"e","type":"t"'), proxies, F.lit("}"))
    entities = F.concat_ws(",", *(F.concat(F.lit(f'"{s}":['), F.array_join(F.array_repeat(entity, ((i + k) % 3).cast("int")), ","), F.lit("]")) for k, s in enumerate(J.SECTIONS)))
    text = F.concat(F.lit('{"doi":"d","title":"t","section_summaries":{'), F.concat_ws(",", *summaries), F.lit('},"key_entities":{'), entities, F.lit("}}"))
    p = J.parsed(V.table(spark, d, "documents").select("doc_id", text.alias("t")), "t")
    p = p.select("doc_id", J.profile_problem(F.col("v"), True).alias("problem"), J.profile_metrics(F.col("v")).alias("m"))
    return p.select("doc_id", "problem", "m.entity_count", "m.total_visual_proxies", "m.entities_with_no_proxies", "m.summary_words_discussion", "m.stage2_ready")


def _ids(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    doi = F.concat(V.pick(("https://doi.org/", "DOI:", "", " "), i % 4), F.lit("10."), i, F.lit("/J.X-"), F.col("source"))
    folder = F.concat(F.lit("10_"), i, F.lit("_j_x_"), F.col("source"))
    return V.table(spark, d, "documents").select(
        "doc_id", ids.norm_id(doi).alias("norm"), ids.safe_id(doi).alias("safe"), ids.folder_doi(folder).alias("folder"), ids.folder_doi(folder, False).alias("slashed"),
        ids.year_of(F.concat((1890 + i % 250).cast("string"), F.lit("-01"))).alias("year"), ids.level_of(F.concat((i % 5).cast("string"), F.lit(".9"))).alias("level"),
    )


def _rated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two annotators' and a model's levels under differently spelled ids; the second annotator rated some papers twice."""
    v, i = V.levels(spark, d), F.col("doc_id")
    one = joins.keyed(v.select(F.concat(F.lit("https://doi.org/10."), i).alias("x"), F.col("a").alias("level")), "x").drop("x")
    two = v.where("b is not null").select(F.concat(F.lit("DOI:10."), i).alias("x"), F.explode(F.array("b", F.when(i % 4 == 0, F.col("b") + 1).otherwise(F.col("b")))).alias("level"))
    two = joins.first_per_id(joins.keyed(two, "x").drop("x"), F.col("level"))
    model = joins.keyed(v.where(i % 3 != 0).select(F.concat(F.lit("10_"), i).alias("x"), F.col("c").alias("level")), "x").drop("x")
    return one, two, model


def _three_way(spark: SparkSession, d: str) -> DataFrame:
    one, two, model = _rated(spark, d)
    return joins.three_way(model, one, two).select(joins.KEY, "level_1", "level_2", "level").withColumnRenamed(joins.KEY, "id")


def _meta(spark: SparkSession, d: str) -> DataFrame:
    one, _, model = _rated(spark, d)
    i = F.col("doc_id")
    index = V.table(spark, d, "documents").where(i % 5 != 0).select(
        F.concat(F.lit("10."), i).alias("paper_id"), F.concat(F.when(i % 7 != 0, (2000 + i % 25).cast("string")).otherwise("n/a"), F.lit("-06")).alias("Pub_Year"),
        F.when(i % 10 != 1, F.col("source")).alias("Field"),
    )
    meta = joins.index_meta(index, "paper_id", ("year", "pub_year"), ("domain", "field"))
    pairs = joins.aligned(one, model)
    named = joins.with_domain(pairs, meta).join(joins.with_year(pairs, meta).select(joins.KEY, "year"), joins.KEY, "left")
    return named.select(F.col(joins.KEY).alias("id"), "level_a", "level_b", "domain", "year")


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    a = (1 + i % 9).cast("string")
    b = (2 + i % 9 + i % 3).cast("string")
    text = F.concat(F.lit("As Fig. "), a, F.lit(" shows, Figs. "), a, F.lit("-"), b, F.lit(" and Tables 1, 2 and 4 agree."))
    df = V.table(spark, d, "documents").select("doc_id", F.lit(0).alias("ord"), text.alias("text"))
    return mentions.mention_counts(df).select("doc_id", "key", "n")


def _table_numbers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.concat(F.lit("Table S "), i % 7, F.lit(" and Tables "), 1 + i % 3, F.lit("–"), 2 + i % 5, F.lit(", Table "), V.pick(("II", "a. 3", "12b"), i % 3))
    got = F.array_sort(tables.table_numbers(text))
    return V.table(spark, d, "documents").select("doc_id", F.array_join(got, ",").alias("numbers"), tables.table_order(F.concat(V.pick(("", "S", "A"), i % 3), i % 11))["value"].alias("value"))


def _equations(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    text = V.pick(("E = m  c", "f(x = y + 2 z", "Mean SD Rate", "a=b", "x"), i % 5)
    raw = F.concat(text, F.when(i % 2 == 0, F.concat(F.lit(" ("), 1 + i % 9, F.lit(")"))).otherwise(""))
    c = E.confidence(raw, E.spaced(raw), i % 7 == 0)
    return V.table(spark, d, "documents").select("doc_id", E.printed_number(raw).alias("number"), c["status"].alias("status"), E.spaced(raw).alias("text"))


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    row = lambda k, n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda j: F.concat(F.lit(k), j.cast("string"), F.lit("|")))
    return V.table(spark, d, "documents").select("doc_id", tables.markdown(F.array(row("h", 1 + i % 3), row("c", 1 + i % 2))).alias("md"))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("task_id")
    return V.tasks(spark, d).select(
        "*", F.concat(F.lit("/p/"), i, F.lit(".pdf")).alias("pdf_path"), F.col("state").alias("status"), (i % 3 == 0).alias("imrad_complete"), (i % 7).alias("n_figures"),
        F.when(i % 4 == 0, F.array(F.lit("methods"), F.lit("results"))).alias("imrad_found"), F.when(i % 5 == 0, F.concat(F.lit("bad\n"), i)).alias("error"),
    )


def _master(spark: SparkSession, d: str) -> DataFrame:
    return sinks.master(_tasks(spark, d)).select("pdf_path", "publisher", "journal", "status", "imrad_complete", "imrad_found", "n_figures", "n_schemes", "error")


def _results(spark: SparkSession, d: str) -> DataFrame:
    i, state = F.col("task_id"), F.col("state")
    status = F.when(state == "done", "success").when(state == "pending", "skipped").when(state == "failed", F.concat(F.lit("error_"), i % 3)).otherwise("timeout")
    return V.tasks(spark, d).select(
        "publisher", status.alias("status"), F.col("seconds").alias("inference_time"), (i % 4).cast("double").alias("tokens_per_second"), (i % 100).alias("input_tokens"),
        (i % 10).alias("output_tokens"), (i % 5).alias("component_count"),
    )


def _run_report(spark: SparkSession, d: str) -> DataFrame:
    r = runs.run_report(_results(spark, d), "publisher")
    return r.withColumn("error_breakdown", F.to_json("error_breakdown"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    t = _tasks(spark, d)
    return sinks.log_lines(t.withColumn("elapsed_seconds", F.col("seconds")), F.col("ts"), F.lit("n1/w01"))


def _families(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("heading")
    flags = {"back": H.is_back_matter(h), "related": H.is_related_work(h), "outside": H.is_outside(h), "technique": H.is_technique(h), "normal": H.normal_heading(h)}
    spelled = V.sections(spark, d).select("doc_id", "ord", F.concat((F.col("ord") + 1).cast("string"), F.lit(". "), F.upper("heading"), F.lit(" :")).alias("heading"))
    return spelled.select("doc_id", "ord", *(c.alias(k) for k, c in flags.items()))


def _pending(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "documents").select(F.col("doc_id").alias(joins.KEY))
    left = joins.pending(rows, rows.where(F.col(joins.KEY) % 3 == 0))
    return joins.slice_items(left, 5, 25, 12).withColumnRenamed(joins.KEY, "id")


QUERIES = {
    "eval_check": _eval_check,
    "eval_metrics": _eval_metrics,
    "evals_scored": _evals_scored,
    "judgment_levels": _judgments,
    "profile_metrics": _profiles,
    "paper_ids": _ids,
    "three_way_levels": _three_way,
    "levels_with_meta": _meta,
    "mention_counts": _mentions,
    "table_numbers": _table_numbers,
    "equation_confidence": _equations,
    "table_markdown": _markdown,
    "master_list": _master,
    "run_report": _run_report,
    "queue_report": lambda s, d: runs.queue_report(_tasks(s, d)),
    "log_lines": _log,
    "heading_families": _families,
    "pending_slice": _pending,
    "milestones": lambda s, d: runs.milestones(V.tasks(s, d)),
}

SCORED_WHERE = "doc_id%5 <> 4"
_BITS = "(doc_id%2+(doc_id//2)%2+(doc_id//4)%2+(doc_id//8)%2)"
_N = "((doc_id)%3+(doc_id+1)%3+(doc_id+2)%3+(doc_id+3)%3)"
SQL = {
    "eval_check": V.with_views(
        """SELECT doc_id, CASE doc_id%5 WHEN 2 THEN 'repaired' WHEN 4 THEN 'failed' ELSE 'raw' END AS parse_mode,
        CASE WHEN doc_id%5=4 THEN 'eval root is not a JSON object' ELSE (SELECT 'relational_integrity['||relation||'].verdict invalid: invalid' FROM v_relations r
          WHERE r.doc_id=d.doc_id AND verdict='invalid' ORDER BY relation='results_to_discussion', relation='methods_to_results' LIMIT 1) END AS problem FROM documents d""",
        "relations",
    ),
    "eval_metrics": V.with_views(
        f"""SELECT doc_id, n_entities_methods, n_explicit_total, n_implied_total, n_absent_total, component_count_observed FROM
        (SELECT doc_id, count_if(section='methods') AS n_entities_methods, count_if(verdict='explicit') AS n_explicit_total, count_if(verdict='implied') AS n_implied_total,
          count_if(verdict='absent') AS n_absent_total FROM v_entities GROUP BY 1)
        JOIN (SELECT doc_id, count_if(verdict<>'absent') AS component_count_observed FROM v_section_verdicts GROUP BY 1) USING (doc_id) WHERE {SCORED_WHERE}""",
        "entities", "section_verdicts",
    ),
    "judgment_levels": f"""SELECT doc_id, CASE WHEN doc_id%6<5 THEN {_BITS} END AS level, doc_id%6 AS reported, CASE WHEN doc_id%6<5 THEN {_BITS}<>doc_id%6 END AS corrected,
        CASE WHEN doc_id%3=0 THEN 0 ELSE 4 END+doc_id%2 AS coerced, CASE WHEN doc_id%6=5 THEN 'level out of range 0-4: 5' END AS problem FROM documents""",
    "profile_metrics": f"""SELECT doc_id, NULL::VARCHAR AS problem, {_N} AS entity_count, CASE WHEN doc_id%3=0 THEN {_N} ELSE 0 END AS total_visual_proxies,
        CASE WHEN doc_id%3=0 THEN 0 ELSE {_N} END AS entities_with_no_proxies, (doc_id+3)%4 AS summary_words_discussion, false AS stage2_ready FROM documents""",
    "paper_ids": """SELECT doc_id, '10_'||doc_id||'_j_x_'||source AS norm, CASE doc_id%4 WHEN 0 THEN 'https_doi_org_' WHEN 1 THEN 'DOI_' ELSE '' END||'10_'||doc_id||'_J_X_'||source AS safe,
        '10.'||doc_id||'/j.x.'||source AS folder, '10/'||doc_id||'_j_x_'||source AS slashed, CASE WHEN doc_id%250 BETWEEN 10 AND 210 THEN 1890+doc_id%250 END AS year, doc_id%5 AS level FROM documents""",
    "three_way_levels": V.with_views("SELECT '10_'||doc_id AS id, a AS level_1, b AS level_2, c AS level FROM v_levels WHERE b IS NOT NULL AND doc_id%3<>0", "levels"),
    "levels_with_meta": V.with_views(
        """SELECT '10_'||l.doc_id AS id, a AS level_a, c AS level_b, coalesce(CASE WHEN l.doc_id%5<>0 AND l.doc_id%10<>1 THEN source END, 'NA') AS domain,
        CASE WHEN l.doc_id%5<>0 AND l.doc_id%7<>0 THEN 2000+l.doc_id%25 END AS year FROM v_levels l JOIN documents d USING (doc_id) WHERE l.doc_id%3<>0""",
        "levels",
    ),
    "mention_counts": """SELECT doc_id, 'figure::'||k AS key, 1+CASE WHEN k=1+doc_id%9 THEN 2 ELSE 0 END AS n
        FROM (SELECT doc_id, unnest(generate_series(1+doc_id%9, 2+doc_id%9+doc_id%3)) AS k FROM documents)
        UNION ALL SELECT doc_id, 'table::'||k, CASE WHEN k=1 THEN 2 ELSE 1 END FROM documents, (VALUES (1),(2),(4)) t(k)""",
    "table_numbers": """SELECT doc_id, array_to_string(list_sort(list_distinct(['S'||(doc_id%7), ['II','A3','12B'][doc_id%3+1]]||CASE WHEN 1+doc_id%3<=2+doc_id%5
          THEN list_transform(generate_series(1+doc_id%3, 2+doc_id%5), lambda n: n::VARCHAR) ELSE []::VARCHAR[] END)), ',') AS numbers,
        ([0, 2000, 1000][doc_id%3+1]+doc_id%11)::DOUBLE AS value FROM documents""",
    "equation_confidence": """SELECT doc_id, CASE WHEN doc_id%2=0 THEN (1+doc_id%9)::INT END AS number, CASE WHEN doc_id%5=2 OR doc_id%10=9 AND false THEN 'rejected'
        WHEN doc_id%5=4 AND doc_id%2=1 THEN 'rejected' WHEN doc_id%5=1 THEN 'needs_review' WHEN doc_id%5=4 THEN 'needs_review'
        WHEN doc_id%5=3 AND doc_id%2=1 THEN 'needs_review' WHEN doc_id%7=0 THEN 'repaired' ELSE 'clean' END AS status,
        ['E = m c','f(x = y + 2 z','Mean SD Rate','a = b','x'][doc_id%5+1]||CASE WHEN doc_id%2=0 THEN ' ('||(1+doc_id%9)||')' ELSE '' END AS text FROM documents""",
    "table_markdown": r"""SELECT doc_id, '| '||array_to_string(list_transform(generate_series(1, w), lambda j: CASE WHEN j<=1+doc_id%3 THEN 'h'||j||'\|' ELSE '' END), ' | ')||' |'||chr(10)||
        '| '||array_to_string(list_transform(generate_series(1, w), lambda j: '---'), ' | ')||' |'||chr(10)||
        '| '||array_to_string(list_transform(generate_series(1, w), lambda j: CASE WHEN j<=1+doc_id%2 THEN 'c'||j||'\|' ELSE '' END), ' | ')||' |' AS md
        FROM (SELECT doc_id, greatest(1+doc_id%3, 1+doc_id%2) AS w FROM documents)""",
    "master_list": V.with_views(
        """SELECT '/p/'||task_id||'.pdf' AS pdf_path, publisher, '' AS journal, state AS status, CASE WHEN task_id%3=0 THEN '1' ELSE '0' END AS imrad_complete,
        CASE WHEN task_id%4=0 THEN 'methods|results' ELSE '' END AS imrad_found, task_id%7 AS n_figures, 0 AS n_schemes, CASE WHEN task_id%5=0 THEN 'bad '||task_id ELSE '' END AS error FROM v_tasks""",
        "tasks",
    ),
    "run_report": V.with_views(
        """, r AS (SELECT *, CASE state WHEN 'done' THEN 'success' WHEN 'pending' THEN 'skipped' WHEN 'failed' THEN 'error_'||(task_id%3) ELSE 'timeout' END AS status FROM v_tasks),
        e AS (SELECT publisher, '{'||string_agg('"'||status||'":'||n, ',' ORDER BY status)||'}' AS error_breakdown FROM (SELECT publisher, status, count(*) AS n FROM r
          WHERE status NOT IN ('success','skipped') GROUP BY ALL) GROUP BY 1)
        SELECT publisher, count(*) AS selected, count_if(status='skipped') AS skipped, count_if(status<>'skipped') AS processed, count_if(status='success') AS success,
          count_if(status NOT IN ('success','skipped')) AS failed, round_even(100.0::DOUBLE*count_if(status='success')/count_if(status<>'skipped'), 2) AS success_rate_processed,
          round_even(100.0::DOUBLE*count_if(status='success')/count(*), 2) AS success_rate_selected, round_even(avg(seconds) FILTER (WHERE status='success'), 2) AS avg_time,
          round_even(median(seconds) FILTER (WHERE status='success'), 2) AS median_time, round_even(avg((task_id%4)::DOUBLE) FILTER (WHERE status='success' AND task_id%4>0), 2) AS avg_tokens_per_second,
          sum(task_id%100) FILTER (WHERE status='success') AS input_tokens, sum(task_id%10) FILTER (WHERE status='success') AS output_tokens,
          round_even(avg((task_id%5)::DOUBLE) FILTER (WHERE status='success'), 2) AS avg_components, any_value(error_breakdown) AS error_breakdown FROM r JOIN e USING (publisher) GROUP BY 1""",
        "tasks",
    ),
    "queue_report": V.with_views(
        """SELECT count(*) AS total, count_if(state='pending') AS pending, count_if(state='in_progress') AS in_progress, count_if(state='done') AS done, count_if(state='failed') AS failed,
        count_if(state='done' AND task_id%3=0) AS complete FROM v_tasks""",
        "tasks",
    ),
    "log_lines": V.with_views(
        """SELECT array_to_string([strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'n1/w01', state, '/p/'||task_id||'.pdf', (task_id%900)||'.00', CASE WHEN task_id%3=0 THEN 'imrad_ok' ELSE 'imrad_partial' END,
        'methods_direct', (task_id%7)::VARCHAR, 'figs='||(task_id%7), 'schemes=0', 'tbl=0', 'tbl_ocr=0', 'tbl_unrec=0', 'eq_ocr=0', 'cap_rm=0', 'refs=0', coalesce(stage_failed, ''),
        CASE WHEN task_id%5=0 THEN 'bad '||task_id ELSE '' END], chr(9)) AS line FROM v_tasks""",
        "tasks",
    ),
    "heading_families": V.with_views(
        """SELECT doc_id, ord, heading='References' AS back, heading='Related Work' AS related, heading IN ('References','Related Work') AS outside, heading='XRD analysis' AS technique,
        lower(heading) AS normal FROM v_sections""",
        "sections",
    ),
    "pending_slice": "SELECT doc_id AS id FROM documents WHERE doc_id%3<>0 ORDER BY 1 LIMIT 12 OFFSET 5",
    "milestones": V.with_views(
        """, s AS (SELECT ts, count(*) AS n FROM v_tasks WHERE state IN ('done','failed') GROUP BY 1), c AS (SELECT ts, n, sum(n) OVER (ORDER BY ts)::BIGINT AS upto FROM s)
        SELECT unnest(generate_series((upto-n)//100+1, upto//100))*100 AS nth, ts FROM c""",
        "tasks",
    ),
}
