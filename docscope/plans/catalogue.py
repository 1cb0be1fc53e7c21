"""The queries over the derived views, and their SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.functions import headings as H
from docscope.operators import agreement as A
from docscope.operators import imrad as I
from docscope.operators import papers as P
from docscope.operators import runs as R
from docscope.operators import scoring as S

from . import content, judging, layout
from . import views as V

POINTS = {"traceable": 2, "partially_traceable": 1, "not_traceable": 0}
CONTENT = r"(?i)\b(the|of|and)\b"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return S.score_eval(V.entities(spark, d), V.section_verdicts(spark, d), V.relations(spark, d))


def _points(spark: SparkSession, d: str) -> DataFrame:
    r = V.relations(spark, d)
    point = lambda c: S.scored(F.col(c), {k: float(v) for k, v in POINTS.items()})
    return r.select("doc_id", "relation", point("verdict").alias("a"), point("human").alias("b"))


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    both = F.explode(F.array(*(F.struct(F.lit(n).alias("annotator"), F.col(c).alias("level")) for n, c in (("one", "a"), ("two", "b")))))
    return V.levels(spark, d).select(both.alias("x")).select("x.*")


def _keyed_figures(spark: SparkSession, d: str) -> DataFrame:
    return V.figures(spark, d).select("doc_id", "n", P.figure_key("label").alias("key"))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("n")
    return V.figures(spark, d).select("doc_id", F.concat(F.lit("Figure "), (n * 2 + i % 3)).alias("label")).select("doc_id", P.figure_key("label").alias("key"))


def _r_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).groupBy("doc_id").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), (F.count("a") == 3).alias("all_a"), (F.count("b") == 3).alias("all_b")
    )
    ok = p.where("all_a and all_b")
    a, b = F.col("a"), F.col("b")
    return ok.agg(F.count("*").alias("n"), F.round(F.avg(a / 6), 4).alias("mean_a"), F.round(F.avg(b / 6), 4).alias("mean_b"), A.exact_pct(a, b).alias("exact_pct"), F.round(A.qwk(a, b), 6).alias("qwk"))


def _by(column: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        level = V.levels(spark, d).withColumn("domain", F.coalesce("domain", F.lit("NA")))
        return level.groupBy(column).agg(F.count("*").alias("n"), F.round(F.avg("a"), 4).alias("mean_a"), F.round(F.avg("b"), 4).alias("mean_b"))

    return run


def _merged(spark: SparkSession, d: str) -> DataFrame:
    figs = _keyed_figures(spark, d)
    second = figs.select("doc_id", (F.col("n") + 100).alias("n"), F.when(F.col("n") % 3 == 0, F.concat(F.col("key"), F.lit("0"))).otherwise(F.col("key")).alias("key"))
    return P.merge_new(figs, second)


def _headings(spark: SparkSession, d: str) -> DataFrame:
    c = H.classify(F.col("heading"))
    return V.sections(spark, d).select("doc_id", "ord", c.alias("c")).select("doc_id", "ord", *(f"c.{n}" for n in ("label", "secondary", "source", "confidence")))


def _effective(spark: SparkSession, d: str) -> DataFrame:
    return I.effective(V.sections(spark, d)).select("doc_id", "ord", "effective")


def _labelled_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections with their effective label in place of their own."""
    return V.sections(spark, d).join(_effective(spark, d), ["doc_id", "ord"]).select("doc_id", "ord", "page", F.col("effective").alias("imrad"))


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in anchors: pages of figures with an even number, labelled by turns."""
    f = V.figures(spark, d).where("n % 2 = 0")
    return f.select("doc_id", F.col("n").alias("at"), "page", V.pick(V.SECTIONS, (F.col("doc_id") + F.col("n")) % 4).alias("label"))


def _html_text(spark: SparkSession, d: str) -> DataFrame:
    pages = V.table(spark, d, "pages")
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return pages.select("page_id", title.alias("title"), F.regexp_count("html", F.lit("<p>")).alias("n_paragraphs"))


QUERIES = {
    "section_coverage": lambda s, d: S.section_coverage(V.entities(s, d)),
    "score_eval": _scores,
    "method_summary": lambda s, d: S.method_summary(_scores(s, d), F.col("doc_id") % 3),
    "coverage_breakdown_section": lambda s, d: S.coverage_breakdown(V.section_verdicts(s, d), "section", V.VERDICTS),
    "coverage_breakdown_entity": lambda s, d: S.coverage_breakdown(V.entities(s, d), "section", V.VERDICTS),
    "coverage_breakdown_relation": lambda s, d: S.coverage_breakdown(V.relations(s, d), "relation", V.LINKS[:3]),
    "confusion_5x5": lambda s, d: A.confusion(V.levels(s, d), "a", "b"),
    "level_distribution": lambda s, d: A.distribution(V.levels(s, d), {"model": "a", "baseline": "c"}),
    "disagreement_hist": lambda s, d: A.disagreement(V.levels(s, d), "a", "c"),
    "levels_by_year": _by("year"),
    "levels_by_domain": _by("domain"),
    "level_compare_summary": lambda s, d: A.compare_levels(V.levels(s, d), "a", "b", ["year"]),
    "qwk_labels": lambda s, d: V.table(s, d, "labels").agg(F.count("*").alias("n"), F.round(A.qwk(F.col("quality"), F.col("toxic")), 6).alias("qwk")),
    "cohen_kappa_labels": lambda s, d: A.cohen_kappa(V.table(s, d, "labels"), "quality", "toxic"),
    "spearman_level": lambda s, d: A.spearman(V.levels(s, d), "a", "b"),
    "relation_agreement_pooled": lambda s, d: A.relation_agreement(_points(s, d)),
    "r_metrics": _r_metrics,
    "annotator_severity": lambda s, d: A.severity(_annotations(s, d)),
    "model_vs_consensus": lambda s, d: A.consensus(V.levels(s, d), "c", "a", "b"),
    "classify_heading": _headings,
    "effective_imrad": _effective,
    "imrad_summary": lambda s, d: P.imrad_summary(V.sections(s, d), V.SECTIONS),
    "parse_label": lambda s, d: _keyed_figures(s, d),
    "missing_refs": lambda s, d: P.missing_keys(_mentions(s, d), _keyed_figures(s, d)),
    "figure_merge_anti": _merged,
    "fig_asof_section": lambda s, d: P.asof_section(V.figures(s, d), _labelled_sections(s, d)),
    "table_asof_section": lambda s, d: P.asof_table(V.figures(s, d), V.sections(s, d)),
    "fig_nearest_anchor": lambda s, d: P.nearest_anchor(V.figures(s, d), _anchors(s, d)),
    "dup_bbox": lambda s, d: P.duplicate_boxes(V.figures(s, d)),
    "suspect_figures": lambda s, d: P.suspect_figures(V.figures(s, d)),
    "figure_stats": lambda s, d: P.figure_stats(V.figures(s, d)),
    "dup_suffix": lambda s, d: P.duplicate_suffix(V.table(s, d, "documents").select("doc_id", "source"), "source", "doc_id"),
    "digit_ratio": lambda s, d: V.table(s, d, "documents").select("doc_id", P.digit_ratio(F.col("text")).alias("ratio")),
    "content_score": lambda s, d: V.table(s, d, "documents").select("doc_id", P.content_score(F.regexp_replace("text", "[^\\x00-\\x7F]", "~"), CONTENT).alias("score")),
    "html_paragraphs": _html_text,
    "queue_status": lambda s, d: R.queue_status(V.tasks(s, d)),
    "failures_by_stage": lambda s, d: R.failures_by_stage(V.tasks(s, d)),
    "publisher_counts": lambda s, d: R.publisher_counts(V.tasks(s, d)),
    "recent_failures": lambda s, d: R.recent_failures(V.tasks(s, d)),
    "run_summary": lambda s, d: R.run_summary(V.tasks(s, d)),
    "task_throughput_tumbling": lambda s, d: R.throughput(V.tasks(s, d)),
    "latest_state": lambda s, d: R.latest_state(V.tasks(s, d), "publisher"),
    "stalled_tasks": lambda s, d: R.stalled(V.tasks(s, d)),
}

_ENTITY = "CASE verdict WHEN 'explicit' THEN 1.0::DOUBLE WHEN 'implied' THEN 0.5::DOUBLE WHEN 'absent' THEN 0.0::DOUBLE END"
_LINK = "CASE verdict WHEN 'traceable' THEN 1.0::DOUBLE WHEN 'partially_traceable' THEN 0.5::DOUBLE WHEN 'not_traceable' THEN 0.0::DOUBLE END"
_POINT = "CASE {0} WHEN 'traceable' THEN 2.0::DOUBLE WHEN 'partially_traceable' THEN 1.0::DOUBLE WHEN 'not_traceable' THEN 0.0::DOUBLE END"
_KEY = r"""CASE WHEN regexp_matches(label, '(?i)\b(fig|figure|table|scheme)s?\.?\s*([A-Z])?\.?\s*(\d+)') THEN
  concat_ws(':', replace(replace(lower(regexp_extract(label, '(?i)\b(fig|figure|table|scheme)s?\.?\s*([A-Z])?\.?\s*(\d+)', 1)), 'figure', 'fig'), 'fig', 'figure'),
    upper(regexp_extract(label, '(?i)\b(fig|figure|table|scheme)s?\.?\s*([A-Z])?\.?\s*(\d+)', 2)), regexp_extract(label, '(?i)\b(fig|figure|table|scheme)s?\.?\s*([A-Z])?\.?\s*(\d+)', 3)) END"""
_COVER = f"SELECT doc_id, section, round(coalesce(avg({_ENTITY}), 0), 4) AS coverage, count_if(verdict='explicit') AS n_explicit, count_if(verdict='implied') AS n_implied, count_if(verdict='absent') AS n_absent FROM v_entities GROUP BY ALL"
_MEANS = f"SELECT doc_id, section, coalesce(avg({_ENTITY}), 0) AS coverage FROM v_entities GROUP BY ALL"
_SCORE = f"""SELECT l.doc_id, round(s, 4) AS s, round(r, 4) AS r, round(0.7::DOUBLE*s+0.3::DOUBLE*r, 4) AS c_weighted, round((s+r)/2, 4) AS c_unweighted, level, n_relations_scored
FROM (SELECT doc_id, count_if(verdict IN ('explicit','implied')) AS level FROM v_section_verdicts GROUP BY 1) l
JOIN (SELECT doc_id, sum(coverage)/4 AS s FROM ({_MEANS}) GROUP BY 1) e USING (doc_id)
JOIN (SELECT doc_id, coalesce(avg({_LINK}), 0) AS r, count({_LINK}) AS n_relations_scored FROM v_relations GROUP BY 1) x USING (doc_id)"""


def _break(view: str, by: str, verdicts: tuple[str, ...]) -> str:
    n = f"greatest(count_if(verdict IN ({', '.join(repr(v) for v in verdicts)})), 1)"
    cols = ", ".join(f"count_if(verdict='{v}') AS n_{v}, round(100.0::DOUBLE*count_if(verdict='{v}')/{n}, 2) AS pct_{v}" for v in verdicts)
    return V.with_views(f"SELECT {by}, {cols} FROM v_{view} GROUP BY 1", view)


def _qwk(a: str, b: str) -> str:
    a, b = (f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {x}::DOUBLE END" for x in (a, b))
    n = f"count({a})"
    bottom = f"({n}*sum(({a})*({a}))+{n}*sum(({b})*({b}))-2*sum({a})*sum({b}))"
    return f"round(1-{n}*sum((({a})-({b}))*(({a})-({b})))/nullif({bottom}, 0), 6)"


def _exact(a: str, b: str) -> str:
    return f"round(100.0::DOUBLE*avg(({a}={b})::INT), 2)"


def _groups(by: str) -> str:
    return V.with_views(f"SELECT {by}, count(*) AS n, round(avg(a), 4) AS mean_a, round(avg(b), 4) AS mean_b FROM (SELECT * REPLACE (coalesce(domain, 'NA') AS domain) FROM v_levels) GROUP BY 1", "levels")


# What each heading of the views is, written down by hand from the classifier's rules.
_CLASSES = """(VALUES ('Introduction','introduction',NULL,'heading_exact',1.0::DOUBLE), ('Materials and Methods','methods',NULL,'heading_exact',1.0),
  ('Results and Discussion','results','discussion','combined_section',0.95), ('Related Work',NULL,NULL,'excluded',0.0),
  ('XRD analysis','results',NULL,'heading_characterization',0.8), ('Conclusions','discussion',NULL,'heading_exact',1.0),
  ('References',NULL,NULL,'excluded',0.0), ('Devices',NULL,NULL,'none',0.0)) t(heading, label, secondary, source, confidence)"""
_EFFECTIVE = f"""SELECT doc_id, ord, nullif(last_value(coalesce(imrad, CASE WHEN source='excluded' THEN '' END, label) IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING), '') AS effective FROM v_sections JOIN {_CLASSES} USING (heading)"""
_FIGS = f"v_f AS (SELECT doc_id, n, {_KEY} AS key FROM v_figures)"
_SECOND = "SELECT doc_id, n+100 AS n, CASE WHEN n%3=0 THEN key||'0' ELSE key END AS key FROM v_f"

SQL = {
    "section_coverage": V.with_views(_COVER, "entities"),
    "score_eval": V.with_views(_SCORE, "entities", "section_verdicts", "relations"),
    "method_summary": V.with_views(
        f"SELECT doc_id%3 AS method, count(*) AS n_total, count_if(n_relations_scored>0) AS n_scored, round(avg(s),4) AS mean_s, round(avg(r),4) AS mean_r, round(avg(c_weighted),4) AS mean_c_weighted, round(avg(level),4) AS mean_level FROM ({_SCORE}) GROUP BY 1",
        "entities", "section_verdicts", "relations",
    ),
    "coverage_breakdown_section": _break("section_verdicts", "section", V.VERDICTS),
    "coverage_breakdown_entity": _break("entities", "section", V.VERDICTS),
    "coverage_breakdown_relation": _break("relations", "relation", V.LINKS[:3]),
    "confusion_5x5": V.with_views(
        "SELECT k AS a, " + ", ".join(f"count_if(a=k AND b={j}) AS b{j}" for j in range(5)) + " FROM v_levels, (SELECT unnest(generate_series(0,4)) AS k) GROUP BY k", "levels"
    ),
    "level_distribution": V.with_views(
        "SELECT method, k AS level, count_if(level=k) AS n, round(100.0::DOUBLE*count_if(level=k)/count(*), 2) AS pct FROM (SELECT 'model' AS method, a AS level FROM v_levels UNION ALL SELECT 'baseline', c FROM v_levels) x, (SELECT unnest(generate_series(0,4)) AS k) WHERE level IS NOT NULL GROUP BY method, k",
        "levels",
    ),
    "disagreement_hist": V.with_views("SELECT k AS diff, count_if(a-c=k) AS n FROM v_levels, (SELECT unnest(generate_series(-4,4)) AS k) GROUP BY k", "levels"),
    "levels_by_year": _groups("year"),
    "levels_by_domain": _groups("domain"),
    "level_compare_summary": V.with_views(
        f"SELECT year, count(*) AS n, round(avg(a),4) AS mean_a, round(avg(b),4) AS mean_b, round(avg(a)-avg(b),4) AS diff, {_exact('a','b')} AS exact_pct, round(100.0::DOUBLE*avg((abs(a-b)<=1)::INT),2) AS within1_pct, round(100.0::DOUBLE*avg((a>b)::INT),2) AS higher_pct, {_qwk('a','b')} AS qwk FROM v_levels WHERE b IS NOT NULL GROUP BY year",
        "levels",
    ),
    "qwk_labels": f"SELECT count(*) AS n, {_qwk('quality', 'toxic')} AS qwk FROM labels",
    "cohen_kappa_labels": """WITH t AS (SELECT count(*)::DOUBLE AS n, sum((quality=toxic)::INT) AS same FROM labels),
      e AS (SELECT sum(x.n*y.n)::DOUBLE AS chance FROM (SELECT quality AS v, count(*) AS n FROM labels GROUP BY 1) x JOIN (SELECT toxic AS v, count(*) AS n FROM labels GROUP BY 1) y USING (v))
      SELECT n::BIGINT AS n, round((same/n - chance/(n*n))/nullif(1-chance/(n*n), 0), 6) AS kappa FROM t, e""",
    "spearman_level": V.with_views(
        "SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY a)+(count(*) OVER (PARTITION BY a)-1)/2.0::DOUBLE AS ra, rank() OVER (ORDER BY b)+(count(*) OVER (PARTITION BY b)-1)/2.0::DOUBLE AS rb FROM v_levels WHERE b IS NOT NULL)", "levels"
    ),
    "relation_agreement_pooled": V.with_views(
        f"SELECT coalesce(relation, 'POOLED') AS relation, count(*) AS n, {_exact('a','b')} AS exact_pct, {_qwk('a','b')} AS qwk FROM (SELECT relation, {_POINT.format('verdict')} AS a, {_POINT.format('human')} AS b FROM v_relations) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY GROUPING SETS ((relation), ())",
        "relations",
    ),
    "r_metrics": V.with_views(
        f"SELECT count(*) AS n, round(avg(a/6),4) AS mean_a, round(avg(b/6),4) AS mean_b, {_exact('a','b')} AS exact_pct, {_qwk('a','b')} AS qwk FROM (SELECT doc_id, sum({_POINT.format('verdict')}) AS a, sum({_POINT.format('human')}) AS b FROM v_relations GROUP BY 1 HAVING count({_POINT.format('verdict')})=3 AND count({_POINT.format('human')})=3)",
        "relations",
    ),
    "annotator_severity": V.with_views(
        "SELECT annotator, count(*) AS n, round(avg(level),4) AS mean_level, " + ", ".join(f"round(100.0::DOUBLE*count_if(level={j})/count(*),2) AS pct_{j}" for j in range(5)) + " FROM (SELECT 'one' AS annotator, a AS level FROM v_levels UNION ALL SELECT 'two', b FROM v_levels) WHERE level IS NOT NULL GROUP BY 1",
        "levels",
    ),
    "model_vs_consensus": V.with_views(
        f"SELECT reference, count(*) AS n, {_exact('m','level')} AS exact_pct, {_qwk('m','level')} AS qwk FROM (SELECT c AS m, 'annotator_1' AS reference, a::DOUBLE AS level FROM v_levels UNION ALL SELECT c, 'annotator_2', b FROM v_levels UNION ALL SELECT c, 'mean', round_even((a+b)/2.0::DOUBLE, 0) FROM v_levels UNION ALL SELECT c, 'agreed', a FROM v_levels WHERE a=b) WHERE level IS NOT NULL GROUP BY 1",
        "levels",
    ),
    "classify_heading": V.with_views(f"SELECT doc_id, ord, label, secondary, source, confidence FROM v_sections JOIN {_CLASSES} USING (heading)", "sections"),
    "effective_imrad": V.with_views(_EFFECTIVE, "sections"),
    "imrad_summary": V.with_views(
        "SELECT doc_id, count(*) AS n_sections, " + ", ".join(
            f"coalesce(array_to_string(list_filter({V._list(V.SECTIONS)}, lambda x: {no}list_contains(coalesce(list(imrad) FILTER (WHERE imrad IS NOT NULL), []), x)), ','), '') AS {name}" for no, name in (("", "found"), ("NOT ", "missing"))
        ) + " FROM v_sections GROUP BY 1", "sections",
    ),
    "parse_label": V.with_views(f"SELECT doc_id, n, {_KEY} AS key FROM v_figures", "figures"),
    "missing_refs": V.with_views(
        f", {_FIGS} SELECT DISTINCT doc_id, 'figure::'||(n*2+doc_id%3) AS key FROM v_figures m WHERE NOT EXISTS (SELECT 1 FROM v_f f WHERE f.doc_id=m.doc_id AND f.key='figure::'||(m.n*2+m.doc_id%3))", "figures"
    ),
    "figure_merge_anti": V.with_views(
        f", {_FIGS} SELECT * FROM v_f UNION ALL SELECT doc_id, min(n) AS n, key FROM ({_SECOND}) s WHERE key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_f f WHERE f.doc_id=s.doc_id AND f.key=s.key) GROUP BY doc_id, key", "figures"
    ),
    "fig_asof_section": V.with_views(
        f", v_e AS (SELECT s.doc_id, s.ord, s.page, e.effective AS imrad FROM v_sections s JOIN ({_EFFECTIVE}) e USING (doc_id, ord)) SELECT f.doc_id, f.n, (SELECT imrad FROM v_e s WHERE s.doc_id=f.doc_id AND imrad IS NOT NULL AND s.page<=f.page ORDER BY s.page DESC, ord LIMIT 1) AS assigned FROM v_figures f", "figures", "sections"
    ),
    "table_asof_section": V.with_views(
        "SELECT f.doc_id, f.n, coalesce((SELECT ord FROM v_sections s WHERE s.doc_id=f.doc_id AND s.page<=f.page ORDER BY s.page DESC, ord DESC LIMIT 1), 0) AS section_ord FROM v_figures f", "figures", "sections"
    ),
    "fig_nearest_anchor": V.with_views(
        "SELECT f.doc_id, f.n, (SELECT ['introduction','methods','results','discussion'][(a.doc_id+a.n)%4+1] FROM v_figures a WHERE a.doc_id=f.doc_id AND a.n%2=0 ORDER BY abs(a.page-f.page), (a.page<f.page)::INT, CASE WHEN a.page>=f.page THEN -a.n ELSE a.n END LIMIT 1) AS nearest FROM v_figures f", "figures"
    ),
    "dup_bbox": V.with_views("SELECT doc_id, n, sharing FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, round(x), round(y), round(w), round(h)) AS sharing FROM v_figures) WHERE sharing>1", "figures"),
    "suspect_figures": V.with_views(
        "SELECT * FROM (SELECT doc_id, n, concat_ws(',', CASE WHEN image_kb IS NULL THEN 'missing_image' END, CASE WHEN image_kb<8 THEN 'small_image' END, CASE WHEN h<50 THEN 'short' END, CASE WHEN w<60 THEN 'narrow' END, CASE WHEN w*h<5000 THEN 'small_area' END, CASE WHEN greatest(w/h, h/w)>10 THEN 'extreme_aspect' END) AS reasons FROM v_figures) WHERE reasons<>''",
        "figures",
    ),
    "figure_stats": V.with_views(
        "SELECT doc_id, count_if(NOT starts_with(label,'Table')) AS n_figures, count_if(starts_with(label,'Table')) AS n_tables, count_if(image_kb IS NULL) AS n_missing, count_if(w<80 OR h<80) AS n_absurd FROM v_figures GROUP BY 1", "figures"
    ),
    "dup_suffix": "SELECT doc_id, CASE WHEN r=1 THEN source ELSE source||'_dup'||r END AS safe_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)",
    "digit_ratio": "SELECT doc_id, round(length(regexp_replace(text, '[^0-9]', '', 'g'))/greatest(length(text), 1)::DOUBLE, 4) AS ratio FROM documents",
    "html_paragraphs": "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, ((length(html)-length(replace(html, '<p>', '')))//3)::INT AS n_paragraphs FROM pages",
    "queue_status": V.with_views("SELECT state, count(*) AS n FROM v_tasks GROUP BY 1", "tasks"),
    "failures_by_stage": V.with_views("SELECT coalesce(nullif(stage_failed,''), '_unspecified') AS stage, count(*) AS n FROM v_tasks WHERE state='failed' GROUP BY 1", "tasks"),
    "publisher_counts": V.with_views("SELECT coalesce(nullif(trim(publisher),''), '_unknown') AS publisher, count(*) AS total, count_if(state='done') AS done, count_if(state='failed') AS failed FROM v_tasks GROUP BY 1", "tasks"),
    "recent_failures": V.with_views("SELECT task_id, stage_failed, ts FROM v_tasks WHERE state='failed' ORDER BY ts DESC, task_id DESC LIMIT 20", "tasks"),
    "run_summary": V.with_views(
        "SELECT publisher, count(*) AS n, count_if(state='done') AS n_done, round(100.0::DOUBLE*count_if(state='done')/count(*),2) AS success_pct, round(avg(CASE WHEN state='done' THEN seconds END),4) AS mean_seconds, round(median(CASE WHEN state='done' THEN seconds END),4) AS median_seconds FROM v_tasks GROUP BY 1", "tasks"
    ),
    "task_throughput_tumbling": V.with_views("SELECT date_trunc('hour', ts) AS start, count(*) AS n, count_if(state='done') AS done, count_if(state='failed') AS failed FROM v_tasks GROUP BY 1", "tasks"),
    "latest_state": V.with_views("SELECT publisher, state, ts FROM (SELECT *, row_number() OVER (PARTITION BY publisher ORDER BY ts DESC, task_id DESC) AS r FROM v_tasks) WHERE r=1", "tasks"),
}

SQL["stalled_tasks"] = V.with_views(
    "SELECT task_id, ts AS claimed FROM v_tasks WHERE state='in_progress' AND ts < (SELECT max(ts) FROM v_tasks) - INTERVAL 15 MINUTE", "tasks"
)
SQL["content_score"] = r"""SELECT doc_id, round(len(regexp_extract_all(t, '(?i)\b(the|of|and)\b'))/greatest(1.0::DOUBLE, length(t)/1500.0::DOUBLE), 4) AS score
  FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '~', 'g') AS t FROM documents)"""
SQL["tei_sections"] = V.with_views(
    f"""SELECT doc_id, ord, heading, coalesce(label, nullif(last_value(CASE WHEN source='excluded' OR label='introduction' THEN '' ELSE label END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING), '')) AS imrad FROM v_sections JOIN {_CLASSES} USING (heading)""", "sections"
)
QUERIES |= content.QUERIES | judging.QUERIES | layout.QUERIES
SQL |= content.SQL | judging.SQL | layout.SQL
JUDGED = judging.SCORED_WHERE
SQL["evals_scored"] = V.with_views(f"SELECT * FROM ({_SCORE}) WHERE {JUDGED}", "entities", "section_verdicts", "relations")
