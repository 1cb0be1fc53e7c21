"""Views shaped like extracted papers and judgments, derived from the driver tables by integer arithmetic.

Each view has a DataFrame form and, for the checks, a SQL form with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import ship_package

SECTIONS = ("introduction", "methods", "results", "discussion")
RELATIONS = ("intro_to_methods", "methods_to_results", "results_to_discussion")
VERDICTS = ("explicit", "implied", "absent")
LINKS = ("traceable", "partially_traceable", "not_traceable", "invalid")
HEADINGS = ("Introduction", "Materials and Methods", "Results and Discussion", "Related Work", "XRD analysis", "Conclusions", "References", "Devices")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(words: tuple[str, ...], index: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, words)), (index + 1).cast("int"))


def _spine(df: DataFrame, name: str, n: F.Column | int, start: int = 0) -> DataFrame:
    stop = F.lit(n - 1) if isinstance(n, int) else n
    return df.withColumn(name, F.explode(F.sequence(F.lit(start).cast("long"), stop.cast("long"))))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, section, k, verdict: two to five entities a section."""
    d = _spine(table(spark, sf_dir, "documents").select("doc_id"), "sec", 4)
    d = _spine(d, "k", 2 + (F.col("doc_id") + F.col("sec")) % 4, 1)
    verdict = pick(VERDICTS, (F.col("doc_id") * 31 + F.col("sec") * 7 + F.col("k") * 3) % 3)
    return d.select("doc_id", pick(SECTIONS, F.col("sec")).alias("section"), "k", verdict.alias("verdict"))


def section_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _spine(table(spark, sf_dir, "documents").select("doc_id"), "sec", 4)
    verdict = pick(VERDICTS, (F.col("doc_id") * 5 + F.col("sec") * 3) % 3)
    return d.select("doc_id", pick(SECTIONS, F.col("sec")).alias("section"), verdict.alias("verdict"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, relation, verdict (model) and human: three links a paper."""
    d = _spine(table(spark, sf_dir, "documents").select("doc_id"), "rel", 3)
    v = pick(LINKS, (F.col("doc_id") * 17 + F.col("rel") * 5) % 4)
    h = pick(LINKS, (F.col("doc_id") * 7 + F.col("rel") * 3) % 4)
    return d.select("doc_id", pick(RELATIONS, F.col("rel")).alias("relation"), v.alias("verdict"), h.alias("human"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, year, domain, a and b (two raters, b with gaps), c (baseline)."""
    i = F.col("doc_id")
    b = F.least(F.lit(4), F.greatest(F.lit(0), i % 5 + (i * 13) % 3 - 1))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        (2000 + i % 25).alias("year"),
        F.when(i % 10 != 0, F.col("source")).alias("domain"),
        (i % 5).alias("a"),
        F.when(i % 11 != 0, b).alias("b"),
        ((i * 3) % 5).alias("c"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, heading, page, imrad: six sections a paper; some have a label of their own."""
    d = _spine(table(spark, sf_dir, "documents").select("doc_id"), "ord", 6)
    label = F.when((F.col("doc_id") + F.col("ord")) % 3 == 0, pick(SECTIONS, (F.col("doc_id") + F.col("ord") * 2) % 4))
    heading = pick(HEADINGS, (F.col("doc_id") * 7 + F.col("ord") * 3) % 8)
    page = 1 + (F.col("ord") * 3 + F.col("doc_id") % 4) / 4
    return d.select("doc_id", "ord", heading.alias("heading"), F.floor(page).alias("page"), label.alias("imrad"))


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, label, page, x, y, w, h, image_kb: one to six figures a paper."""
    d = _spine(table(spark, sf_dir, "documents").select("doc_id"), "n", 1 + F.col("doc_id") % 6, 1)
    i, n = F.col("doc_id"), F.col("n")
    kind = (i + n) % 4
    label = (
        F.when(kind == 0, F.concat(F.lit("Fig. "), n)).when(kind == 1, F.concat(F.lit("FIGURE "), n))
        .when(kind == 2, F.concat(F.lit("Supplementary Figure S"), n)).otherwise(F.concat(F.lit("Table "), n))
    )
    box = {"x": (i * 3) % 50, "y": (i + n % 2) % 70, "w": 40 + (i * 7 + n % 2 * 13) % 300, "h": 30 + (i * 11 + n % 2 * 5) % 250}
    return d.select(
        "doc_id", "n", label.alias("label"), (1 + (i * 3 + n * 5) % 7).alias("page"),
        *(v.cast("double").alias(k) for k, v in box.items()), F.when((i + n) % 9 != 0, (i * 5 + n * 3) % 40).alias("image_kb"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, publisher, state, stage_failed, ts, seconds: the work queue, from events."""
    state = (
        F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type").isin("view", "click"), "in_progress")
        .when(F.col("event_type") == "purchase", "done").otherwise("failed")
    )
    stage = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("stage"), F.col("event_id") % 5)))
    publisher = F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("pub"), F.col("user_id") % 7)).otherwise("")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("task_id"), publisher.alias("publisher"), state.alias("state"), stage.alias("stage_failed"),
        F.date_trunc("second", "ts").alias("ts"), (F.col("event_id") % 900).cast("double").alias("seconds"),
    )


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: The same views for DuckDB.
SQL = {
    "entities": f"""SELECT doc_id, {_list(SECTIONS)}[s+1] AS section, k, {_list(VERDICTS)}[(doc_id*31+s*7+k*3)%3+1] AS verdict
      FROM (SELECT doc_id, s, unnest(generate_series(1, 2+(doc_id+s)%4)) AS k
        FROM (SELECT doc_id, unnest(generate_series(0,3)) AS s FROM documents))""",
    "section_verdicts": f"""SELECT doc_id, {_list(SECTIONS)}[s+1] AS section, {_list(VERDICTS)}[(doc_id*5+s*3)%3+1] AS verdict
      FROM (SELECT doc_id, unnest(generate_series(0,3)) AS s FROM documents)""",
    "relations": f"""SELECT doc_id, {_list(RELATIONS)}[r+1] AS relation, {_list(LINKS)}[(doc_id*17+r*5)%4+1] AS verdict,
        {_list(LINKS)}[(doc_id*7+r*3)%4+1] AS human
      FROM (SELECT doc_id, unnest(generate_series(0,2)) AS r FROM documents)""",
    "levels": """SELECT doc_id, 2000+doc_id%25 AS year, CASE WHEN doc_id%10<>0 THEN source END AS domain, doc_id%5 AS a,
        CASE WHEN doc_id%11<>0 THEN least(4, greatest(0, doc_id%5+(doc_id*13)%3-1)) END AS b, (doc_id*3)%5 AS c FROM documents""",
    "sections": f"""SELECT doc_id, ord, {_list(HEADINGS)}[(doc_id*7+ord*3)%8+1] AS heading, 1+(ord*3+doc_id%4)//4 AS page,
        CASE WHEN (doc_id+ord)%3=0 THEN {_list(SECTIONS)}[(doc_id+ord*2)%4+1] END AS imrad
      FROM (SELECT doc_id, unnest(generate_series(0,5)) AS ord FROM documents)""",
    "figures": """SELECT doc_id, n, CASE (doc_id+n)%4 WHEN 0 THEN 'Fig. '||n WHEN 1 THEN 'FIGURE '||n
          WHEN 2 THEN 'Supplementary Figure S'||n ELSE 'Table '||n END AS label, 1+(doc_id*3+n*5)%7 AS page,
        ((doc_id*3)%50)::DOUBLE AS x, ((doc_id+n%2)%70)::DOUBLE AS y, (40+(doc_id*7+(n%2)*13)%300)::DOUBLE AS w,
        (30+(doc_id*11+(n%2)*5)%250)::DOUBLE AS h, CASE WHEN (doc_id+n)%9<>0 THEN (doc_id*5+n*3)%40 END AS image_kb
      FROM (SELECT doc_id, unnest(generate_series(1, 1+doc_id%6)) AS n FROM documents)""",
    "tasks": """SELECT event_id AS task_id, CASE WHEN user_id%7<>0 THEN 'pub'||(user_id%7) ELSE '' END AS publisher,
        CASE WHEN event_type='signup' THEN 'pending' WHEN event_type IN ('view','click') THEN 'in_progress'
          WHEN event_type='purchase' THEN 'done' ELSE 'failed' END AS state,
        CASE WHEN event_type='error' AND event_id%5<>0 THEN 'stage'||(event_id%5) END AS stage_failed,
        date_trunc('second', ts) AS ts, (event_id%900)::DOUBLE AS seconds FROM events""",
}


def with_views(query: str, *names: str) -> str:
    return "WITH " + ", ".join(f"v_{n} AS ({SQL[n]})" for n in names) + ("" if query.startswith(",") else " ") + query
