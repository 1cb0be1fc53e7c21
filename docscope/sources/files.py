"""Files around papers as tables, and the fixed forms in which results are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.functions.rules import figure_type, first_path

REGION = "struct<x1:double,y1:double,x2:double,y2:double>"
FIGURES = f"array<struct<caption:string,figType:string,name:string,page:int,regionBoundary:{REGION},renderURL:string>>"


def texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, text of whole files under a folder."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def new_pdfs(spark: SparkSession, root: str, queued: DataFrame) -> DataFrame:
    """Paths of PDFs that are not in ``queued`` (path); contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(root)
    return found.select("path").join(queued.select("path"), "path", "left_anti")


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """folder, publisher, journal, doi of the first metadata file by name in each folder; blank for what is unreadable."""
    files = texts(spark, root, "*_Metadata.json").withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    first = files.groupBy("folder").agg(F.min_by("text", "name").alias("text"))
    publisher = first_path(F.col("text"), "publisher", "source_publisher")
    return first.select("folder", publisher.alias("publisher"), *(first_path(F.col("text"), n).alias(n) for n in ("journal", "doi")))


def json_results(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """doi_safe, parse_ok, error, text of files with a suffix; an unreadable file stays as a row with an error."""
    files = texts(spark, path, f"*{suffix}")
    ok = F.expr("try_parse_json(text) is not null")
    name = F.expr("substring(name, 1, length(name) - %d)" % len(suffix))
    return files.select(name.alias("doi_safe"), ok.alias("parse_ok"), F.when(~ok, "json_load_failed").alias("error"), "text")


def figures_json(files: DataFrame) -> DataFrame:
    """path, n, name, type, caption, page (from 1), x, y, w, h, render_url; from a list or an object with ``figures``."""
    text = F.col("text")
    listed = F.when(F.ltrim(text).startswith("["), F.from_json(text, FIGURES))
    found = F.coalesce(listed, F.from_json(F.get_json_object(text, "$.figures"), FIGURES))
    f = files.select("path", F.posexplode(found).alias("n", "f"))
    box = F.col("f.regionBoundary")
    return f.select(
        "path", "n", F.trim("f.name").alias("name"), figure_type(F.col("f.figType"), F.col("f.caption")).alias("type"),
        F.coalesce("f.caption", F.lit("")).alias("caption"), (F.col("f.page") + 1).alias("page"), box.x1.alias("x"), box.y1.alias("y"),
        F.greatest(F.lit(0.0), box.x2 - box.x1).alias("w"), F.greatest(F.lit(0.0), box.y2 - box.y1).alias("h"), F.col("f.renderURL").alias("render_url"),
    )


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column a string."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def doi_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("doi")).where("doi <> ''")


def image_index(spark: SparkSession, path: str, key: str, image: str) -> DataFrame:
    """key, image of an index file; the last row of a key counts, and a missing column is an error."""
    rows = csv_strings(spark, path)
    if missing := {key, image} - set(rows.columns):
        raise ValueError(f"columns missing in {path}: {sorted(missing)}")
    numbered = rows.select(key, image, F.monotonically_increasing_id().alias("at"))
    return numbered.groupBy(key).agg(F.max_by(image, "at").alias(image))


def _shown(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in df.columns else F.lit("")


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """A CSV file of fixed fields: missing ones and nulls are blank, other columns are left out."""
    df.select(*(_shown(df, n).alias(n) for n in fields)).write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
