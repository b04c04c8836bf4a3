"""Report documents: scanning, combining and summarizing JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelift.session import spill

REPORT_SUFFIX = "_comprehensive_report.json"
# Sections that are the same for every model and are taken from the first report (fixed names).
COMMON_SECTIONS = ("dataset_overview", "comprehensive_dataset_analysis")


def read_report_texts(spark: SparkSession, folder: str, pattern: str = f"*{REPORT_SUFFIX}") -> DataFrame:
    """(file, path, text): one row per report file; ``path`` tells files of one name in several folders apart."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder, wholetext=True)
    path = F.url_decode(F.col("_metadata.file_path"))
    return files.select(F.regexp_extract(path, r"([^/]+)$", 1).alias("file"), path.alias("path"), F.col("value").alias("text"))


def parse_reports(texts: DataFrame) -> DataFrame:
    """(file, path, model, document); texts that are not JSON objects are left out. Without a path the file name serves.

    The model name comes from the report's metadata, else from the file name. Collinearity
    reports carry it under their analysis summary, else as third part of the file name.
    """
    parsed = texts.withColumn("document", F.expr("try_parse_json(text)")).filter("schema_of_variant(document) like 'OBJECT%'")
    named = F.expr("try_variant_get(document, '$.report_metadata.model_name', 'string')")
    collinear = F.expr("try_variant_get(document, '$.analysis_summary.model_metadata.model_type', 'string')")
    stem = F.regexp_replace(F.regexp_replace("file", r"\.json$", ""), "_comprehensive_report", "")
    third = F.coalesce(F.get(F.split("file", "_"), F.lit(2)), F.lit("Unknown"))
    model = F.when(F.lower("file").contains("multicollinearity_analysis"), F.coalesce(collinear, third)).otherwise(F.coalesce(named, stem))
    path = F.col("path") if "path" in texts.columns else F.col("file")
    return parsed.select("file", path.alias("path"), model.alias("model"), "document")


def report_sections(reports: DataFrame, *keep: str) -> DataFrame:
    """(file, model, keep..., section, content): one row per top-level section, content as JSON text."""
    extra = "".join(f", {c}" for c in keep)
    return reports.sparkSession.sql(
        f"select file, model{extra}, e.key as section, to_json(e.value) as content "
        "from {reports}, lateral variant_explode(document) as e",
        reports=reports,
    )


def combine_reports(reports: DataFrame) -> DataFrame:
    """(model, section, content) of the combined report.

    Reports are taken in the order of file name and path. The last one of a model wins; the common sections
    come from the first model's report only and are listed without a model.
    """
    # Parsed once: the names, the winners and the sections all read the stored documents.
    reports = spill(reports.select("file", "path", "model", "document"), "reports")
    place = F.struct("file", "path")
    per_model = reports.groupBy("model").agg(F.max(place).alias("_last"), F.min(place).alias("_first"))
    # The first model is the one whose earliest file comes first; one small aggregate row.
    lead = per_model.agg(F.min_by("_last", "_first").alias("_last")).select("_last.path", F.lit(True).alias("_lead"))
    winners = per_model.select("model", "_last.path").join(F.broadcast(lead), "path", "left")
    # Losing files are dropped before their documents are opened up.
    sections = report_sections(reports.join(winners, ["model", "path"]), "_lead")
    common = F.col("section").isin(*COMMON_SECTIONS)
    kept = sections.filter(~common | F.coalesce("_lead", F.lit(False)))
    return kept.select(F.when(~common, F.col("model")).alias("model"), "section", "content")


def attach_predictions(combined: DataFrame, predictions: DataFrame, value: str = "prediction") -> tuple[DataFrame, DataFrame]:
    """The combined report with its predictions: (sections, metadata).

    ``predictions`` has one row per prediction with its model. Every model gets a section 'predictions' with
    their number and mean, standard deviation, minimum and maximum (the rows themselves stay a table beside the
    report, joined by model). ``metadata`` is one row: combined_from and prediction_files (sorted model names),
    total_models, total_prediction_sets.
    """
    figures = predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("total_predictions"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    content = F.to_json(F.struct("total_predictions", F.struct("mean", "std", "min", "max").alias("prediction_summary")))
    sections = combined.select("model", "section", "content").unionByName(figures.select("model", F.lit("predictions").alias("section"), content.alias("content")))
    names = combined.filter("model is not null").select("model", F.lit(True).alias("r"), F.lit(False).alias("p")).unionByName(
        predictions.select("model", F.lit(False).alias("r"), F.lit(True).alias("p"))
    )
    models = names.groupBy("model").agg(F.bool_or("r").alias("r"), F.bool_or("p").alias("p"))
    sorted_names = lambda flag: F.array_sort(F.collect_list(F.when(F.col(flag), F.col("model"))))
    metadata = models.agg(
        sorted_names("r").alias("combined_from"), sorted_names("p").alias("prediction_files"),
        F.count_if("r").alias("total_models"), F.count_if("p").alias("total_prediction_sets"),
    )
    return sections, metadata


def report_summary(combined: DataFrame) -> DataFrame:
    """Per model: sections, target, feature count, R2 and number of predictions."""
    at = lambda section, path, kind: F.max(
        F.when(F.col("section") == section, F.try_variant_get(F.try_parse_json("content"), path, kind))
    )
    features = F.max(
        F.when(
            F.col("section") == "model_configuration",
            F.size(F.from_json(F.try_variant_get(F.try_parse_json("content"), "$.feature_variables", "string"), "array<string>")),
        )
    )
    return combined.filter("model is not null").groupBy("model").agg(
        F.count(F.lit(1)).alias("sections"),
        at("model_configuration", "$.target_variable", "string").alias("target"),
        F.coalesce(features, F.lit(0)).alias("feature_count"),
        at("model_diagnostics", "$.r_squared", "double").alias("r_squared"),
        at("model_predictions", "$.predictions_summary.prediction_count", "long").alias("prediction_count"),
    )


def write_report_files(documents: DataFrame, folder: str) -> None:
    """(file, text) rows as one file each, written by the tasks that hold them.

    Spark's text sink names files itself, so each document becomes a sub-folder named like the file.
    """
    documents.select("text", F.col("file").alias("file_name")).write.partitionBy("file_name").text(folder)


def read_written_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of documents written by :func:`write_report_files`."""
    rows = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    name = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"file_name=([^/]+)", 1))
    return rows.select(name.alias("file"), F.col("value").alias("text"))
