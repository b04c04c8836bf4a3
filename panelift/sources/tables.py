"""Reading and writing tables."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelift.functions.columns import nan_to_null, standardize_columns, union_by_name
from panelift.operators.ordered import add_row_id
from panelift.session import spill

logger = logging.getLogger(__name__)
CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with header; without a schema the types are inferred by an extra pass."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def read_csv_checked(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken rows) of a CSV file or folder.

    A row is broken if a value does not fit its type or the number of values does not fit the header. Broken
    rows come as (file, record) with their original text. Without a schema the types are inferred first.
    """
    if schema is None:
        schema = ", ".join(f"`{c}` {t}" for c, t in read_csv(spark, path).dtypes)
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    file = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))
    # parsed once and stored: Spark does not read the record column alone from raw files
    rows = spill(reader.schema(f"{schema}, {CORRUPT} string").csv(path).withColumn("_file", file), "csv")
    broken = rows.filter(F.col(CORRUPT).isNotNull()).select(F.col("_file").alias("file"), F.col(CORRUPT).alias("record"))
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file"), broken


def load_files(
    spark: SparkSession, paths: Sequence[str], schema: str | None = None, order_by: Sequence[str] | None = None
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(stacked frame with an id column, skipped files with the reason).

    Each path may be a file or a folder. Names are standardized, columns missing in one file are
    NULL. Rows are numbered by ``order_by``, by default the file's place in the list and all columns.
    """
    frames, skipped = [], []
    for place, path in enumerate(paths):
        kind = path.rsplit(".", 1)[-1].lower()
        try:
            if kind == "parquet":
                frame = spark.read.parquet(path)
            elif kind == "csv" or "." not in path.rsplit("/", 1)[-1]:
                frame = read_csv(spark, path, schema)
            else:
                skipped.append((path, "unsupported file type"))
                continue
            if not frame.columns:
                skipped.append((path, "no columns"))
                continue
            frames.append(nan_to_null(standardize_columns(frame)).withColumn("_file", F.lit(place)))
        except (AnalysisException, ValueError) as error:
            logger.warning("skipped %s: %s", path, error)
            skipped.append((path, str(error).splitlines()[0]))
    if not frames:
        raise ValueError("no readable files")
    stacked = union_by_name(frames)
    order = list(order_by) if order_by else ["_file", *[c for c in stacked.columns if c != "_file"]]
    numbered = add_row_id(stacked, order)
    return numbered.drop("_file"), skipped


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; missing values are written as null and NaN becomes null."""
    nan_to_null(df).write.mode(mode).option("ignoreNullFields", False).json(path)


PREDICTION_SUFFIX = "_predictions.csv"


def write_predictions(df: DataFrame, folder: str, model: str) -> str:
    """Predictions as CSV under {folder}/{model}_predictions.csv."""
    path = f"{folder.rstrip('/')}/{model}{PREDICTION_SUFFIX}"
    write_csv(df, path)
    return path


def read_predictions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All prediction files of a folder with the model name taken from the path."""
    rows = (
        spark.read.option("header", True).option("recursiveFileLookup", True).schema(schema).csv(folder)
        .withColumn("_path", F.col("_metadata.file_path"))
    )
    # the last folder if it ends in .csv, else the file: cut out by its borders, since a pattern is tried at every sign of every row's path
    folder_name, file = F.substring_index(F.substring_index("_path", "/", -2), "/", 1), F.substring_index("_path", "/", -1)
    ended = lambda c: c.endswith(".csv") & (F.length(c) > 4)
    whole = F.when(ended(folder_name), folder_name).when(ended(file), file)
    stem = F.substring(whole, F.lit(1), F.length(whole) - 4)
    short = F.length(stem) - len("_predictions")
    name = F.when(stem.endswith("_predictions") & (short > 0), F.substring(stem, F.lit(1), short)).otherwise(F.coalesce(stem, F.lit("")))
    return rows.withColumn("model", F.url_decode(name)).drop("_path")


def save_model_tables(coefficients: DataFrame, predictions: DataFrame, folder: str, model: str) -> None:
    """A model as tables: its coefficients and its predictions, both in parquet."""
    base = f"{folder.rstrip('/')}/{model}"
    coefficients.write.mode("overwrite").parquet(f"{base}/coefficients")
    predictions.write.mode("overwrite").parquet(f"{base}/predictions")


def save_tree_model(model, columns: Sequence[str], folder: str, name: str) -> None:
    """A fitted tree ensemble in Spark ML's own format, with its column names beside it."""
    base = f"{folder.rstrip('/')}/{name}"
    model.write().overwrite().save(f"{base}/trees")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "place int, name string").write.mode("overwrite").parquet(f"{base}/columns")


def load_tree_model(spark: SparkSession, folder: str, name: str):
    """(model, columns) as saved, boosted or forest."""
    from pyspark.ml.util import DefaultParamsReader

    base = f"{folder.rstrip('/')}/{name}"
    model = DefaultParamsReader.loadParamsInstance(f"{base}/trees", spark)
    return model, [r.name for r in spark.read.parquet(f"{base}/columns").orderBy("place").collect()]


def load_model_tables(spark: SparkSession, folder: str, model: str) -> tuple[DataFrame, DataFrame]:
    base = f"{folder.rstrip('/')}/{model}"
    return spark.read.parquet(f"{base}/coefficients"), spark.read.parquet(f"{base}/predictions")
