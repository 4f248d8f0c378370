"""JSON, JSON lines and CSV with explicit schemas.

Schemas are given, never inferred: no extra pass over the data, and malformed
input fails the job instead of becoming nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalsieve.functions.text import file_stem
from evalsieve.scale import join_lookup, settle
from evalsieve.sources.arrays import number_array_rows, read_array_rows

ROW_SCHEMA = "prompt string, answer string, source string, id string"
POOL_SCHEMA = "question string, answer string, source string, id string"
PAIR_SCHEMA = "id string, source string, input_text string, target_text string"
METRICS_SCHEMA = (
    "model_id string, data_path string, num_examples bigint, prefix_ratios array<double>, "
    "correct_counts map<string,bigint>, accuracies map<string,double>, "
    "avg_rougeL_f map<string,double>, no_boxed_counts map<string,bigint>, "
    "no_boxed_ratios map<string,double>, max_new_tokens bigint, temperature double, "
    "inference_engine string"
)
RESULT_SCHEMA = (
    "model string, dataset string, prefix_ratio double, accuracy double, correct bigint, "
    "total bigint, avg_rougeL_f double, no_boxed_count bigint, no_boxed_ratio double"
)
RESULT_COLUMNS = [field.split()[0] for field in RESULT_SCHEMA.split(", ")]

# Fixed value: the name of a metrics file holds the dataset and the model.
METRICS_FILE = r"^eval_([^_]+)_(.+)_vllm\.json$"


def _knows_row_index(scan: DataFrame) -> bool:
    """Whether the reader gives the place of a row in its file (Parquet does)."""
    return "row_index" in scan.select("_metadata").schema["_metadata"].dataType.names


def number_rows(scan: DataFrame, name: str = "row_idx", within_file: bool = False) -> DataFrame:
    """Number the rows of a file scan from 0, by file path and place in the file.

    Takes a DataFrame straight from a reader. Parquet rows know their place in the
    file. The rows of a text split are read in order by one task; they are settled with
    their place in the split, so that texts are parsed once and a later scan cannot be
    split in another way. One aggregated row per file or split tells how many rows
    precede it; these rows, not the data, are put in order by one task. With
    `within_file` every file counts from 0.
    """
    path = F.col("_metadata.file_path").alias("_path")
    if _knows_row_index(scan):
        part = ["_path"]
        marked = scan.select("*", path, F.col("_metadata.row_index").alias("_seen"))
    else:
        part = ["_path", "_start"]
        marked = settle(
            scan.select(
                "*",
                path,
                F.col("_metadata.file_block_start").alias("_start"),
                F.monotonically_increasing_id().alias("_seen"),
            )
        )
    in_order = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    if within_file:
        in_order = Window.partitionBy("_path").orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        marked.groupBy(*part)
        .agg(F.min("_seen").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(
            *part,
            (F.coalesce(F.sum("_n").over(in_order), F.lit(0)) - F.col("_first")).alias("_shift"),
        )
    )
    known = F.coalesce("_shift", F.raise_error(F.lit("a file changed while its rows were numbered")))
    return (
        join_lookup(marked, settle(shifts), part, "left", spread_by=["_seen"])
        .withColumn(name, (F.col("_seen") + known).cast("long"))
        .drop(*part, "_seen", "_shift")
    )


def _json(spark: SparkSession, schema: str):
    return spark.read.schema(schema).option("mode", "FAILFAST")


def read_json_array(
    spark: SparkSession, paths: str | Sequence[str], schema: str = ROW_SCHEMA
) -> DataFrame:
    """Files that each hold one JSON array, a task for each file; `read_array_rows` reads
    large ones by many tasks."""
    return _json(spark, schema).option("multiLine", True).json(paths)


def read_jsonl(
    spark: SparkSession, paths: str | Sequence[str], schema: str = POOL_SCHEMA
) -> DataFrame:
    """JSON lines; blank lines are skipped, large files are split."""
    return _json(spark, schema).json(paths)


def read_training(
    spark: SparkSession, paths: str | Sequence[str], form: str = "array"
) -> DataFrame:
    """Training rows with their position, from JSON arrays ("array"), JSON lines ("lines")
    or Parquet files ("parquet"); large files of any form are read by many tasks."""
    if form == "parquet":
        wanted = [c.split()[0] for c in ROW_SCHEMA.split(", ")]
        paths = [paths] if isinstance(paths, str) else list(paths)
        scan = spark.read.schema(ROW_SCHEMA).parquet(*paths).select(*wanted, "_metadata")
        return number_rows(scan).drop("_metadata")
    if form not in ("array", "lines"):
        raise ValueError(f"form must be array, lines or parquet, not {form!r}")
    if form == "array":
        return number_array_rows(read_array_rows(spark, paths, ROW_SCHEMA))
    return number_rows(read_jsonl(spark, paths, ROW_SCHEMA))


def read_benchmarks(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Benchmark items; every file is a benchmark of its own, with positions from 0.

    The benchmark is the file's stem; files of equal stems are told apart by the path of
    their folder.
    """
    numbered = read_array_rows(spark, paths, ROW_SCHEMA).withColumnsRenamed({"_path": "_file", "_at": "test_idx"})
    stem = file_stem(F.element_at(F.split("_file", "/"), -1))
    folder = F.regexp_extract("_file", "^(?:file:)?(.*)/[^/]*$", 1)
    alike = F.count(F.lit(1)).over(Window.partitionBy("_stem"))
    # one row a file
    names = numbered.select("_file").distinct().withColumn("_stem", stem).select(
        "_file",
        F.when(alike > 1, F.concat(folder, F.lit("/"), F.col("_stem")))
        .otherwise(F.col("_stem"))
        .alias("benchmark"),
    )
    return join_lookup(numbered, settle(names), ["_file"], spread_by=["test_idx"]).drop("_file")


def read_questions(
    spark: SparkSession, paths: str | Sequence[str], limit: int = 0
) -> DataFrame:
    """Questions (dataset, id, question, answer) of JSON-lines files, by default all.

    The dataset is the file's stem, a missing id is made of the position in the file, and a
    `limit` keeps the first rows of every file.
    """
    scan = read_jsonl(spark, paths).select("*", F.col("_metadata.file_name").alias("_file"), "_metadata")
    numbered = number_rows(scan, "_at", within_file=True)
    kept = numbered.where(F.col("_at") < limit) if limit > 0 else numbered
    return kept.select(
        file_stem(F.col("_file")).alias("dataset"),
        F.coalesce("id", F.format_string("ex_%d", "_at")).alias("id"),
        "question",
        "answer",
    )


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of JSON-lines parts, non-ASCII text kept.

    Replaces earlier output, so a repeated run does not duplicate rows. A single
    JSON array would force all rows through one task and is not written.
    """
    df.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """Metric records of files that hold one each, with dataset and model from the file
    name. A file of another name fails the job."""
    name = F.col("_metadata.file_name")

    def part(i: int) -> Column:
        other = F.raise_error(F.concat(F.lit("no dataset and model in the name of "), name))
        found = F.regexp_extract(name, METRICS_FILE, i)
        return F.when(found == "", other.cast("string")).otherwise(found)

    return (
        _json(spark, METRICS_SCHEMA)
        .option("multiLine", True)
        .json(pattern)
        .select(part(2).alias("model"), part(1).alias("dataset"), "*")
    )


def read_metric_lines(spark: SparkSession, path: str) -> DataFrame:
    """Metric records as `evaluate` writes them: JSON lines that name model and dataset."""
    return _json(spark, f"model string, dataset string, {METRICS_SCHEMA}").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Result rows as CSV with a header, columns and rows in fixed order."""
    (
        results.select(*RESULT_COLUMNS)
        .orderBy("model", "dataset", "prefix_ratio")
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(RESULT_SCHEMA)
        .option("header", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )
