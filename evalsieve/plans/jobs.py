"""Whole jobs, from files to files: the steps a user runs one after another.

Every job deletes the tables that it settled on the way, and returns what it reads back
from its output.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalsieve.functions.text import tokenize
from evalsieve.operators import cleaning, contamination, identity, ngrams, preparing, scoring
from evalsieve.operators.completing import Generator, batch_complete, resumable_complete
from evalsieve.operators.ngrams import Tokenizer
from evalsieve.operators.positions import keep_rows
from evalsieve.scale import settle, settled_tables
from evalsieve.sources import files

SUMMARY_SCHEMA = (
    "benchmark string, test_size bigint, contaminated_test bigint, num_contaminated_train bigint, "
    "contamination_rate double, unmatchable_test bigint"
)
REPORT_SCHEMA = (
    "source string, original bigint, clean bigint, removed bigint, original_pct double, "
    "clean_pct double, removed_pct double"
)
TOTALS_SCHEMA = (
    "benchmarks bigint, contaminated_test bigint, contaminated_train_max bigint, "
    "all_clean boolean, contaminated_train_union bigint"
)


def _written(df: DataFrame, path: str, schema: str) -> DataFrame:
    files.write_jsonl(df, path)
    return files.read_jsonl(df.sparkSession, path, schema)


def detection_record(
    name: str, train: DataFrame, found: contamination.Detection, summary: DataFrame
) -> DataFrame:
    """One record of counts. Positions are never listed in it: however many there are, they
    are the tables `flagged` (by benchmark) and `flagged_union`. Two fingerprints tell the
    training set that was seen from an edited or re-ordered one."""
    entry = F.struct(
        "benchmark", "test_size", "contaminated_test", "contamination_rate", "num_contaminated_train",
        "unmatchable_test",
    )
    known = identity.fingerprints(train).select(F.struct("content_fingerprint", "placed_fingerprint")).scalar()
    return contamination.contamination_total(found, train).withColumn("_known", known).select(
        F.lit(name).alias("training_dataset"),
        "training_size",
        "_known.content_fingerprint",
        "_known.placed_fingerprint",
        # one entry a benchmark
        summary.select(F.sort_array(F.collect_list(entry))).scalar().alias("benchmarks"),
        "total_contaminated_train",
        F.lit("flagged").alias("flagged_folder"),
        F.lit("flagged_union").alias("flagged_union_folder"),
    )


def detect(
    spark: SparkSession,
    train_path: str,
    bench_paths: Sequence[str],
    out: str,
    form: str = "array",
    n: int | None = None,
    tokenizer: Tokenizer = tokenize,
    pairs: bool = True,
    details: bool = False,
) -> DataFrame:
    """Write the summary and the flagged positions, and return the summary table.

    `pairs` adds the (item, row) pairs as keys, with the matched rows and the items once
    each beside them; `details` adds the pairs with both texts.
    """
    with settled_tables(spark):
        train = settle(files.read_training(spark, train_path, form))
        bench = files.read_benchmarks(spark, bench_paths)
        found = contamination.detect(train, bench, n, tokenizer, carry=("source",))
        unmatchable = contamination.unmatchable_items(bench, n, tokenizer)
        summary = _written(
            contamination.contamination_summary(found, bench).join(unmatchable, "benchmark"),
            f"{out}/summary",
            SUMMARY_SCHEMA,
        )
        record = detection_record(train_path, train, found, summary)
        files.write_jsonl(record, f"{out}/contamination_summary")
        files.write_jsonl(found.flagged, f"{out}/flagged")
        files.write_jsonl(found.flagged_rows(), f"{out}/flagged_union")
        if pairs or details:
            # pairs need another look at the flagged texts only
            texts = settle(keep_rows(train, found.flagged.select("train_idx").distinct()))
            met = settle(ngrams.contamination_matches(texts, bench, n, tokenizer))
            files.write_jsonl(met, f"{out}/contamination_pairs")
            files.write_jsonl(texts, f"{out}/matched_rows")
            files.write_jsonl(bench, f"{out}/items")
            if details:
                files.write_jsonl(
                    contamination.match_details(met, texts, bench), f"{out}/contamination_matches"
                )
    return summary


def clean(
    spark: SparkSession, train_path: str, found_path: str, out: str, form: str = "array"
) -> DataFrame:
    """Write the cleaned rows and their positions; return the report by source. Rows go by
    position, so a training set other than the detection saw is refused."""
    with settled_tables(spark):
        train = settle(files.read_training(spark, train_path, form))
        flagged = files.read_jsonl(
            spark, f"{found_path}/flagged_union", "train_idx bigint, source string"
        )
        seen = files.read_jsonl(
            spark, f"{found_path}/contamination_summary",
            "training_size bigint, content_fingerprint string, placed_fingerprint string",
        ).first()
        identity.refuse_other(seen, identity.fingerprints(train).first())
        kept = cleaning.decontaminate(train, flagged)
        files.write_jsonl(kept.drop("row_idx"), f"{out}/decontaminated")
        files.write_jsonl(cleaning.clean_indices(train, flagged), f"{out}/clean_train_indices")
        return _written(
            cleaning.decontamination_report(train, flagged), f"{out}/report", REPORT_SCHEMA
        )


def verify(
    spark: SparkSession,
    train_path: str,
    bench_paths: Sequence[str],
    out: str,
    form: str = "lines",
    n: int | None = None,
    tokenizer: Tokenizer = tokenize,
) -> DataFrame:
    """Detect again on a cleaned set, write the summary and return its totals."""
    with settled_tables(spark):
        train = settle(files.read_training(spark, train_path, form))
        bench = files.read_benchmarks(spark, bench_paths)
        per_benchmark, totals = cleaning.verify(train, bench, n, tokenizer)
        written = _written(totals, f"{out}/verification_totals", TOTALS_SCHEMA)
        entry = F.struct("benchmark", "test_size", "contaminated_test", "contaminated_train")
        record = train.agg(F.count(F.lit(1)).alias("training_size")).select(
            F.lit(train_path).alias("training_dataset"),
            "training_size",
            per_benchmark.select(F.sort_array(F.collect_list(entry))).scalar().alias("benchmarks"),
            written.select("all_clean").scalar().alias("all_clean"),
        )
        files.write_jsonl(record, f"{out}/verification_summary")
        return written


def convert(
    spark: SparkSession, path: str, out: str, kind: str = "training", form: str = "lines"
) -> None:
    """Every row as a question with defaults, in JSON lines; benchmarks keep their answers."""
    with settled_tables(spark):
        files.write_jsonl(preparing.convert(files.read_training(spark, path, form), kind), out)


def sample(
    spark: SparkSession, pool_path: str, out: str, k: int, seed: int = preparing.SEED
) -> None:
    """A shuffled sample of k questions per source (all, where there are fewer)."""
    with settled_tables(spark):
        pool = files.number_rows(files.read_jsonl(spark, pool_path))
        drawn = preparing.stratified_sample(pool, k=k, seed=seed, key="row_idx")
        files.write_jsonl(drawn.drop("row_idx", "shuffle_rank"), out)


def teach(
    spark: SparkSession,
    pool_path: str,
    out: str,
    load: Callable[[], Generator],
    tasks: int | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """A completion for every pooled question, in parallel, as training pairs; previews of
    the first, middle and last pair are returned.

    One pair for each row: its columns travel with the prompt, so nothing is joined. With a
    `ledger` folder a job that died goes on where it was, equal prompts are asked once, and
    rows on which the generator raised are written to `<out>_errors`, not among the pairs.
    """
    with settled_tables(spark):
        prompts = preparing.build_prompts(files.number_rows(files.read_jsonl(spark, pool_path)))
        keys = ["row_idx", "id", "source", "prompt"]
        if ledger is None:
            made = batch_complete(prompts, load, keys, tasks=tasks)
        else:
            tried = resumable_complete(prompts, load, ledger, keys, tasks=tasks)
            files.write_jsonl(tried.where("error IS NOT NULL").drop("completion"), f"{out}_errors")
            made = tried.where("error IS NULL").drop("error")
        pairs = settle(preparing.completed_pairs(made))
        files.write_jsonl(pairs.drop("row_idx"), out)
        return _written(
            preparing.teacher_preview(pairs), f"{out}_preview",
            "row_idx bigint, id string, input_preview string, target_preview string",
        )


def evaluate(
    questions: DataFrame,
    completions: DataFrame,
    out: str,
    ratios: Sequence[float] = scoring.RATIOS,
    model_ids: Mapping[str, str] | None = None,
    data_paths: Mapping[str, str] | None = None,
) -> DataFrame:
    """Score completions; write predictions, metric records, the result CSV and the keys of
    repeated or unasked completions, and return the result rows. Repeated completions fail
    the job. Every completion is computed once."""
    spark = questions.sparkSession
    with settled_tables(spark):
        made = settle(completions.select("model", "dataset", "id", "ratio", "generated"))
        grid = scoring.prefix_grid(questions, ratios)
        files.write_jsonl(scoring.completion_faults(grid, made), f"{out}/completion_faults")
        scored = settle(scoring.memorization(scoring.score(grid, made, settled=True)))
        files.write_jsonl(scoring.predictions(scored), f"{out}/predictions")
        results = settle(scoring.eval_metrics(scored))
        records = scoring.metrics_records(results, model_ids=model_ids, data_paths=data_paths)
        files.write_jsonl(records, f"{out}/metrics")
        files.write_results(results, f"{out}/results")
    return files.read_results(spark, f"{out}/results")


def evaluate_files(
    spark: SparkSession,
    question_paths: str | Sequence[str],
    models: Mapping[str, Callable[[], Generator]],
    out: str,
    ratios: Sequence[float] = scoring.RATIOS,
    limit: int = 0,
    tasks: int | None = None,
) -> DataFrame:
    """The same from question files: every model completes the grid of all their questions."""
    with settled_tables(spark):
        questions = settle(files.read_questions(spark, question_paths, limit))
        grid = scoring.prefix_grid(questions, ratios)
        made = None
        for name, load in models.items():
            own = batch_complete(grid, load, ["dataset", "id", "ratio"], tasks=tasks).withColumnRenamed(
                "completion", "generated").withColumn("model", F.lit(name))
            made = own if made is None else made.unionByName(own)
        return evaluate(questions, made, out, ratios)


def collect_results(spark: SparkSession, pattern: str, out: str, form: str = "files") -> DataFrame:
    """Metric records of many runs to one result CSV: files that hold one record each, or the
    folders that `evaluate` writes ("lines")."""
    with settled_tables(spark):
        read = files.read_metrics if form == "files" else files.read_metric_lines
        files.write_results(scoring.flatten_metrics(read(spark, pattern)), out)
    return files.read_results(spark, out)
