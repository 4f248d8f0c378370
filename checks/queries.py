"""One registered query per operator; each reads the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.tables import benchmarks, completions, questions, table, training, training_texts
from evalsieve.functions import text
from evalsieve.functions.text import (
    boxed,
    build_prompt,
    match_set_name,
    normalize_answer,
    prefix,
    short_model_name,
    tail,
)
from evalsieve.operators import (
    cleaning,
    completing,
    contamination,
    identity,
    ngrams,
    position_sets,
    preparing,
    scoring,
    shared_runs as runs,
    training_index,
)
from evalsieve.plans import jobs, reports
from evalsieve.scale import shared_folder
from evalsieve.sources import files

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def report(fn: Callable[[DataFrame], DataFrame]) -> Query:
    """Register a query on the result rows of the completions."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(results(spark, sf_dir))

    REGISTRY[fn.__name__] = run
    return run


# -- text rules ---------------------------------------------------------------


@query
def tokenize(spark, sf_dir):
    tokens = text.tokenize("prompt")
    return training_texts(spark, sf_dir).select(
        "row_idx",
        F.size(tokens).cast("long").alias("n_tokens"),
        F.array_join(tokens, " ").alias("tokens"),
    )


@query
def prefix_truncate(spark, sf_dir):
    ratios = F.array(*[F.lit(r) for r in scoring.RATIOS])
    shown = prefix("prompt", F.col("ratio"))
    return (
        training_texts(spark, sf_dir)
        .select("row_idx", "prompt", F.explode(ratios).alias("ratio"))
        .withColumn("shown", shown)
        .select(
            "row_idx",
            "ratio",
            "shown",
            tail("prompt", "shown").alias("tail"),
            F.length(tail("prompt", "shown")).cast("long").alias("tail_length"),
        )
    )


@query
def boxed_answers(spark, sf_dir):
    return completions(spark, sf_dir).select(
        "model",
        "id",
        "ratio",
        boxed("generated").alias("answer"),
        F.length("generated").cast("long").alias("generated_length"),
    )


@query
def normalize_answers(spark, sf_dir):
    answer = boxed("generated")
    return completions(spark, sf_dir).select(
        "model", "id", "ratio", answer.alias("raw"), normalize_answer(answer).alias("norm")
    )


@query
def model_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        short_model_name("url").alias("model_name"),
        match_set_name("url").alias("set_name"),
    )


# -- contamination ------------------------------------------------------------


@query
def ngram_length(spark, sf_dir):
    return ngrams.ngram_length(benchmarks(spark, sf_dir)).select(
        "benchmark", F.col("n").cast("long").alias("n")
    )


@query
def ngram_matches(spark, sf_dir):
    return ngrams.ngram_matches(training_texts(spark, sf_dir), benchmarks(spark, sf_dir))


@query
def contamination_matches(spark, sf_dir):
    return ngrams.contamination_matches(training_texts(spark, sf_dir), benchmarks(spark, sf_dir))


@query
def contamination_matches_n8(spark, sf_dir):
    return ngrams.contamination_matches(
        training_texts(spark, sf_dir), benchmarks(spark, sf_dir), n=8
    )


def _detected(spark, sf_dir):
    bench = benchmarks(spark, sf_dir)
    return contamination.detect(training_texts(spark, sf_dir), bench, carry=["source"]), bench


@query
def contamination_summary(spark, sf_dir):
    return contamination.contamination_summary(*_detected(spark, sf_dir))


@query
def contaminated_indices(spark, sf_dir):
    return contamination.contaminated_indices(_detected(spark, sf_dir)[0])


@query
def contamination_total(spark, sf_dir):
    found, _ = _detected(spark, sf_dir)
    return contamination.contamination_total(found, training(spark, sf_dir))


@query
def match_sources(spark, sf_dir):
    """Counted without making the pairs."""
    return ngrams.pairs_per_source(training_texts(spark, sf_dir), benchmarks(spark, sf_dir))


@query
def two_lengths(spark, sf_dir):
    """Two benchmarks of long and of short items, so that each has an n of its own."""
    size = F.size(text.tokenize("prompt"))
    bench = benchmarks(spark, sf_dir).withColumn(
        "benchmark", F.when(size < 20, "short").otherwise("long")
    )
    lengths = ngrams.ngram_length(bench).select("benchmark", F.col("n").cast("long").alias("n"))
    pairs = ngrams.contamination_matches(training_texts(spark, sf_dir), bench)
    return pairs.join(F.broadcast(lengths), "benchmark")  # two rows


@query
def letters_only(spark, sf_dir):
    """Matching with a tokenizer of the caller's."""

    def letters(column):
        return F.regexp_extract_all(F.lower(column), F.lit("[a-z]+"), F.lit(0))

    return ngrams.contamination_matches(
        training_texts(spark, sf_dir), benchmarks(spark, sf_dir), n=8, tokenizer=letters
    )


@query
def unmatchable_items(spark, sf_dir):
    return contamination.unmatchable_items(benchmarks(spark, sf_dir))


@query
def detection_record(spark, sf_dir):
    """The summary record, unfolded, beside the sizes of the position tables it names."""
    found, bench = _detected(spark, sf_dir)
    summary = contamination.contamination_summary(found, bench).join(
        contamination.unmatchable_items(bench), "benchmark"
    )
    record = jobs.detection_record("documents", training(spark, sf_dir), found, summary)
    listed = found.flagged.groupBy("benchmark").agg(F.count(F.lit(1)).alias("listed"))
    union = found.flagged_rows().select(F.count(F.lit(1))).scalar()
    return (
        record.select(
            "training_dataset", "training_size", "total_contaminated_train", F.inline("benchmarks")
        )
        .join(F.broadcast(listed), "benchmark", "left")
        .select(
            "training_dataset",
            "training_size",
            "total_contaminated_train",
            "benchmark",
            "test_size",
            "contaminated_test",
            "num_contaminated_train",
            F.coalesce("listed", F.lit(0).cast("long")).alias("listed"),
            union.alias("listed_union"),
        )
    )


@query
def match_details(spark, sf_dir):
    bench = benchmarks(spark, sf_dir)
    pairs = ngrams.contamination_matches(training_texts(spark, sf_dir), bench)
    return contamination.match_details(pairs, training(spark, sf_dir), bench)


@query
def indexed_summary(spark, sf_dir):
    """Two benchmarks against an index of the training rows that was written in two steps."""
    folder = _folder(spark, "index")
    train, bench = training_texts(spark, sf_dir), benchmarks(spark, sf_dir)
    training_index.add_rows(train.where(F.col("row_idx") % 2 == 0), folder)
    training_index.add_rows(train.where(F.col("row_idx") % 2 == 1), folder)
    return contamination.contamination_summary(training_index.detect(train, bench, folder), bench)


@query
def shared_runs(spark, sf_dir):
    """The longest common run of every matching pair."""
    return runs.longest_runs(training_texts(spark, sf_dir), benchmarks(spark, sf_dir))


@query
def benchmark_overlap(spark, sf_dir):
    """Rows that five benchmarks flag, by set algebra on bitmaps of positions."""
    bench = benchmarks(spark, sf_dir).withColumn(
        "benchmark", F.concat(F.lit("bench-"), (F.col("test_idx") % 5).cast("string")))
    found = contamination.detect(training_texts(spark, sf_dir), bench, n=8)
    sets = position_sets.from_positions(found.flagged, "train_idx", "benchmark")
    return position_sets.overlaps(sets, bench.select(F.col("benchmark").alias("set")))


@query
def flagged_by_all_or_one(spark, sf_dir):
    """Per position: flagged by every one of three benchmarks, by any, by the first alone."""
    bench = benchmarks(spark, sf_dir).withColumn("benchmark", (F.col("test_idx") % 3).cast("string"))
    found = contamination.detect(training_texts(spark, sf_dir), bench, n=8)
    sets = position_sets.from_positions(found.flagged, "train_idx", "benchmark")
    any_set = position_sets.union_all(sets, "any")
    every = position_sets.intersect_all(sets, "all", ["0", "1", "2"])
    others = position_sets.union_all(sets, "others", ["1", "2"])
    first = position_sets.minus(sets.unionByName(others), "only-0", "0", "others")
    return position_sets.positions(any_set.unionByName(every).unionByName(first))


@query
def training_fingerprint(spark, sf_dir):
    """Size and fingerprints of the training set, as a detection records them."""
    return identity.fingerprints(training(spark, sf_dir))


@query
def source_counts(spark, sf_dir):
    return cleaning.source_counts(training(spark, sf_dir))


@query
def decontaminate(spark, sf_dir):
    found, _ = _detected(spark, sf_dir)
    return cleaning.decontaminate(training(spark, sf_dir), found.flagged_rows()).select(
        "row_idx", "source", "prompt"
    )


@query
def clean_indices(spark, sf_dir):
    found, _ = _detected(spark, sf_dir)
    return cleaning.clean_indices(training(spark, sf_dir), found.flagged_rows())


@query
def decontamination_report(spark, sf_dir):
    found, _ = _detected(spark, sf_dir)
    return cleaning.decontamination_report(training(spark, sf_dir), found.flagged_rows())


@query
def verify_original(spark, sf_dir):
    return cleaning.verify(training_texts(spark, sf_dir), benchmarks(spark, sf_dir))[1]


@query
def verify_clean(spark, sf_dir):
    found, bench = _detected(spark, sf_dir)
    cleaned = cleaning.decontaminate(training_texts(spark, sf_dir), found.flagged_rows())
    return cleaning.verify(cleaned, bench)[0]


# -- preparation --------------------------------------------------------------


@query
def convert_training(spark, sf_dir):
    rows = training(spark, sf_dir).withColumn("id", F.lit(None).cast("string"))
    return preparing.convert(rows, "training")


@query
def convert_benchmark(spark, sf_dir):
    rows = benchmarks(spark, sf_dir).select(
        F.col("test_idx").alias("row_idx"),
        "prompt",
        "answer",
        "source",
        F.lit(None).cast("string").alias("id"),
    )
    return preparing.convert(rows, "benchmark")


@query
def build_prompts(spark, sf_dir):
    pool = preparing.convert(training(spark, sf_dir))
    return preparing.build_prompts(pool).select("id", "prompt")


@query
def prompt_shards(spark, sf_dir):
    return preparing.shard(training(spark, sf_dir), 3).select(
        "row_idx", F.col("shard").cast("long").alias("shard")
    )


@query
def position_index(spark, sf_dir):
    scan = table(spark, sf_dir, "documents").select("doc_id", "_metadata")
    return files.number_rows(scan).select("doc_id", "row_idx")


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid4()}"


@query
def text_positions(spark, sf_dir):
    """Positions of the rows of a text source: the training rows in JSON lines."""
    folder = _folder(spark, "text_positions")
    rows = training(spark, sf_dir).select("prompt", "answer", "source", "id", "row_idx")
    # as many files as the table has splits, in the order of its rows
    files.write_jsonl(rows.sort("row_idx").drop("row_idx"), folder)
    return files.read_training(spark, folder, "lines").select("row_idx", "id", "prompt")


@query
def benchmark_files(spark, sf_dir):
    """Two files of one name in two folders are two benchmarks, each counted from 0."""
    folder = _folder(spark, "benchmark_files")
    half = F.when(F.col("test_idx") % 2 == 0, "a").otherwise("b").alias("half")
    # a published benchmark is one array in one file; one task writes both, under one name
    entry = F.struct("test_idx", "prompt", "answer", "source", "id")
    arrays = (
        benchmarks(spark, sf_dir).groupBy(half).agg(F.array_sort(F.collect_list(entry)).alias("e"))
        .select("half", F.to_json(F.transform("e", lambda e: e.dropFields("test_idx"))).alias("value"))
    )
    arrays.coalesce(1).write.partitionBy("half").text(folder)
    found = files.read_benchmarks(spark, [f"{folder}/half=a", f"{folder}/half=b"])
    return found.select(F.regexp_extract("benchmark", "half=([ab])/", 1).alias("folder"), "test_idx", "prompt")


@query
def question_files(spark, sf_dir):
    """Questions of a file: dataset by its stem, ids filled in, the first 50 rows."""
    folder = _folder(spark, "question_files")
    item = F.col("test_idx").cast("string")
    rows = benchmarks(spark, sf_dir).sort("test_idx").coalesce(1).select(
        F.col("prompt").alias("question"),
        item.alias("answer"),
        F.when(F.monotonically_increasing_id() % 2 == 0, F.concat(F.lit("q"), item)).alias("id"),
    )
    files.write_jsonl(rows, folder)
    return files.read_questions(spark, folder, limit=50).withColumn("dataset", F.lit("items"))


@query
def first_rows(spark, sf_dir):
    return preparing.first_rows(training(spark, sf_dir).select("row_idx", "source"), 100)


@query
def stratified_sample(spark, sf_dir):
    pool = table(spark, sf_dir, "documents").select("doc_id", "source")
    return preparing.stratified_sample(pool, by="source", k=20, key="doc_id")


def _turns(spark, sf_dir, role):
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == role)
    # an answer is filed under the turn before it
    asked = F.col("turn") - (1 if role == "assistant" else 0)
    return turns.select(F.concat_ws(":", "conv_id", asked).alias("id"), "text")


def _teacher_pairs(spark, sf_dir):
    prompts = _turns(spark, sf_dir, "user").select(
        "id", F.lit("conversations").alias("source"), build_prompt("text").alias("prompt")
    )
    answers = _turns(spark, sf_dir, "assistant").withColumnRenamed("text", "completion")
    return preparing.teacher_pairs(prompts, answers)


@query
def teacher_pairs(spark, sf_dir):
    return _teacher_pairs(spark, sf_dir)


@query
def pairing_faults(spark, sf_dir):
    """Turns without an answer, and answers without a turn before them."""
    answers = _turns(spark, sf_dir, "assistant").withColumnRenamed("text", "completion")
    return preparing.pairing_faults(_turns(spark, sf_dir, "user"), answers)


@query
def sft_examples(spark, sf_dir):
    return preparing.sft_examples(_teacher_pairs(spark, sf_dir), max_tokens=100).select(
        "id", "source", "text", F.col("n_tokens").cast("long").alias("n_tokens"), "truncated"
    )


@query
def teacher_preview(spark, sf_dir):
    pairs = training(spark, sf_dir).select(
        "row_idx",
        "id",
        build_prompt("prompt").alias("input_text"),
        F.col("prompt").alias("target_text"),
    )
    return preparing.teacher_preview(pairs)


@query
def batch_complete(spark, sf_dir):
    def load():
        # stands in for a model: a fixed answer to every prompt
        return lambda prompts: [rf"{p} \boxed{{{len(p)}}}" for p in prompts]

    prompts = preparing.build_prompts(preparing.convert(training_texts(spark, sf_dir)))
    return completing.batch_complete(prompts, load)


@query
def resumed_completion(spark, sf_dir):
    """A run over a third of the prompts, then one over all: the ledger answers for the third.
    Prompts of some lengths fail, with their error in the row."""
    def load():
        def answer(prompts):
            if any(len(p) % 17 == 0 for p in prompts):
                raise ValueError("no answer")
            return [rf"{p} \boxed{{{len(p)}}}" for p in prompts]

        return answer

    ledger = _folder(spark, "ledger")
    prompts = preparing.build_prompts(preparing.convert(training_texts(spark, sf_dir)))
    completing.resumable_complete(prompts.where(F.col("id").cast("long") % 3 == 0), load, ledger, rounds=2)
    return completing.resumable_complete(prompts, load, ledger, rounds=2)


# -- evaluation ---------------------------------------------------------------


@query
def prefix_grid(spark, sf_dir):
    return scoring.prefix_grid(questions(spark, sf_dir)).select(
        "dataset",
        "id",
        "ratio",
        "shown",
        "tail",
        F.col("tail_length").cast("long").alias("tail_length"),
        "prompt",
    )


def _scored(spark, sf_dir):
    grid = scoring.prefix_grid(questions(spark, sf_dir))
    return scoring.score(grid, completions(spark, sf_dir))


@query
def completion_faults(spark, sf_dir):
    """Some completions filed under the next example but one, some under one that is not asked."""
    made = completions(spark, sf_dir)
    moved = made.withColumn(
        "id", F.when(F.col("id") % 7 == 0, F.col("id") + 2).when(F.col("id") % 11 == 0, -F.col("id")).otherwise(F.col("id")))
    return scoring.completion_faults(scoring.prefix_grid(questions(spark, sf_dir)), moved)


def results(spark, sf_dir):
    return scoring.eval_metrics(scoring.memorization(_scored(spark, sf_dir)))


@query
def score_answers(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "model",
        "dataset",
        "id",
        "ratio",
        "gold_answer_raw",
        "gold_answer_norm",
        "truncated_question",
        "pred_answer_raw",
        "pred_answer_norm",
        "correct",
        "no_boxed",
        F.col("generated_length").cast("long").alias("generated_length"),
        F.col("gold_tail_length").cast("long").alias("gold_tail_length"),
    )


@query
def memorization_scores(spark, sf_dir):
    return scoring.memorization(_scored(spark, sf_dir)).select(
        "model",
        "id",
        "ratio",
        "lcs",
        F.col("tail_tokens").cast("long").alias("tail_tokens"),
        F.col("guess_tokens").cast("long").alias("guess_tokens"),
        F.round("rougeL_f", 9).alias("rougel_f"),
    )


@query
def predictions_map(spark, sf_dir):
    """The map per example, unfolded again to compare its entries."""
    records = scoring.predictions(scoring.memorization(_scored(spark, sf_dir)))
    return records.select(
        "model", "dataset", "id", "gold_answer_norm", F.explode("per_prefix").alias("ratio", "r")
    ).select(
        "model",
        "dataset",
        "id",
        "gold_answer_norm",
        "ratio",
        "r.truncated_question",
        "r.pred_answer_raw",
        "r.pred_answer_norm",
        "r.correct",
        F.col("r.generated_length").cast("long").alias("generated_length"),
        F.col("r.gold_tail_length").cast("long").alias("gold_tail_length"),
        F.round("r.rougeL_f", 9).alias("rougel_f"),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_rougel_f", F.round("avg_rougeL_f", 9))


@report
def eval_metrics(rows):
    return _rounded(rows)


@report
def flatten_metrics(rows):
    return _rounded(scoring.flatten_metrics(scoring.metrics_records(rows)))


@query
def metrics_roundtrip(spark, sf_dir):
    """Metric records as a job writes them, read back and flattened."""
    folder = _folder(spark, "metrics")
    files.write_jsonl(scoring.metrics_records(results(spark, sf_dir)), folder)
    return _rounded(scoring.flatten_metrics(files.read_metric_lines(spark, folder)))


@query
def metric_files(spark, sf_dir):
    """Metric records in files that hold one each and name dataset and model, read back."""
    folder = _folder(spark, "metric_files")
    named = scoring.metrics_records(results(spark, sf_dir)).select(
        F.format_string("eval_%s_%s_vllm.json", "dataset", "model").alias("name"),
        F.to_json(F.struct(*[c.split()[0] for c in files.METRICS_SCHEMA.split(", ")])).alias("value"),
    )
    named.repartition("name").write.partitionBy("name").text(folder)
    # a folder for each record, one per dataset and model; its only part gets the record's name
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for own in fs.globStatus(path(f"{folder}/name=*")):
        (part,) = fs.globStatus(path(f"{own.getPath()}/part-*"))
        fs.rename(part.getPath(), path(folder, own.getPath().getName().removeprefix("name=")))
    return _rounded(scoring.flatten_metrics(files.read_metrics(spark, f"{folder}/eval_*_vllm.json")))


@query
def results_csv(spark, sf_dir):
    """Result rows through the CSV sink and back."""
    folder = f"{shared_folder(spark)}/results_csv-{uuid4()}"
    files.write_results(results(spark, sf_dir), folder)
    return _rounded(files.read_results(spark, folder))


@query
def training_jsonl(spark, sf_dir):
    """Training rows through the JSON-lines sink and back."""
    folder = f"{shared_folder(spark)}/training_jsonl-{uuid4()}"
    pool = preparing.convert(training(spark, sf_dir))
    files.write_jsonl(pool, folder)
    return files.read_jsonl(spark, folder).select("question", "source", "id")


# -- reports ------------------------------------------------------------------


@report
def model_comparison(rows):
    return reports.model_comparison(rows)


@report
def accuracy_curve(rows):
    return reports.accuracy_curve(rows)


@report
def family_transfer(rows):
    return reports.family_transfer(rows)


@report
def format_quality(rows):
    return reports.format_quality(rows)


@report
def memorization_curve(rows):
    return _rounded(reports.memorization_curve(rows))


@report
def difficulty_pivot(rows):
    return reports.difficulty_pivot(rows).withColumnsRenamed(
        {"MATH-500": "math_500", "AIME-2025": "aime_2025"}
    )


@report
def summary_grid(rows):
    return reports.summary_grid(rows)


@report
def completeness(rows):
    return reports.completeness(rows)
