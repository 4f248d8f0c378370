"""From raw rows to prompts, samples and training pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalsieve.functions.text import build_prompt, cut_after, strip, words
from evalsieve.scale import draw, draw_bucket, join_lookup, rank_by_draw, settle

# Stand-ins for missing fields, and the seed.
UNKNOWN_SOURCE = "UNKNOWN"
ID_FORMATS = {"training": "train_%06d", "benchmark": "benchmark_%06d"}
SEED = 42


def convert(df: DataFrame, kind: str = "training", keep: Sequence[str] = ()) -> DataFrame:
    """prompt -> question with defaults; benchmarks keep their answer.

    `keep` names columns to pass on, such as the position. Spark reads an absent key and a JSON null alike, so both get the default.
    """
    if kind not in ID_FORMATS:
        raise ValueError(f"kind must be one of {sorted(ID_FORMATS)}, not {kind!r}")
    row_id = F.format_string(ID_FORMATS[kind], "row_idx")
    answer = [F.coalesce("answer", F.lit("")).alias("answer")] if kind == "benchmark" else []
    return df.select(
        F.col("prompt").alias("question"),
        *answer,
        F.coalesce("source", F.lit(UNKNOWN_SOURCE)).alias("source"),
        F.coalesce("id", row_id).alias("id"),
        *keep,
    )


def stratified_sample(
    pool: DataFrame, k: int, by: str = "source", seed: int = SEED, key: str = "id"
) -> DataFrame:
    """min(k, pool) rows of every group, without replacement, in a shuffled order.

    Every row draws a reproducible random text from its unique key (a position will
    do where ids may repeat; repeated keys are refused); the k smallest draws of a group are kept and `shuffle_rank` numbers all kept rows at random.
    A group is never sorted as a whole: counts per draw range find the range that
    holds the k-th draw, only that range is ranked to get the exact limit, and the
    rows themselves are then filtered where they are.
    """
    drawn = pool.withColumn(by, F.coalesce(by, F.lit(UNKNOWN_SOURCE))).withColumn(
        "_draw", draw(seed, key)
    )
    keys = drawn.select(by, "_draw", F.col(key).alias("_key")).withColumn(
        "_range", draw_bucket("_draw")
    )
    refused = F.raise_error(F.concat(F.lit("the sample needs unique keys, this one repeats: "), F.col("_key").cast("string")))

    so_far = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (
        keys.groupBy(by, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(so_far))
    )
    last_range = settle(
        ranges.where((F.col("_upto") >= k) & (F.col("_upto") - F.col("_n") < k)).select(
            by, "_range", (F.lit(k) - F.col("_upto") + F.col("_n")).alias("_need")
        )
    )
    inside = Window.partitionBy(by).orderBy("_draw", "_key")
    limits = settle(
        join_lookup(keys, last_range, [by, "_range"], spread_by=["_key"])
        # equal keys have equal draws, so they stand side by side in one range
        .withColumn("_before", F.lag("_key").over(inside))
        .withColumn("_place", F.when(F.col("_before") == F.col("_key"), refused).otherwise(F.row_number().over(inside)))
        .where(F.col("_place") == F.col("_need"))
        .select(by, F.struct("_draw", "_key").alias("_last"))
    )
    kept = (
        join_lookup(drawn, limits, [by], "left", spread_by=[key])
        .where("_last is null or struct(_draw, `%s`) <= _last" % key)
        .drop("_last", "_draw")
    )
    shuffled = kept.withColumn("_order", draw(seed + 1, key))
    return rank_by_draw(shuffled, "_order", key, "shuffle_rank").drop("_order")


def build_prompts(pool: DataFrame) -> DataFrame:
    return pool.withColumn("prompt", build_prompt("question"))


def shard(df: DataFrame, task_count: int) -> DataFrame:
    """The share of the work every row belongs to, by position."""
    return df.withColumn("shard", F.pmod("row_idx", F.lit(task_count)).cast("int"))


def shard_rows(df: DataFrame, task_id: int, task_count: int) -> DataFrame:
    return df.where(F.pmod("row_idx", F.lit(task_count)) == task_id)


def first_rows(df: DataFrame, limit: int = 0) -> DataFrame:
    """The first `limit` rows by position; all of them if the limit is 0."""
    return df.where(F.col("row_idx") < limit) if limit > 0 else df


def completed_pairs(completed: DataFrame) -> DataFrame:
    """Training pairs of prompts that carry their completion."""
    return completed.withColumnRenamed("prompt", "input_text").withColumn(
        "target_text", strip("completion")
    ).drop("completion")


def pairing_faults(prompts: DataFrame, completions: DataFrame) -> DataFrame:
    """Ids that do not have just one prompt and one completion, with the number of each.

    Run it before `teacher_pairs` on completions from elsewhere; rows without an id
    are counted under null.
    """
    counted = prompts.select("id", F.lit(1).alias("p"), F.lit(0).alias("c")).unionByName(
        completions.select("id", F.lit(0).alias("p"), F.lit(1).alias("c"))
    )
    return (
        counted.groupBy("id")
        .agg(F.sum("p").alias("prompts"), F.sum("c").alias("completions"))
        .where((F.col("prompts") != 1) | (F.col("completions") != 1) | F.col("id").isNull())
    )


def teacher_pairs(prompts: DataFrame, completions: DataFrame) -> DataFrame:
    """Prompts (id, source, prompt) with their completions (id, completion).

    Ids that `pairing_faults` reports give no pair, or several.
    """
    return prompts.join(completions, "id").select(
        "id",
        "source",
        F.col("prompt").alias("input_text"),
        strip("completion").alias("target_text"),
    )


def teacher_preview(pairs: DataFrame) -> DataFrame:
    """First, middle and last pair by position; the first alone if there are two or fewer."""
    n = pairs.select(F.count(F.lit(1))).scalar()
    shown = (F.col("row_idx") == 0) | (
        (n > 2) & ((F.col("row_idx") == F.floor(n / 2)) | (F.col("row_idx") == n - 1))
    )
    return pairs.where(shown).select(
        "row_idx",
        "id",
        F.substring("input_text", 1, 100).alias("input_preview"),
        F.substring("target_text", 1, 150).alias("target_preview"),
    )


def sft_examples(pairs: DataFrame, max_tokens: int) -> DataFrame:
    """Prompt and completion as one text, cut after a budget of whitespace tokens.

    What is kept of a text is kept as it is, with its whitespace.
    """
    text = F.concat("input_text", "target_text")
    return pairs.select("id", "source", text.alias("_text"), words(text).alias("_words")).select(
        "id",
        "source",
        F.when(F.size("_words") <= max_tokens, F.col("_text"))
        .otherwise(cut_after("_text", max_tokens))
        .alias("text"),
        F.least(F.size("_words"), F.lit(max_tokens)).alias("n_tokens"),
        (F.size("_words") > max_tokens).alias("truncated"),
    )
