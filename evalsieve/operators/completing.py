"""Running a user-supplied batch generator over prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalsieve.scale import settle

#: What a ledger holds of every prompt that was tried.
LEDGER_SCHEMA = "digest string, completion string, error string"

Generator = Callable[[list[str]], list[str]]


def _answers(generate: Generator, prompts: list[str]) -> list[str]:
    texts = generate(prompts)
    if len(texts) != len(prompts):
        raise ValueError(f"{len(prompts)} prompts gave {len(texts)} completions")
    return list(texts)


def batch_complete(
    prompts: DataFrame,
    load: Callable[[], Generator],
    keys: Sequence[str] = ("id",),
    prompt: str = "prompt",
    tasks: int | None = None,
) -> DataFrame:
    """One completion per prompt, as (keys..., completion).

    `load` runs once per partition and returns the generator, so a model is loaded
    once and then fed Arrow batches (spark.sql.execution.arrow.maxRecordsPerBatch
    rows each). Results carry their keys; nothing depends on row order. A lost
    task is simply run again. `tasks` sets the number of generator tasks.
    """
    keys = list(keys)
    fields = [prompts.schema[k] for k in keys] + [T.StructField("completion", T.StringType())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = None
        for batch in batches:
            if generate is None:
                generate = load()
            yield batch[keys].assign(completion=_answers(generate, batch[prompt].tolist()))

    rows = prompts.select(*dict.fromkeys([*keys, prompt]))
    if tasks is not None:
        rows = rows.repartition(tasks)
    return rows.mapInPandas(run, T.StructType(fields))


def _tried(generate: Generator, prompts: list[str]) -> tuple[list[str | None], list[str | None]]:
    """Completions and errors; the prompts of a batch that fails are tried one by one."""
    try:
        return _answers(generate, prompts), [None] * len(prompts)
    except Exception as fault:
        if len(prompts) == 1:
            return [None], [f"{type(fault).__name__}: {fault}"]
    each = [_tried(generate, [p]) for p in prompts]
    return [c[0] for c, _ in each], [e[0] for _, e in each]


def resumable_complete(
    prompts: DataFrame,
    load: Callable[[], Generator],
    ledger: str,
    keys: Sequence[str] = ("id",),
    prompt: str = "prompt",
    tasks: int | None = None,
    rounds: int = 16,
) -> DataFrame:
    """One completion per row, as (keys..., completion, error), by a generator that may die.

    The folder `ledger` keeps what was completed, by digest of the prompt. Prompts are dealt to
    `rounds` by digest, and every round is appended to the ledger as a whole; a run that dies
    loses the round that it was in, and the next run asks only for what the ledger lacks.
    Equal prompts are generated once. A prompt on which the generator raises has the error in
    its row and is tried again by the next run; a null prompt is an error without a trial. One
    run at a time may use a ledger, which belongs to one generator.
    """
    spark = prompts.sparkSession
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = None
        for batch in batches:
            if generate is None:
                generate = load()
            made, errors = _tried(generate, batch["_prompt"].tolist())
            yield pd.DataFrame(
                {"digest": batch["_digest"], "completion": pd.Series(made, batch.index, dtype=object),
                 "error": pd.Series(errors, batch.index, dtype=object)}
            )

    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
    rows = settle(
        prompts.select(*keys, F.col(prompt).alias("_prompt")).withColumn("_digest", F.sha2("_prompt", 256))
    )
    asked = rows.where(F.col("_prompt").isNotNull()).groupBy("_digest").agg(F.first("_prompt").alias("_prompt"))
    finished = known.where(F.col("error").isNull()).select(F.col("digest").alias("_digest"))
    todo = settle(
        asked.join(finished, "_digest", "left_anti")
        .withColumn("_round", F.pmod(F.xxhash64("_digest"), F.lit(rounds)))
    )
    for number in range(rounds):
        own = todo.where(F.col("_round") == number).drop("_round")
        own = own if tasks is None else own.repartition(tasks)
        own.mapInPandas(run, LEDGER_SCHEMA).write.mode("append").parquet(ledger)
    # settled, so that both sides are dealt anew and Spark can split a prompt of very many rows
    latest = settle(
        spark.read.schema(LEDGER_SCHEMA).parquet(ledger).groupBy(F.col("digest").alias("_digest"))
        .agg(F.max("completion").alias("completion"), F.max("error").alias("_error"),
             F.min(F.col("error").isNotNull()).alias("_failed"))
    )
    error = F.when(F.col("_prompt").isNull(), F.lit("no prompt")).when(F.col("_failed"), F.col("_error"))
    return rows.join(latest, "_digest", "left").select(*keys, "completion", error.alias("error"))
