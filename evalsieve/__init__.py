"""Keeping training text apart from benchmarks, and measuring model results, on Spark."""

from evalsieve.functions.text import (
    boxed,
    build_prompt,
    normalize_answer,
    prefix,
    short_model_name,
    tokenize,
)
from evalsieve.operators.cleaning import (
    clean_indices,
    decontaminate,
    decontamination_report,
    source_counts,
    verify,
)
from evalsieve.operators.completing import batch_complete, resumable_complete
from evalsieve.operators.contamination import (
    Detection,
    contaminated_indices,
    contamination_summary,
    contamination_total,
    detect,
    match_details,
    match_sources,
    unmatchable_items,
)
from evalsieve.operators.ngrams import (
    contamination_matches,
    ngram_length,
    ngram_matches,
    ngrams,
    pairs_per_source,
)
from evalsieve.operators.preparing import (
    build_prompts,
    completed_pairs,
    convert,
    first_rows,
    pairing_faults,
    sft_examples,
    shard,
    shard_rows,
    stratified_sample,
    teacher_pairs,
    teacher_preview,
)
from evalsieve.operators.scoring import (
    eval_metrics,
    flatten_metrics,
    memorization,
    metrics_records,
    predictions,
    prefix_grid,
    score,
)

__all__ = [name for name in dir() if not name.startswith("_")]
