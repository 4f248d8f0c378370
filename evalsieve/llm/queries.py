"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalsieve.llm import bpe, line_templates, packing, periodic_runs, pii, quality_classifier, quality_rules, quality_rules_sql, repeated_units, secrets, sentence_pieces, simhash, topk, vector_codes, vector_codes_sql
from evalsieve.scale import settle

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Vocabularies of the token queries.
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.drop("lang", "source", "n_lines")


ORACLES["op1_quality_rules"] = quality_rules_sql.SQL


@query
def op2_repeated_units(spark, sf_dir):
    cut = repeated_units.remove_repeats(table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"], s["kept_doc_id"], s["kept_start"]))
    return cut.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(spans, ",").alias("removed"),
        "text",
    )


ORACLES["op2_repeated_units"] = repeated_units.SQL


@query
def op3_best_fit_packing(spark, sf_dir):
    pieces = packing.token_pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), with_ids=False
    )
    return packing.pack(settle(pieces))


def _listed(spans):
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number_of(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query
def op4_secret_scan(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[_number_of(F.col("base"), kind) for kind in secrets.KINDS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


@query
def op5_line_templates(spark, sf_dir):
    cut = line_templates.drop_recurring(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.size("dropped").cast("long").alias("n_dropped"), "dropped", "text")


@query
def op6_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_simhash(spark, sf_dir):
    found = simhash.groups(table(spark, sf_dir, "documents"), words=3, radius=2)
    digits = F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op8_pii(spark, sf_dir):
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[_number_of(F.col("base"), kind) for kind in pii.KINDS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


@query
def op9_block_topk(spark, sf_dir):
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


ORACLES["op9_block_topk"] = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM s
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 20
"""


@query
def op10_bpe(spark, sf_dir):
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    n = F.when(F.col("ids") == "", 0).otherwise(F.length("ids") - F.length(F.translate("ids", " ", "")) + 1)
    return coded.select(
        "doc_id",
        n.cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op13_sentence_pieces(spark, sf_dir):
    coded = sentence_pieces.encode_and_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _with_planted_runs(docs):
    """The documents' words, in a tenth of the documents periodic from some word on: both are
    drawn by doc_id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    n = F.size("_llm_words").cast("long")
    split = docs.select(
        "doc_id", "text", h.alias("_llm_h"),
        F.coalesce(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.array().cast("array<string>"))
        .alias("_llm_words"),
    )
    g = F.floor(F.col("_llm_h") / 10)
    placed = split.withColumn("_llm_a", F.when((F.col("_llm_h") % 10 == 0) & (n > 0), F.pmod(g, n)).cast("int"))
    rest = n.cast("int") - F.col("_llm_a")
    placed = placed.withColumn("_llm_p", (1 + F.floor(rest / (3 + F.pmod(g, F.lit(8))))).cast("int"))
    root = F.slice("_llm_words", F.col("_llm_a") + 1, F.col("_llm_p"))
    again = F.slice(F.flatten(F.array_repeat(root, F.ceil(rest / F.col("_llm_p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("_llm_words", F.lit(1), F.col("_llm_a")), again), " ")
    return placed.select("doc_id", F.when(F.col("_llm_a").isNull(), F.col("text")).otherwise(planted).alias("text"))


@query
def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs.find_runs(_with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op11_vector_codes(spark, sf_dir):
    coded, codebooks = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digits = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    books = sha256(vector_codes.text_of(codebooks).encode()).hexdigest()
    return coded.select(
        "vec_id",
        F.array_join(digits, "").alias("code"),
        "error",
        "label_error",
        F.lit(books).alias("codebooks_sha256"),
    )


ORACLES["op11_vector_codes"] = vector_codes_sql.SQL
