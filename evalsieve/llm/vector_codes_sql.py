"""DuckDB SQL for the vector codes: every distance, round by round."""

from __future__ import annotations

from evalsieve.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE


def _assigned(round_: int) -> str:
    distance = "list_dot_product(y, y) + list_dot_product(c, c) - 2 * list_dot_product(y, c)"
    return f"""
a{round_} AS MATERIALIZED (
  SELECT row, p, any_value(y) AS y, min(CAST({distance} AS BIGINT) * {ENTRIES} + e) AS m
  FROM parts JOIN b{round_} USING (p) GROUP BY row, p)"""


def _improved(round_: int) -> str:
    return f"""
b{round_ + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(n.c, b.c) AS c FROM b{round_} b LEFT JOIN (
    SELECT p, e, list(v ORDER BY j) AS c FROM (
      SELECT p, m % {ENTRIES} AS e, j, floor(sum(y[j]) / count(*)) AS v
      FROM a{round_}, (SELECT unnest(range(1, 1 + (SELECT max(len(y)) FROM parts))) AS j) GROUP BY p, m % {ENTRIES}, j)
    GROUP BY p, e) n USING (p, e))"""


SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, label, [floor({SCALE} * CAST(v AS DOUBLE)) FOR v IN embedding] AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([v FOR v IN embedding IF v IS NULL OR NOT isfinite(v)]) = 0),
parts AS MATERIALIZED (
  SELECT row, vec_id, p, x[p * (len(x) // {PARTS}) + 1 : (p + 1) * (len(x) // {PARTS})] AS y
  FROM kept, (SELECT unnest(range({PARTS})) AS p)),
b0 AS MATERIALIZED (
  SELECT p, e, y AS c FROM (
    SELECT p, y, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {ENTRIES}),
{",".join(_assigned(r) + "," + _improved(r) for r in range(ROUNDS))},
{_assigned(ROUNDS)},
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', m % {ENTRIES})), '' ORDER BY p) AS code,
    CAST(sum(m // {ENTRIES}) AS BIGINT) AS error
  FROM a{ROUNDS} JOIN kept USING (row) GROUP BY row, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string([CAST(v AS BIGINT) FOR v IN c], ','), ',' ORDER BY p, e)) FROM b{ROUNDS})
    AS codebooks_sha256
FROM coded
"""
