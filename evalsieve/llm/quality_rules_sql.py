"""The quality rules in DuckDB SQL."""

_QUANTILES = ", ".join(
    f"min(CASE WHEN 100 * upto >= {p} * docs THEN bucket END) AS q{p}" for p in (25, 50, 75)
)
_FENCES = """
  max(CASE WHEN rule = 'symbols' THEN q50 + 6 * greatest(q75 - q25, 17) END) AS symbols_high,
  max(CASE WHEN rule = 'repeats' THEN q50 + 6 * greatest(q75 - q25, 50) END) AS repeats_high,
  max(CASE WHEN rule = 'dup_lines' THEN q50 + 6 * greatest(q75 - q25, 60) END) AS dup_lines_high,
  max(CASE WHEN rule = 'word_length' THEN q50 + 6 * greatest(q75 - q25, 250) END) AS word_length_high,
  max(CASE WHEN rule = 'word_length' THEN q50 - 6 * greatest(q75 - q25, 250) END) AS word_length_low,
  max(docs) AS docs"""


def _level(keys: str) -> str:
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
  SELECT {by}{_FENCES} FROM (
    SELECT {by}rule, max(docs) AS docs, {_QUANTILES} FROM (
      SELECT {by}rule, bucket, sum(n) OVER (PARTITION BY {by}rule ORDER BY bucket) AS upto,
        sum(n) OVER (PARTITION BY {by}rule) AS docs
      FROM (SELECT {by}rule, bucket, sum(n) AS n FROM sketch GROUP BY {by}rule, bucket))
    GROUP BY {by}rule) {group}"""


_PICK = ", ".join(
    f"CASE WHEN o.docs >= 200 THEN o.{c} WHEN l.docs >= 200 THEN l.{c} ELSE w.{c} END AS {c}"
    for c in ("symbols_high", "repeats_high", "dup_lines_high", "word_length_high", "word_length_low")
)

SQL = rf"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM base),
spots AS (
  SELECT doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) > 2)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM spots)
  WHERE c > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM split LEFT JOIN repeats USING (doc_id)),
failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1000 * n_symbols // greatest(n_words, 1) AS symbols,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeats,
    1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
    1000 * word_chars // greatest(n_words, 1) AS word_length
  FROM counted),
long AS (
  SELECT lang, source, rule, value FROM (
    UNPIVOT (SELECT lang, source, base_failed, symbols, repeats, dup_lines, word_length FROM failed)
    ON symbols, repeats, dup_lines, word_length INTO NAME rule VALUE value)
  WHERE NOT base_failed),
sketch AS (
  SELECT lang, source, rule, (value >> s) << s AS bucket, count(*) AS n
  FROM (SELECT *, greatest(length(bin(value)) - 6, 0) AS s FROM long) GROUP BY ALL),
own AS ({_level("lang, source")}),
wider AS ({_level("lang")}),
whole AS ({_level("")}),
fences AS (
  SELECT o.lang, o.source, {_PICK}
  FROM own o LEFT JOIN wider l ON o.lang IS NOT DISTINCT FROM l.lang CROSS JOIN whole w)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbols <= symbols_high AND repeats <= repeats_high
    AND dup_lines <= dup_lines_high AND word_length <= word_length_high
    AND word_length >= word_length_low, true) AS kept
FROM failed f LEFT JOIN fences g
  ON f.lang IS NOT DISTINCT FROM g.lang AND f.source IS NOT DISTINCT FROM g.source
"""
