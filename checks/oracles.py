r"""DuckDB SQL with the same answers, written independently of the library.

Python's whitespace is spelled out, because RE2's \s is ASCII only.
"""

from __future__ import annotations

# Fixed values, spelled out here on their own: the prompt around a question, the models in
# the order of the completions with their labels, the families, and the rows of the pivot.
PROMPT_HEAD = (
    "You are a math problem solving assistant.\n"
    "Solve the following problem step by step and put the final answer in \\boxed{}.\n\nProblem:\n"
)
PROMPT_TAIL = "\n\nSolution:\n"
MODEL_LABELS = {
    "Llama-3.1-8B-Instruct": "Llama 3.1-8B (Teacher)",
    "Llama-3.2-1B-Instruct": "Llama 3.2-1B (Base)",
    "llama_instruct_from_llama_merged": "Llama 3.2-1B (Student)",
    "llama_from_qwen_merged": "Llama 3.2-1B (Cross-Family)",
    "Qwen2.5-Math-7B-Instruct": "Qwen2.5-Math-7B (Teacher)",
    "Qwen2.5-1.5B": "Qwen2.5-1.5B (Base)",
    "qwen_from_qwen_merged": "Qwen2.5-1.5B (Student)",
    "qwen_from_llama_merged": "Qwen2.5-1.5B (Cross-Family)",
}
FAMILIES = {
    "Llama": ["Llama 3.1-8B (Teacher)", "Llama 3.2-1B (Base)", "Llama 3.2-1B (Student)"],
    "Qwen": ["Qwen2.5-Math-7B (Teacher)", "Qwen2.5-1.5B (Base)", "Qwen2.5-1.5B (Student)"],
}
DIFFICULTY_ROWS = [
    "Qwen2.5-Math-7B (Teacher)",
    "Qwen2.5-1.5B (Student)",
    "Qwen2.5-1.5B (Base)",
    "Llama 3.1-8B (Teacher)",
    "Llama 3.2-1B (Student)",
    "Llama 3.2-1B (Base)",
]

SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
SPACE_ANY, NO_SPACE = SPACE[:-1] + "*", "[^" + SPACE[1:]
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACE}'), lambda w: w <> '')"


def strip(text: str) -> str:
    return f"trim({text}, '{SPACE_CHARS}')"


def prompt(question: str) -> str:
    return f"concat('{PROMPT_HEAD}', {question}, '{PROMPT_TAIL}')"


def shown(text: str) -> str:
    return (
        f"CASE WHEN ratio >= 1 THEN {text} ELSE substr({text}, 1, "
        f"greatest(1, CAST(floor(length({text}) * ratio) AS INT))) END"
    )


RATIOS = (
    "ratios(r, ratio) AS (VALUES (0, CAST(1.0 AS DOUBLE)), (1, CAST(0.8 AS DOUBLE)), "
    "(2, CAST(0.6 AS DOUBLE)), (3, CAST(0.4 AS DOUBLE)))"
)
LABELS = "labels_of(m, model, model_label) AS (VALUES " + ", ".join(
    f"({i}, '{model}', '{label}')" for i, (model, label) in enumerate(MODEL_LABELS.items())
) + ")"

# -- contamination ------------------------------------------------------------

BENCH = f"""bench AS (
  SELECT CASE WHEN item_id % 2 = 0 THEN 'bench-even' ELSE 'bench-odd' END AS benchmark,
    item_id AS test_idx, text, {words("lower(text)")} AS t
  FROM benchmark)"""
LENGTHS = """lengths AS (
  SELECT benchmark,
    CAST(greatest(8, least(13, floor(quantile_cont(len(t), 0.05)))) AS BIGINT) AS n
  FROM bench GROUP BY benchmark)"""


#: The benchmark again, split by the length of its items, so that the two n differ.
BY_LENGTH = f"""by_length AS (
  SELECT CASE WHEN len({words("lower(text)")}) < 20 THEN 'short' ELSE 'long' END AS benchmark, item_id AS test_idx,
    text, {words("lower(text)")} AS t FROM benchmark)"""


def by_remainder(parts: int) -> str:
    """The benchmark cut into several by the number of the item."""
    return f"""by_remainder AS (
  SELECT CAST(item_id % {parts} AS VARCHAR) AS benchmark, item_id AS test_idx, text,
    {words("lower(text)")} AS t FROM benchmark)"""


def match_ctes(n: int | None = None, docs: str = "documents", bench_from: str = "", tokens: str = "") -> str:
    """CTEs up to `hits`: every matching pair of positions."""
    own = f"bench AS (SELECT * FROM {bench_from})" if bench_from else BENCH
    text_tokens = words("lower(text)")
    if tokens:
        text_tokens = tokens.replace("{text}", "text")
        own = own.replace(words("lower(text)"), text_tokens)
    lengths = LENGTHS if n is None else f"lengths AS (SELECT DISTINCT benchmark, {n} AS n FROM bench)"
    return f"""{own}, {lengths},
docs AS (SELECT doc_id, source, {text_tokens} AS t FROM {docs}),
bench_at AS (
  SELECT benchmark, test_idx, t, n, unnest(range(1, len(t) - n + 2)) AS i
  FROM bench JOIN lengths USING (benchmark)),
bench_grams AS (
  SELECT benchmark, test_idx, i - 1 AS test_pos, n, array_to_string(t[i:i + n - 1], ' ') AS ngram
  FROM bench_at),
doc_at AS (
  SELECT doc_id, source, t, n, unnest(range(1, len(t) - n + 2)) AS i
  FROM docs CROSS JOIN (SELECT DISTINCT n FROM lengths)),
doc_grams AS (
  SELECT doc_id AS train_idx, source, i - 1 AS train_pos, n,
    array_to_string(t[i:i + n - 1], ' ') AS ngram
  FROM doc_at),
hits AS (
  SELECT benchmark, test_idx, b.ngram, test_pos, train_idx, source, train_pos
  FROM bench_grams b JOIN doc_grams d ON b.ngram = d.ngram AND b.n = d.n),
pairs AS (SELECT DISTINCT benchmark, test_idx, train_idx, source FROM hits)"""


MATCH = f"WITH {match_ctes()}"

SUMMARY = """SELECT benchmark, test_size, coalesce(contaminated_test, 0) AS contaminated_test,
  coalesce(contaminated_train, 0) AS {rows_name},
  CAST(coalesce(contaminated_test, 0) AS DOUBLE) / test_size * 100 AS contamination_rate
FROM (SELECT benchmark, count(*) AS test_size FROM bench GROUP BY benchmark)
LEFT JOIN (
  SELECT benchmark, count(DISTINCT test_idx) AS contaminated_test,
    count(DISTINCT train_idx) AS contaminated_train
  FROM pairs GROUP BY benchmark) USING (benchmark)"""

REPORT = f"""{MATCH},
flags AS (SELECT source, doc_id IN (SELECT train_idx FROM pairs) AS gone FROM documents),
totals AS (SELECT count(*) AS a, count(*) FILTER (NOT gone) AS k FROM flags)
SELECT source, count(*) AS original, count(*) FILTER (NOT gone) AS clean,
  count(*) FILTER (gone) AS removed,
  CAST(count(*) AS DOUBLE) / any_value(a) * 100 AS original_pct,
  CAST(count(*) FILTER (NOT gone) AS DOUBLE) / any_value(k) * 100 AS clean_pct,
  CAST(count(*) FILTER (gone) AS DOUBLE) / count(*) * 100 AS removed_pct
FROM flags, totals GROUP BY source"""

# -- evaluation ---------------------------------------------------------------

GRID = f"""{RATIOS}, {LABELS},
examples AS (SELECT DISTINCT doc_id // 32 AS id FROM documents),
asked AS (
  SELECT id, text AS question, CAST((item_id * 7) % 1000 AS VARCHAR) AS number,
    CASE WHEN item_id % 2 = 0 THEN 'math500' ELSE 'aime2025' END AS dataset
  FROM examples JOIN benchmark ON item_id = id % (SELECT count(*) FROM benchmark)),
cells AS (
  SELECT *, CASE WHEN id % 3 = 0 THEN concat(' $', number, '$. ') ELSE number END AS answer,
    {shown("question")} AS shown
  FROM asked CROSS JOIN ratios),
grid AS (
  SELECT *, substr(question, length(shown) + 1) AS tail,
    length(substr(question, length(shown) + 1)) AS tail_length
  FROM cells)"""

COMPLETIONS = GRID + r""",
given AS (
  SELECT model, model_label, grid.dataset, id, r,
    concat(
      CASE id % 5 WHEN 0 THEN concat(tail, ' ') WHEN 1 THEN concat(substr(tail, 11), ' ') ELSE '' END,
      text,
      CASE (id + m) % 7
        WHEN 0 THEN ''
        WHEN 1 THEN concat(' \boxed{0', number, '}')
        WHEN 2 THEN concat(' \boxed{$', number, '$.}')
        WHEN 3 THEN concat(' \boxed{\frac{', number, '}{2}}')
        WHEN 4 THEN concat(' \boxed{1} then \boxed{', number, '}')
        WHEN 5 THEN concat(' \boxed{ ', number)
        ELSE concat(' \boxed{\text{ ', number, ' }}. Done {x}.') END) AS generated
  FROM documents
  JOIN labels_of ON m = doc_id % 8
  JOIN grid ON id = doc_id // 32 AND r = (doc_id // 8) % 4),
-- a model is asked every example of its datasets; what is missing counts as empty
completions AS (
  SELECT runs.model, runs.model_label, grid.*, coalesce(given.generated, '') AS generated,
    given.model IS NOT NULL AS present
  FROM (SELECT DISTINCT model, model_label, dataset FROM given) runs
  JOIN grid USING (dataset)
  LEFT JOIN given ON given.model = runs.model AND given.id = grid.id AND given.r = grid.r)"""


def normalized(source: str, column: str, name: str, prefix: str) -> str:
    """CTEs that add the normalised form of a column of `source`."""
    bare = strip(f"replace({strip(column)}, '$', '')")
    return rf"""{prefix}1 AS (SELECT *, {bare} AS {prefix}_bare FROM {source}),
{prefix}2 AS (SELECT *, rtrim(
    CASE WHEN regexp_full_match({prefix}_bare, '\\boxed\{{(.*)\}}')
      THEN {strip(f"{prefix}_bare[8:-2]")} ELSE {prefix}_bare END, '.') AS {prefix}_in
  FROM {prefix}1),
{prefix}3 AS (SELECT *, array_to_string({words(f"{prefix}_in")}, ' ') AS {name} FROM {prefix}2)"""


SCORED = f"""{COMPLETIONS},
after_box AS (
  SELECT *, CASE WHEN contains(generated, '\\boxed{{')
    THEN string_split(string_split(generated, '\\boxed{{')[-1], '}}') END AS parts
  FROM completions),
closing AS (
  SELECT *, list_min(list_filter(range(1, len(parts)), lambda k:
    len(array_to_string(parts[1:k], '')) - len(replace(array_to_string(parts[1:k], ''), '{{', ''))
      = k - 1)) AS closed_at
  FROM after_box),
answered AS (
  SELECT *, CASE WHEN closed_at IS NULL THEN ''
    ELSE {strip("array_to_string(parts[1:closed_at], '}')")} END AS pred_answer_raw
  FROM closing),
{normalized("answered", "pred_answer_raw", "pred_answer_norm", "p")},
{normalized("p3", "answer", "gold_answer_norm", "g")},
scored AS (
  SELECT *, pred_answer_norm <> '' AND pred_answer_norm = gold_answer_norm AS correct,
    pred_answer_raw = '' AS no_boxed
  FROM g3)"""

# Longest common subsequence, one guessed token per step. `best` holds the best
# length for every prefix of the hidden tokens.
OVERLAP = f"""{SCORED},
cut AS (
  SELECT *, array_to_string({words("generated")}[1:len({words("tail")})], ' ') AS guess
  FROM scored),
tokens AS (
  SELECT *,
    CASE WHEN tail_length = 0 THEN [] ELSE list_filter(
      string_split_regex(lower(tail), '[^a-z0-9]+'), lambda w: w <> '') END AS h,
    CASE WHEN tail_length = 0 THEN [] ELSE list_filter(
      string_split_regex(lower(guess), '[^a-z0-9]+'), lambda w: w <> '') END AS g
  FROM cut),
steps AS (
  SELECT model, id, ratio, h, g, 0 AS i, list_transform(range(0, len(h) + 1), lambda z: 0) AS best
  FROM tokens
  UNION ALL
  SELECT model, id, ratio, h, g, i + 1,
    list_transform(range(1, len(h) + 2), lambda j: list_max(found[1:j]))
  FROM (
    SELECT model, id, ratio, h, g, i, list_concat([0], list_transform(range(1, len(h) + 1),
      lambda j: CASE WHEN h[j] = g[i + 1] THEN best[j] + 1 ELSE best[j + 1] END)) AS found
    FROM steps WHERE i < len(g))),
overlap AS (
  SELECT model, id, ratio, CAST(best[-1] AS BIGINT) AS lcs, len(h) AS tail_tokens,
    len(g) AS guess_tokens
  FROM steps WHERE i = len(g)),
fscored AS (
  SELECT *, CASE WHEN lcs > 0 THEN
      2 * (CAST(lcs AS DOUBLE) / guess_tokens) * (CAST(lcs AS DOUBLE) / tail_tokens)
        / ((CAST(lcs AS DOUBLE) / guess_tokens) + (CAST(lcs AS DOUBLE) / tail_tokens))
    ELSE 0.0 END AS rougel_f
  FROM overlap),
results AS (
  SELECT model, dataset, ratio AS prefix_ratio,
    CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, count(*) AS total,
    avg(rougel_f) AS avg_rougel_f, CAST(sum(CAST(no_boxed AS INT)) AS BIGINT) AS no_boxed_count
  FROM scored JOIN fscored USING (model, id, ratio)
  GROUP BY model, dataset, ratio),
result_rows AS (
  SELECT model, dataset, prefix_ratio, CAST(correct AS DOUBLE) / total AS accuracy, correct, total,
    round(avg_rougel_f, 9) AS avg_rougel_f, no_boxed_count,
    CAST(no_boxed_count AS DOUBLE) / total AS no_boxed_ratio
  FROM results)"""
RESULTS = f"WITH RECURSIVE {OVERLAP}"
FULL = "dataset = 'math500' AND prefix_ratio = 1"
FAMILY_ROWS = ", ".join(
    f"('{f}', {i}, '{m}')" for f, members in FAMILIES.items() for i, m in enumerate(members)
)
DIFFICULTY = ", ".join(f"({i}, '{m}')" for i, m in enumerate(DIFFICULTY_ROWS))

TEACHER = f"""turn_pairs AS (
  SELECT concat(u.conv_id, ':', u.turn) AS id, 'conversations' AS source,
    {prompt("u.text")} AS input_text, {strip("a.text")} AS target_text
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

LETTERS = "regexp_extract_all(lower({text}), '[a-z]+')"

ORACLES: dict[str, str] = {
    "tokenize": f"""SELECT doc_id AS row_idx, len({words("lower(text)")}) AS n_tokens,
  array_to_string({words("lower(text)")}, ' ') AS tokens FROM documents""",
    "prefix_truncate": f"""WITH {RATIOS}, cut AS (
  SELECT doc_id, ratio, text, {shown("text")} AS shown FROM documents CROSS JOIN ratios)
SELECT doc_id AS row_idx, ratio, shown, substr(text, length(shown) + 1) AS tail,
  length(substr(text, length(shown) + 1)) AS tail_length FROM cut""",
    "boxed_answers": f"""WITH {SCORED}
SELECT model, id, ratio, pred_answer_raw AS answer, length(generated) AS generated_length
FROM scored WHERE present""",
    "normalize_answers": f"""WITH {SCORED}
SELECT model, id, ratio, pred_answer_raw AS raw, pred_answer_norm AS norm FROM scored WHERE present""",
    "model_names": """SELECT page_id,
  replace(string_split(CASE WHEN ends_with(url, '/') THEN url[:-2] ELSE url END, '/')[-1], ':', '_')
    AS model_name,
  replace(replace(lower(url), '-', '_'), '.', '_') AS set_name FROM pages""",
    "ngram_length": f"WITH {BENCH}, {LENGTHS} SELECT benchmark, n FROM lengths",
    "ngram_matches": f"""{MATCH}
SELECT benchmark, test_idx, ngram, test_pos, train_idx, train_pos FROM hits""",
    "contamination_matches": f"{MATCH} SELECT benchmark, test_idx, train_idx FROM pairs",
    "contamination_matches_n8": f"""WITH {match_ctes(8)}
SELECT benchmark, test_idx, train_idx FROM pairs""",
    "contamination_summary": f"{MATCH} {SUMMARY.format(rows_name='num_contaminated_train')}",
    "contaminated_indices": f"{MATCH} SELECT DISTINCT benchmark, train_idx FROM pairs",
    "contamination_total": f"""{MATCH}
SELECT (SELECT count(*) FROM documents) AS training_size,
  count(DISTINCT train_idx) AS total_contaminated_train,
  CAST(count(DISTINCT train_idx) AS DOUBLE) / (SELECT count(*) FROM documents) * 100
    AS contaminated_pct
FROM pairs""",
    "match_sources": f"""{MATCH}
SELECT source AS train_source, count(*) AS pairs FROM pairs GROUP BY source""",
    "match_details": f"""{MATCH}
SELECT p.benchmark, p.test_idx, CAST(p.test_idx AS VARCHAR) AS test_id, b.text AS test_prompt,
  p.train_idx, CAST(p.train_idx AS VARCHAR) AS train_id, d.source AS train_source,
  d.text AS train_prompt
FROM pairs p JOIN bench b USING (benchmark, test_idx) JOIN documents d ON d.doc_id = p.train_idx""",
    "two_lengths": f"""WITH {BY_LENGTH}, {match_ctes(bench_from="by_length")}
SELECT benchmark, n, test_idx, train_idx FROM (SELECT DISTINCT benchmark, test_idx, train_idx FROM hits)
JOIN lengths USING (benchmark)""",
    "letters_only": f"""WITH {match_ctes(8, tokens=LETTERS)}
SELECT DISTINCT benchmark, test_idx, train_idx FROM hits""",
    "unmatchable_items": f"""WITH {BENCH}, {LENGTHS}
SELECT benchmark, CAST(count(*) FILTER (len(t) < n) AS BIGINT) AS unmatchable_test
FROM bench JOIN lengths USING (benchmark) GROUP BY benchmark""",
    "detection_record": f"""{MATCH}, summary AS (
  {SUMMARY.format(rows_name='num_contaminated_train')}),
total AS (SELECT count(DISTINCT train_idx) AS u FROM pairs),
docs_n AS (SELECT count(*) AS n FROM documents)
SELECT 'documents' AS training_dataset, docs_n.n AS training_size, u AS total_contaminated_train,
  benchmark, test_size, contaminated_test, num_contaminated_train,
  (SELECT count(*) FROM (SELECT DISTINCT benchmark, train_idx FROM pairs) f WHERE f.benchmark = summary.benchmark)
    AS listed, u AS listed_union
FROM summary, total, docs_n""",
    "benchmark_files": """SELECT CASE WHEN item_id % 2 = 0 THEN 'a' ELSE 'b' END AS folder,
  row_number() OVER (PARTITION BY item_id % 2 ORDER BY item_id) - 1 AS test_idx, text AS prompt
FROM benchmark""",
    "text_positions": """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx,
  CAST(doc_id AS VARCHAR) AS id, text AS prompt FROM documents""",
    "question_files": """SELECT 'items' AS dataset, CASE WHEN spot % 2 = 0 THEN concat('q', item_id) ELSE concat('ex_', spot) END AS id,
  text AS question, CAST(item_id AS VARCHAR) AS answer
FROM (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS spot FROM benchmark) WHERE spot < 50""",
    "first_rows": "SELECT doc_id AS row_idx, source FROM documents WHERE doc_id < 100",
    "indexed_summary": f"{MATCH} {SUMMARY.format(rows_name='num_contaminated_train')}",
    "shared_runs": f"""{MATCH},
islands AS (
  SELECT *, train_pos - test_pos AS diagonal, train_pos - row_number() OVER (
    PARTITION BY benchmark, test_idx, train_idx, train_pos - test_pos ORDER BY train_pos) AS island
  FROM (SELECT DISTINCT benchmark, test_idx, train_idx, test_pos, train_pos FROM hits)),
stretches AS (
  SELECT benchmark, test_idx, train_idx, min(test_pos) AS test_start, min(train_pos) AS train_start,
    count(*) + any_value(n) - 1 AS length
  FROM islands JOIN lengths USING (benchmark) GROUP BY benchmark, test_idx, train_idx, diagonal, island)
SELECT * FROM stretches QUALIFY row_number() OVER (
  PARTITION BY benchmark, test_idx, train_idx ORDER BY length DESC, train_start, test_start) = 1""",
    "benchmark_overlap": f"""WITH {by_remainder(5)}, {match_ctes(8, bench_from="by_remainder")},
flagged AS (SELECT DISTINCT concat('bench-', benchmark) AS s, train_idx FROM hits),
names AS (SELECT DISTINCT concat('bench-', benchmark) AS s FROM bench),
counted AS (SELECT names.s, count(train_idx) AS n FROM names LEFT JOIN flagged USING (s) GROUP BY names.s),
met AS (
  SELECT a.s AS set_a, b.s AS set_b, count(*) AS in_both FROM flagged a JOIN flagged b USING (train_idx)
  WHERE a.s < b.s GROUP BY a.s, b.s)
SELECT a.s AS set_a, b.s AS set_b, a.n AS size_a, b.n AS size_b, coalesce(in_both, 0) AS in_both,
  a.n - coalesce(in_both, 0) AS only_a, b.n - coalesce(in_both, 0) AS only_b, a.n + b.n - coalesce(in_both, 0) AS in_either
FROM counted a JOIN counted b ON a.s < b.s LEFT JOIN met ON set_a = a.s AND set_b = b.s""",
    "flagged_by_all_or_one": f"""WITH {by_remainder(3)}, {match_ctes(8, bench_from="by_remainder")},
flagged AS (SELECT train_idx AS position, list(DISTINCT benchmark) AS b FROM hits GROUP BY train_idx)
SELECT 'any' AS set, position FROM flagged
UNION ALL SELECT 'all', position FROM flagged WHERE len(b) = 3
UNION ALL SELECT 'only-0', position FROM flagged WHERE b = ['0']""",
    "training_fingerprint": """WITH e AS (
  SELECT doc_id, concat_ws(';', coalesce(concat(length(text), ':', text), '-'), '-',
    coalesce(concat(length(source), ':', source), '-'), concat(length(CAST(doc_id AS VARCHAR)), ':', doc_id)) AS e
  FROM documents),
h AS (SELECT md5(e) AS c, md5(concat(doc_id, ';', e)) AS p FROM e),
sums AS (
  SELECT count(*) AS training_size,
    """ + ", ".join(
        f"sum(CAST(CAST(concat('0x', substr({d}, {8 * i + 1}, 8)) AS BIGINT) AS HUGEINT)) AS {d}{i}"
        for d in "cp" for i in range(4)
    ) + """ FROM h),
halves AS (
  SELECT training_size, """ + ", ".join(
        f"{d}2 * 4294967296 + {d}3 AS {d}_low, {d}0 * 4294967296 + {d}1 AS {d}_high" for d in "cp"
    ) + """ FROM sums)
SELECT training_size, """ + ", ".join(
        f"lower(concat(lpad(to_hex(CAST(({d}_high + {d}_low // 18446744073709551616) % 18446744073709551616 AS UBIGINT)), 16, '0'), "
        f"lpad(to_hex(CAST({d}_low % 18446744073709551616 AS UBIGINT)), 16, '0'))) AS {name}"
        for d, name in (("c", "content_fingerprint"), ("p", "placed_fingerprint"))
    ) + " FROM halves",
    "completion_faults": f"""WITH {COMPLETIONS},
moved AS (
  SELECT model, dataset, ratio, CASE WHEN id % 7 = 0 THEN id + 2 WHEN id % 11 = 0 THEN -id ELSE id END AS id
  FROM (SELECT given.model, given.dataset, given.id, grid.ratio FROM given JOIN grid ON grid.id = given.id AND grid.r = given.r)),
counted AS (SELECT model, dataset, id, ratio, count(*) AS completions FROM moved GROUP BY ALL)
SELECT model, dataset, id, ratio, completions,
  EXISTS (SELECT 1 FROM grid g WHERE g.dataset = c.dataset AND g.id = c.id AND g.ratio = c.ratio) AS asked
FROM counted c
WHERE completions > 1 OR NOT EXISTS (
  SELECT 1 FROM grid g WHERE g.dataset = c.dataset AND g.id = c.id AND g.ratio = c.ratio)""",
    "source_counts": "SELECT source, count(*) AS rows FROM documents GROUP BY source",
    "decontaminate": f"""{MATCH}
SELECT doc_id AS row_idx, source, text AS prompt FROM documents
WHERE doc_id NOT IN (SELECT train_idx FROM pairs)""",
    "clean_indices": f"""{MATCH}
SELECT doc_id AS row_idx FROM documents WHERE doc_id NOT IN (SELECT train_idx FROM pairs)""",
    "decontamination_report": REPORT,
    "verify_original": f"""{MATCH}, summary AS (
  {SUMMARY.format(rows_name='contaminated_train')})
SELECT count(*) AS benchmarks, CAST(sum(contaminated_test) AS BIGINT) AS contaminated_test,
  max(contaminated_train) AS contaminated_train_max, bool_and(contaminated_test = 0) AS all_clean,
  (SELECT count(DISTINCT train_idx) FROM pairs) AS contaminated_train_union
FROM summary""",
    "verify_clean": f"""{MATCH},
left_over AS (SELECT * FROM pairs WHERE train_idx IN (
  SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT train_idx FROM pairs)))
{SUMMARY.format(rows_name='contaminated_train').replace('FROM pairs', 'FROM left_over')}""",
    "convert_training": """SELECT text AS question, source, printf('train_%06d', doc_id) AS id
FROM documents""",
    "convert_benchmark": """SELECT text AS question, '' AS answer, 'UNKNOWN' AS source,
  printf('benchmark_%06d', item_id) AS id FROM benchmark""",
    "build_prompts": f"""SELECT CAST(doc_id AS VARCHAR) AS id, {prompt("text")} AS prompt
FROM documents""",
    "prompt_shards": "SELECT doc_id AS row_idx, doc_id % 3 AS shard FROM documents",
    "position_index": """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx
FROM documents""",
    "stratified_sample": """WITH placed AS (
  SELECT doc_id, source, row_number() OVER (
    PARTITION BY source ORDER BY md5(concat('42:', doc_id)), doc_id) AS place
  FROM documents)
SELECT doc_id, source, row_number() OVER (ORDER BY md5(concat('43:', doc_id)), doc_id) - 1
  AS shuffle_rank
FROM placed WHERE place <= 20""",
    "teacher_pairs": f"WITH {TEACHER} SELECT * FROM turn_pairs",
    "sft_examples": f"""WITH {TEACHER}, joined AS (
  SELECT id, source, concat(input_text, target_text) AS whole,
    {words("concat(input_text, target_text)")} AS w FROM turn_pairs)
SELECT id, source,
  CASE WHEN len(w) <= 100 THEN whole ELSE regexp_extract(whole, '^({SPACE_ANY}{NO_SPACE}){{1,100}}') END AS text,
  least(len(w), 100) AS n_tokens, len(w) > 100 AS truncated
FROM joined""",
    "pairing_faults": """WITH p AS (SELECT concat(conv_id, ':', turn) AS id, count(*) AS n FROM conversations
  WHERE role = 'user' GROUP BY ALL),
c AS (SELECT concat(conv_id, ':', turn - 1) AS id, count(*) AS n FROM conversations
  WHERE role = 'assistant' GROUP BY ALL)
SELECT id, CAST(coalesce(p.n, 0) AS BIGINT) AS prompts, CAST(coalesce(c.n, 0) AS BIGINT) AS completions
FROM p FULL JOIN c USING (id) WHERE coalesce(p.n, 0) <> 1 OR coalesce(c.n, 0) <> 1""",
    "teacher_preview": f"""WITH n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id AS row_idx, CAST(doc_id AS VARCHAR) AS id,
  substr({prompt("text")}, 1, 100) AS input_preview, substr(text, 1, 150) AS target_preview
FROM documents, n WHERE doc_id = 0 OR (n > 2 AND doc_id IN (n // 2, n - 1))""",
    "batch_complete": f"""SELECT CAST(doc_id AS VARCHAR) AS id,
  concat({prompt("text")}, ' \\boxed{{', length({prompt("text")}), '}}') AS completion
FROM documents""",
    "resumed_completion": f"""SELECT CAST(doc_id AS VARCHAR) AS id,
  CASE WHEN length({prompt("text")}) % 17 <> 0
    THEN concat({prompt("text")}, ' \\boxed{{', length({prompt("text")}), '}}') END AS completion,
  CASE WHEN length({prompt("text")}) % 17 = 0 THEN 'ValueError: no answer' END AS error
FROM documents""",
    "prefix_grid": f"""WITH {GRID}
SELECT dataset, id, ratio, shown, tail, tail_length, {prompt("shown")} AS prompt FROM grid""",
    "score_answers": f"""WITH {SCORED}
SELECT model, dataset, id, ratio, answer AS gold_answer_raw, gold_answer_norm,
  shown AS truncated_question, pred_answer_raw, pred_answer_norm, correct, no_boxed,
  length(generated) AS generated_length, tail_length AS gold_tail_length
FROM scored""",
    "memorization_scores": f"""{RESULTS}
SELECT model, id, ratio, lcs, tail_tokens, guess_tokens, round(rougel_f, 9) AS rougel_f
FROM fscored""",
    "predictions_map": f"""{RESULTS}
SELECT model, dataset, id, gold_answer_norm, CAST(ratio AS VARCHAR) AS ratio,
  shown AS truncated_question, pred_answer_raw, pred_answer_norm, correct,
  length(generated) AS generated_length, tail_length AS gold_tail_length,
  round(rougel_f, 9) AS rougel_f
FROM scored JOIN fscored USING (model, id, ratio)""",
    "eval_metrics": f"{RESULTS} SELECT * FROM result_rows",
    "flatten_metrics": f"{RESULTS} SELECT * FROM result_rows",
    "metrics_roundtrip": f"{RESULTS} SELECT * FROM result_rows",
    "metric_files": f"{RESULTS} SELECT * FROM result_rows",
    "results_csv": f"{RESULTS} SELECT * FROM result_rows",
    "training_jsonl": """SELECT text AS question, source, CAST(doc_id AS VARCHAR) AS id
FROM documents""",
    "model_comparison": f"""{RESULTS}
SELECT model, model_label, accuracy * 100 AS accuracy_pct, correct, total
FROM result_rows JOIN labels_of USING (model) WHERE {FULL}""",
    "accuracy_curve": f"""{RESULTS}
SELECT model, model_label, prefix_ratio, accuracy * 100 AS accuracy_pct
FROM result_rows JOIN labels_of USING (model) WHERE dataset = 'math500'""",
    "family_transfer": f"""{RESULTS},
wanted(family, position, model_label) AS (VALUES {FAMILY_ROWS}),
measured AS (
  SELECT model_label, accuracy * 100 AS accuracy_pct
  FROM result_rows JOIN labels_of USING (model) WHERE {FULL})
SELECT family, position, model_label, accuracy_pct FROM wanted LEFT JOIN measured USING (model_label)""",
    "format_quality": f"""{RESULTS}
SELECT model, model_label, (1 - no_boxed_ratio) * 100 AS valid_boxed_pct,
  no_boxed_ratio * 100 AS no_boxed_pct
FROM result_rows JOIN labels_of USING (model) WHERE {FULL}""",
    "memorization_curve": f"""{RESULTS}
SELECT model, model_label, prefix_ratio, avg_rougel_f
FROM result_rows JOIN labels_of USING (model) WHERE dataset = 'math500' AND prefix_ratio <> 1""",
    "difficulty_pivot": f"""{RESULTS},
wanted(position, model_label) AS (VALUES {DIFFICULTY}),
measured AS (
  SELECT model_label,
    max(accuracy * 100) FILTER (dataset = 'math500') AS math_500,
    max(accuracy * 100) FILTER (dataset = 'aime2025') AS aime_2025
  FROM result_rows JOIN labels_of USING (model) WHERE prefix_ratio = 1 GROUP BY model_label)
SELECT position, model_label, math_500, aime_2025
FROM wanted LEFT JOIN measured USING (model_label)""",
    "summary_grid": f"""{RESULTS},
pairs_of AS (
  SELECT * FROM (SELECT DISTINCT model FROM result_rows)
  CROSS JOIN (SELECT DISTINCT dataset FROM result_rows))
SELECT model, dataset,
  coalesce(concat(printf('%.2f', accuracy * 100), '%'), 'MISSING') AS accuracy,
  coalesce(concat(correct, '/', total), '') AS correct_total
FROM pairs_of LEFT JOIN (SELECT * FROM result_rows WHERE prefix_ratio = 1) USING (model, dataset)""",
    "completeness": f"""{RESULTS}
SELECT count(DISTINCT model) AS models, count(DISTINCT dataset) AS datasets,
  count(DISTINCT prefix_ratio) AS ratios, count(*) AS found,
  count(DISTINCT model) * count(DISTINCT dataset) * count(DISTINCT prefix_ratio) AS expected,
  count(*) = count(DISTINCT model) * count(DISTINCT dataset) * count(DISTINCT prefix_ratio)
    AS complete
FROM result_rows""",
}
