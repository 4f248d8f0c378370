from __future__ import annotations

from test_matching import brute_pairs, corpus, make_bench, make_train, percentile_n

from evalsieve import (
    clean_indices,
    decontaminate,
    decontamination_report,
    detect,
    source_counts,
    verify,
)
from evalsieve.operators.cleaning import verification_totals
from evalsieve.operators.contamination import Detection
from evalsieve.operators.positions import keep_rows


def prepared(spark):
    train, items = corpus()
    sources = [None if i % 7 == 0 else f"s{i % 3}" for i in range(len(train))]
    want = brute_pairs(train, items, {b: percentile_n(t) for b, t in items.items()})
    df, bench = make_train(spark, train, sources), make_bench(spark, items)
    return df, bench, sources, {j for _, _, j in want}, detect(df, bench, carry=["source"])


def test_clean_and_flagged_make_up_the_input(spark, all_sizes):
    df, bench, sources, gone, found = prepared(spark)
    kept = decontaminate(df, found.flagged_rows())
    assert {r["row_idx"] for r in kept.collect()} == set(range(len(sources))) - gone
    assert kept.columns == df.columns
    assert {r[0] for r in clean_indices(df, found.flagged_rows()).collect()} == (
        set(range(len(sources))) - gone
    )


def test_bitmaps_select_the_same_rows(spark):
    """More flagged positions than may be broadcast as a list; several bitmaps."""
    df = spark.range(200_000).withColumnRenamed("id", "row_idx")
    flagged = df.where("row_idx % 7 = 0 or row_idx < 3 or row_idx between 32760 and 32780")
    gone = {r[0] for r in flagged.collect()}
    positions = flagged.withColumnRenamed("row_idx", "train_idx")
    spark.conf.set("spark.evalsieve.broadcastRows", "100")
    try:
        for select, want in (
            (decontaminate, set(range(200_000)) - gone),
            (keep_rows, gone),
        ):
            df_out = select(df, positions)
            plan = df_out._jdf.queryExecution().toString()
            assert "_bits" in plan and "BroadcastHashJoin" in plan
            rows = [r[0] for r in df_out.collect()]
            assert len(rows) == len(want) and set(rows) == want
    finally:
        spark.conf.unset("spark.evalsieve.broadcastRows")


def test_cleaned_set_is_clean_and_cleaning_is_idempotent(spark, all_sizes):
    df, bench, _, gone, found = prepared(spark)
    kept = decontaminate(df, found.flagged_rows())
    per_benchmark, totals = verify(kept, bench)
    assert {r["contaminated_test"] for r in per_benchmark.collect()} == {0}
    assert totals.first()["all_clean"] is True
    again = decontaminate(kept, detect(kept, bench).flagged_rows())
    assert again.count() == kept.count()
    assert verify(df, bench)[1].first()["all_clean"] is False


def test_report(spark):
    df, _, sources, gone, found = prepared(spark)
    report = {r["source"]: r for r in decontamination_report(df, found.flagged_rows()).collect()}
    assert set(report) == set(sources)
    size, left = len(sources), len(sources) - len(gone)
    for s, r in report.items():
        rows = [i for i, x in enumerate(sources) if x == s]
        removed = sum(i in gone for i in rows)
        assert (r["original"], r["clean"], r["removed"]) == (
            len(rows),
            len(rows) - removed,
            removed,
        )
        assert r["original_pct"] == len(rows) / size * 100
        assert r["clean_pct"] == (len(rows) - removed) / left * 100
        assert r["removed_pct"] == removed / len(rows) * 100
    counts = {r["source"]: r["rows"] for r in source_counts(df).collect()}
    assert counts == {s: r["original"] for s, r in report.items()}


def test_totals_give_the_largest_count_and_the_union(spark):
    flagged = spark.createDataFrame(
        [("x", i) for i in (1, 2, 3)] + [("y", i) for i in (3, 4, 5, 6, 7)],
        "benchmark string, train_idx long",
    )
    per_benchmark = spark.createDataFrame(
        [("x", 9, 2, 3), ("y", 9, 0, 5)],
        "benchmark string, test_size long, contaminated_test long, contaminated_train long",
    )
    totals = verification_totals(per_benchmark, Detection(flagged, None)).first()
    assert totals["contaminated_test"] == 2
    assert totals["contaminated_train_max"] == 5
    assert totals["contaminated_train_union"] == 7
    assert totals["all_clean"] is False
