"""Block-wise running sums, ranks and medians against brute force, with very small blocks."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quotelab.operators import evaluation, history, prefix

EVENTS = "id long, client_id long, created_at timestamp, signer_at timestamp"


def random_events(spark, n=400, seed=7):
    from datetime import datetime, timedelta

    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        # One client owns a third of everything, some events have no client.
        client = 1 if rng.random() < 0.34 else rng.choice([None, *range(2, 30)])
        created = start + timedelta(hours=rng.randrange(300))
        signed = created + timedelta(hours=rng.randrange(-20, 200)) if rng.random() < 0.5 else None
        rows.append((i, client, created, signed))
    return rows, spark.createDataFrame(rows, EVENTS)


def expected_history(rows):
    out = {}
    for i, client, created, _ in rows:
        before = [r for r in rows if client is not None and r[1] == client and r[2] < created]
        signed = sum(1 for r in before if r[3] is not None and r[3] < created)
        out[i] = (len(before), signed, max((r[2] for r in before), default=None))
    return out


@pytest.mark.parametrize("target_rows", [1_000_000, 60])
def test_history_is_strictly_prior(spark, target_rows):
    rows, events = random_events(spark)
    got = {
        r.event_id: (r.prior_request_count, r.prior_signed_count, r.prior_last_request_at)
        for r in history.prior_history(events, target_rows=target_rows).collect()
    }
    assert got == expected_history(rows)


def test_hot_client_is_split_in_blocks(spark):
    rows, events = random_events(spark)
    micros = events.select("client_id", F.unix_micros("created_at").alias("at"))
    blocked = prefix.with_block(micros, ["client_id"], ["at"], 16)
    largest = blocked.groupBy("client_id", "block").count().agg(F.max("count")).first()[0]
    assert blocked.select("block").distinct().count() > 10 and largest <= 60 < sum(1 for r in rows if r[1] == 1)


def test_running_sums_over_three_levels(spark):
    """More blocks than one level of totals holds: totals of blocks are summed in blocks again."""
    rng = random.Random(11)
    rows = [(rng.choice([None, 1, 1, 2]), at, rng.randrange(9), rng.randrange(100)) for at in rng.sample(range(5000), 300)]
    points = spark.createDataFrame(rows, "k int, at long, n int, m int")
    kept = [prefix.block_count(points, 8)]
    real, seen = prefix.block_count, []

    def counting(df, target_rows):
        seen.append(real(df, target_rows))
        return seen[-1]

    prefix.block_count = counting
    try:
        got = prefix.running(points, ["k"], "at", {"before": "n"}, {"top": "m"}, blocks=kept[0], target_rows=8).collect()
    finally:
        prefix.block_count = real
    assert kept[0] == 38 and len(seen) >= 2 and seen[0] > 1  # blocks, blocks of their totals, and on
    for r in got:
        earlier = [x for x in rows if x[0] == r.k and x[1] < r["at"]]
        assert r.before == sum(x[2] for x in earlier) and r.top == max((x[3] for x in earlier), default=None)
    assert len(got) == 300


@pytest.mark.parametrize("target_rows", [1_000_000, 20])
def test_kth_smallest_counts_repeats(spark, target_rows):
    rng = random.Random(3)
    values = [rng.randrange(60) for _ in range(300)] + [17] * 100
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    ordered = sorted(values)
    for k in (1, 57, 150, 399, 400):
        value, below = prefix.kth_smallest(df, "v", k, target_rows)
        assert value == ordered[k - 1] and below == sum(1 for v in values if v < value)


@pytest.mark.parametrize("target_rows", [1_000_000, 15])
def test_medians_are_exact(spark, target_rows):
    rng = random.Random(5)
    rows = [
        (rng.random() if rng.random() < 0.8 else None, float(rng.randrange(4)), None) for _ in range(301)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = prefix.medians(df, ["a", "b", "c"], target_rows)
    assert got["a"] == pytest.approx(statistics.median(r[0] for r in rows if r[0] is not None))
    assert got["b"] == statistics.median(r[1] for r in rows)
    assert "c" not in got


@pytest.mark.parametrize("blocks", [1, 7])
def test_spread_rank_is_a_permutation(spark, blocks):
    df = spark.range(200).withColumnRenamed("id", "k")
    ranked = prefix.spread_rank(df, "k", F.xxhash64("k", F.lit(1)), "rank", blocks).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 201))


@pytest.mark.parametrize("target_rows", [1_000_000, 12])
def test_auc_and_average_precision_by_pairs(spark, target_rows):
    rng = random.Random(11)
    rows = [(rng.randrange(25) / 25, int(rng.random() < 0.4)) for _ in range(300)]
    scored = spark.createDataFrame(rows, "probability double, target_signed int")
    got = evaluation.ranking_scores(scored, "target_signed", "probability", target_rows).first()
    positives = [p for p, y in rows if y]
    negatives = [p for p, y in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in positives for b in negatives)
    assert got["roc_auc"] == pytest.approx(wins / len(positives) / len(negatives), abs=1e-12)
    expected, seen = 0.0, 0.0
    for score in sorted({p for p, _ in rows}, reverse=True):
        above = [y for p, y in rows if p >= score]
        recall = sum(above) / len(positives)
        expected += (recall - seen) * sum(above) / len(above)
        seen = recall
    assert got["average_precision"] == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize("target_rows", [1_000_000, 30])
def test_split_takes_the_exact_oldest_share(spark, target_rows):
    rows, events = random_events(spark, 203)
    df = events.select(F.col("id").alias("request_event_id"), F.col("created_at").alias(evaluation.CREATED))
    older, newer = evaluation.temporal_split(df, 0.2, target_rows=target_rows)
    ordered = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    size = int(203 * (1 - 0.2))
    assert {r[0] for r in older.collect()} == set(ordered[:size])
    assert {r[0] for r in newer.collect()} == set(ordered[size:])
