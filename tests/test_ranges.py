"""Operators give the same rows whether a key lies in one range or in many."""

import random

import pytest
from pyspark.sql import functions as F

from loomkit.operators import aggregates, ranges, sequences


@pytest.fixture(scope="module")
def events(spark):
    """One user has a third of all rows, one is null; some times are shared."""
    r = random.Random(5)
    rows = []
    for n in range(900):
        user = 1 if n % 3 == 0 else r.choice([None, 2, 3, 4, 5, 6])
        rows.append((n, user, r.randrange(4000) * 100, r.choice("aab"), r.choice([None, *range(0, 400, 7)]), r.random() < 0.8, r.choice(["main", "main", "sub"])))
    df = spark.createDataFrame(rows, "event_id long, user_id long, ms long, event_type string, position long, playing boolean, track string")
    return df.withColumn("ts", F.timestamp_millis("ms")).drop("ms").cache()


def rows(df):
    return sorted(map(repr, df.drop(ranges.RANGE).collect()))


def split(df, key="user_id", order=("ts", "event_id"), n=60):
    out = ranges.ranged(df, key, list(order), n)
    assert out.groupBy(key).agg(F.count_distinct(ranges.RANGE).alias("n")).agg(F.max("n")).first()[0] > 3
    return out


def test_ranges_hold_ties_together_and_follow_one_another(events):
    out = split(events, order=("ts",)).groupBy("user_id", ranges.RANGE).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    for x in out:
        for y in out:
            if x.user_id == y.user_id and x[1] < y[1]:
                assert x.b < y.a


def test_small_tables_keep_one_range(events):
    assert ranges.ranged(events, "user_id", ["ts"]).columns == events.columns


@pytest.mark.parametrize("job", [
    sequences.collapse_repeats,
    lambda e: sequences.remove_key_and_collapse(e, "b"),
    lambda e: sequences.burst_ratio(e, 3.0, 4),
    lambda e: sequences.burst_ratio(e, 40.0, 15),
    lambda e: sequences.drift_events(e, 100, "user_id"),
    lambda e: sequences.clamped_running_product(e.withColumn("up", F.col("event_type") == "a"), "user_id", ["ts", "event_id"], "up", chunk=7).withColumn("zoom", F.round("zoom", 9)),
    lambda e: sequences.collapse_repeats(e.where("event_id % 3 = 0 or event_id % 50 = 1")),
])
def test_windows(events, job):
    assert rows(job(split(events))) == rows(job(events))


@pytest.mark.parametrize("threshold", [20, 100, 250])
def test_drift_ticks(events, threshold):
    e = events
    assert rows(sequences.drift_ticks(e, threshold, 1000, "user_id", rows=40)) == rows(sequences.drift_ticks(e, threshold, 1000, "user_id"))
    # sub seldom moves, so that one place must be carried over many ranges.
    still = e.withColumn("track", F.when(F.col("event_id") % 97 == 5, "sub").otherwise("main")).withColumn("playing", F.lit(True))
    found = rows(sequences.drift_ticks(still, threshold, 1000, "user_id", rows=30))
    assert found == rows(sequences.drift_ticks(still, threshold, 1000, "user_id")) and found


def test_next_exceeding():
    import numpy as np

    r = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 64, 200):
        v = r.integers(0, 50, n).astype(float)
        want = [next((j for j in range(i + 1, n) if abs(v[j] - v[i]) > 20), n) for i in range(n)]
        assert sequences.next_exceeding(v, 20).tolist() == want


def test_a_session_of_many_ticks(spark):
    """200,000 ticks between two rows of sub, in ranges of 20,000."""
    n = 200_000
    p = spark.range(n).select(F.lit(1).alias("session_id"), F.when(F.col("id") == 0, "sub").otherwise("main").alias("track"), F.timestamp_millis(F.col("id") * 200).alias("ts"), F.col("id").alias("event_id"), (F.col("id") * 7 % 1000).alias("position"), F.lit(True).alias("playing"))
    at, want = 0, 0
    for i in range(1, n):
        if abs(i * 7 % 1000 - at) > 150:
            at, want = i * 7 % 1000, want + 1
    assert sequences.drift_ticks(p, rows=20_000).count() == want


def ops(spark, seed, kinds):
    r = random.Random(seed)
    out = [(1 if n % 3 else r.choice([None, 2, 3, 4]), n, r.choice(kinds), r.choice("abcd")) for n in range(500)]
    return spark.createDataFrame(out, "user_id long, seq long, op string, key string")


@pytest.mark.parametrize("default", [None, "a"])
@pytest.mark.parametrize("kinds", [["push", "pop", "remove"], ["push", "push", "pop"], ["pop", "remove"]])
def test_replay_history(spark, kinds, default):
    o = ops(spark, 3, kinds)
    assert rows(sequences.replay_history(o, default=default, rows=25)) == rows(sequences.replay_history(o, default=default))


@pytest.mark.parametrize("kinds", [["push", "pop", "select"], ["push"], ["pop", "select"]])
def test_breadcrumb_trail(spark, kinds):
    o = ops(spark, 4, kinds)
    assert rows(sequences.breadcrumb_trail(o, rows=25)) == rows(sequences.breadcrumb_trail(o))


def test_shorter_lists_do_the_same_to_any_history():
    r = random.Random(8)
    for _ in range(3000):
        before = [(r.choice(["push", "push", "pop", "remove"]), r.choice("abc")) for _ in range(r.randrange(8))]
        some = [(r.choice(["push", "push", "pop", "remove"]), r.choice("abc")) for _ in range(r.randrange(12))]
        for default in (None, "a"):
            assert sequences.replay(before + sequences.condensed(some), default) == sequences.replay(before + some, default)
        twice = sequences.condensed(sequences.condensed(some[:6]) + sequences.condensed(some[6:]))
        assert sequences.replay(before + twice) == sequences.replay(before + some)
        moves = [(r.choice(["push", "push", "pop", "select"]), r.choice("abcd")) for _ in range(r.randrange(12))]
        trod = [(r.choice(["push", "push", "select"]), r.choice("abcd")) for _ in range(r.randrange(8))]
        assert sequences.trail(trod + sequences.settled(moves)) == sequences.trail(trod + moves)


def test_pushes_and_pops_cancel_out():
    assert sequences.condensed([("push", "a"), ("push", "b"), ("pop", None)] * 50) == [("push", "a")]


def items(spark, seed=2, n=400):
    r = random.Random(seed)
    out = [(1 if k % 3 else r.choice([None, 2, 3]), k, r.choice([0, 5, 20, 40, 130]), r.choice([0, 0, 10, 25])) for k in range(n)]
    return spark.createDataFrame(out, "group_id long, pos long, size long, height long")


def packed(values, width, spacing, gap):
    """Row by row as a layout does it."""
    out, row, x, y, high = [], 0, 0, 0, 0
    for pos, size, height in values:
        if x + size > width and high > 0:
            row, x, y, high = row + 1, 0, y + high + gap, 0
        out.append([pos, row, x, y])
        x, high = x + size + spacing, max(high, height)
    return out


@pytest.mark.parametrize("width", [100, 300, 2000])
def test_pack_rows(spark, width):
    t = items(spark)
    want, heights = [], {}
    all_rows = [tuple(r) for r in t.orderBy("group_id", "pos").collect()]
    for g in {r[0] for r in all_rows}:
        of = [r for r in all_rows if r[0] == g]
        for (pos, row, x, y), r in zip(packed([r[1:] for r in of], width, 3, 5), of, strict=True):
            want.append([g, pos, row, float(x), float(y)])
            heights[g, row] = max(heights.get((g, row), 0), r[3])
    want = sorted(map(repr, ([*w, float(heights[w[0], w[2]])] for w in want)))
    for n in (30, 1000):
        found = sequences.pack_rows(t, width, 3, 5, rows=n).select("group_id", "pos", "row", "x", "y", "row_height").collect()
        assert sorted(repr(list(r)) for r in found) == want


def test_pack_nothing(spark):
    t = items(spark).where("false")
    assert sequences.pack_rows(t, 10, 1).count() == 0


@pytest.mark.parametrize("job", [
    lambda i: aggregates.fit_budget_tail(i, 700, 20), lambda i: aggregates.fit_budget_head(i, 700, 30, 4),
    lambda i: aggregates.fit_budget_head(i, 700, 30, 4, hidden=True), lambda i: aggregates.fit_budget_head(i, 10**6, 30, 4)])
def test_budgets(spark, job):
    t = items(spark)
    assert rows(job(split(t, "group_id", ["pos"], 50))) == rows(job(t))


def test_head_budget_takes_no_spacing_before_the_first(spark):
    t = spark.createDataFrame([(1, k, 50) for k in range(3)], "group_id int, pos int, size int")
    assert [r.shown for r in aggregates.fit_budget_head(t, 130, 20, 10).orderBy("pos").collect()] == [True, True, False]
    # 170 are needed for the three, and 200 with the button.
    assert all(r.shown for r in aggregates.fit_budget_head(t, 170, 20, 10).collect())
    assert not all(r.shown for r in aggregates.fit_budget_head(t, 179, 20, 10, hidden=True).collect())
