import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomkit.llm import jaccard_join as J
from loomkit.llm.jaccard_join import jaccard_join, keep_one


def sets(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    s = {d: sets(t) for d, t in rows}
    ids = list(s)
    near = {a: {b for b in ids if a != b and s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.8} for a in ids}
    out = {}
    for a in ids:
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[a] = (min(seen), len(near[a]))
    return out


def corpus(n=60, seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(n):
        base = [r.choice(vocab) for _ in range(r.randint(3, 200))]
        for _ in range(r.choice([1, 1, 2, 5])):
            x = list(base)
            for _ in range(r.randint(0, 4)):
                x[r.randrange(len(x))] = r.choice(vocab)
            rows.append((i, " ".join(x)))
            i += 1
    return rows + [(i, ""), (i + 1, None), (i + 2, "  "), (i + 3, "one two"), (i + 4, "one two")]


def got(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit("clash")).withColumn("path", F.lit(1))
    assert got(jaccard_join(df)) == brute(rows)


def near_copies(n, size, seed=5):
    r = random.Random(seed)
    base = [f"w{r.randrange(300)}" for _ in range(size)]
    rows = []
    for i in range(n):
        x = list(base)
        for _ in range(r.randint(1, 3)):
            x[r.randrange(size)] = f"e{r.randrange(9999)}"
        rows.append((i, " ".join(x)))
    return rows


def test_large_groups_take_pivots_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE_ROWS", 16)
    monkeypatch.setattr(J, "LEAF", 8)
    rows = near_copies(70, 150)
    assert got(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_spark_splits_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(J, "MOST", 24)
    r = random.Random(6)
    passage = " ".join(f"p{r.randrange(300)}" for _ in range(60))
    rows = near_copies(40, 150) + [(100 + i, passage + " " + " ".join(f"w{r.randrange(500)}" for _ in range(60))) for i in range(60)]
    rows += [(200 + i, t + " tail") for i, t in rows[40:60]]
    assert got(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("agree", [0.3, 0.5])
def test_pairs_are_found_at_every_depth_of_a_bucket(agree):
    """Members that share a passage are split many times; a pair at the threshold is found about as often as the bound says."""
    r = np.random.default_rng(3)
    n, pairs = 3000, 300
    common = r.integers(0, 16, J.COORDINATES)
    draw = lambda k: np.where(r.random((k, J.COORDINATES)) < agree, common, r.integers(0, 16, (k, J.COORDINATES))).astype(np.uint8)
    m = draw(n)
    p = J.agreement(0.8)
    m[:pairs] = np.where(r.random((pairs, J.COORDINATES)) < p, m[pairs : 2 * pairs], 15 - m[pairs : 2 * pairs])
    at, first = J.Bucket(m, 1, J.agreement(0.8, 3.5), J.agreement(J.LEAVE)).tree()
    head = np.arange(n)
    head[at] = first
    found = (head[:pairs] == head[pairs : 2 * pairs]).mean()
    assert found >= J.below(0.8) - 0.05
    assert (np.bincount(head).max() <= 4)


def test_empty_table_nulls_repeats_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join(none).count() == 0 and keep_one(none).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, ""), (None, None), (1, "other text here")]
    out = sorted(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert len(out) == 7
    assert sorted(r.n_links for r in out) == [0, 0, 0, 0, 2, 2, 2]
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (2, "x  y"), (3, None), (4, ""), (None, "x y"), (None, "alone"), (1, "z z z")], "doc_id long, text string")
    docs = docs.withColumn("row", F.lit("r")).withColumn("mark", F.lit(7)).withColumn("sig", F.array(F.lit(1))).withColumn("a.b", F.lit(2))
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "x y"), (3, None), (4, ""), (None, "alone"), (1, "z z z")], key=str)


def test_many_rows_without_an_id(spark):
    rows = corpus(20, seed=9)[:-5]
    df = spark.createDataFrame([(None, t) for _, t in rows], "doc_id long, text string")
    want = sorted(n for _, n in brute(rows).values())
    assert sorted(r.n_links for r in jaccard_join(df).collect()) == want


def test_very_long_texts(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(5000)}" for _ in range(30_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:29_000])), (3, " ".join(words[15_000:]))]
    assert got(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_runs_grow_with_recall():
    assert J.runs_needed(0.5) < J.runs_needed(0.9) < J.runs_needed(0.999)
    assert (1 - 0.8 * J.below(0.8)) ** J.runs_needed(0.999) < 0.0005
