"""Operators 11 to 13 held against the library itself and against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomkit.llm import hard_negatives, lexical_search, sentencepieces

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# Operator 11

LONG = "".join(random.Random(1).choice("abcdefgh  \n") for _ in range(200_000))
TEXTS = [
    None, "", " ", "  ", "\n", "\n\n x", "a", "Hello  world ", " lead", "trail ", "▁mark ▁▁ two", "tabs\tand\r\nlines\r", "é é ﬁ 　 \xa0x", "你好，世界 こんにちは", "emoji 👩‍👩‍👧 \U0001f600", "nul\x00 \x00", "<s> </s> <unk> <0x0A>",
    "﻿bom ​ zero", "a" * 5000, "word\nword\nword \n word", "x" * 300 + " " * 40 + "y", "\t" * 9, LONG, LONG, "same text", "same text"]


def expected(text):
    sp = sentencepieces.segmenter(MODEL).model
    ids = sp.encode(text or "", add_bos=True, add_eos=True)
    return ids, sp.decode(ids)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)


def test_pieces_equal_the_library(spark, texts, monkeypatch):
    got = {r.doc_id: r for r in sentencepieces.decode(sentencepieces.encode(texts, MODEL), MODEL).collect()}
    assert len(got) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        ids, back = expected(text)
        assert got[k].ids == ids and got[k].text == back
    digests = {r.doc_id: r for r in sentencepieces.digest(sentencepieces.decode(sentencepieces.encode(texts, MODEL), MODEL)).collect()}
    for k, text in enumerate(TEXTS):
        ids, back = expected(text)
        assert tuple(digests[k])[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


@pytest.mark.parametrize("block_words", [1, 40, 3000])
def test_blocks_that_end_within_a_partition(spark, texts, block_words):
    some = texts.where("doc_id <> 23").repartition(2)
    got = {r.doc_id: r.ids for r in sentencepieces.encode(some, MODEL, block_words=block_words).collect()}
    assert got == {k: expected(t)[0] for k, t in enumerate(TEXTS) if k != 23}


def test_words_of_random_texts():
    r = random.Random(7)
    words = ["the", "Gefäß", "niño", "x1y2", "▁", "…", "日本", "\n", "a\nb", "", " "]
    for _ in range(300):
        text = "".join(r.choice(words) + r.choice([" ", " ", "", "\n", "  "]) for _ in range(r.randrange(12)))
        seg = sentencepieces.segmenter(MODEL)
        cut = seg.cut(text)
        assert "".join(cut) == seg.model.normalize(text)
        assert [i for ids in seg.ids(cut) for i in ids] == seg.model.encode(text)


def test_places_survive_packing():
    r = np.random.default_rng(2)
    for n, base in ((0, 0), (1, 0), (50, 0), (50, 20)):
        known, places = base, []
        for _ in range(n):
            k = int(r.integers(0, known + 1))
            known += k == known
            places.append(k)
        places = np.array(places, np.uint32)
        packed = sentencepieces._packed(sentencepieces._marked(places, base))
        assert (sentencepieces._placed(sentencepieces._unpacked(packed), base) == places).all()


def test_other_columns_and_empty_tables_of_pieces(spark, texts):
    clash = texts.withColumnsRenamed({"text": "block"}).withColumn("a.b", F.lit(1)).withColumn("ids_", F.lit(None).cast("string"))
    out = sentencepieces.encode(clash, MODEL, "block")
    assert out.columns == ["doc_id", "a.b", "ids_", "ids"]
    assert {r.doc_id: r.ids for r in out.collect()} == {k: expected(t)[0] for k, t in enumerate(TEXTS)}
    assert sentencepieces.encode(texts.where("false"), MODEL).count() == 0
    assert sentencepieces.encode(texts.where("doc_id < 2"), MODEL).select("ids").collect() == [([1, 2],), ([1, 2],)]
    assert sentencepieces.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>"), MODEL).first().text == ""


# Operator 12

def brute_negatives(rows):
    """rows: (vec_id, label, parts, is_anchor), all of whom take part."""
    out = []
    by = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a, (anchor, label, parts, chosen) in enumerate(rows):
        if not chosen:
            continue
        scored = [(sum(x * y for x, y in zip(parts, p, strict=False)), v, k) for b, (v, k, p, _) in enumerate(rows) if a != b]
        for score, positive, _ in sorted((s for s in scored if s[2] == label), key=by)[:5]:
            fit = sorted((s for s in scored if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score), key=by)[:5]
            out += [(anchor, positive, n, v, score, s) for n, (s, v, _) in enumerate(fit, 1)]
    return out


def mined(spark, rows, parts=5, **blocks):
    df = spark.createDataFrame(rows, "vec_id long, label int, parts array<long>, is_anchor boolean").repartition(parts)
    return [tuple(r) for r in hard_negatives.mine(df, **blocks).collect()]


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


@pytest.mark.parametrize("high", [3, 90, 40_000, 2**29])
def test_negatives_equal_brute_force(spark, high):
    """Small numbers tie often; the largest don't fit into fields of 53 bits."""
    r = random.Random(high)
    rows = [(v, r.randrange(3), [r.randint(-high, high) for _ in range(6)], v % 10 == 0) for v in range(150)]
    want = brute_negatives(rows)
    assert same(mined(spark, rows), want)
    # Blocks that end within a partition, and several blocks of anchors of each.
    assert same(mined(spark, rows, 2, block=16, anchor_block=3), want)


def test_negatives_of_repeated_null_and_uneven_rows(spark):
    r = random.Random(3)
    rows = [(v, r.randrange(2), [r.randint(0, 4) for _ in range(r.randrange(5))], v % 9 == 0) for v in range(60)]
    rows += rows[:4] + [(None, 0, [4, 4, 4], False), (None, 1, [4, 4, 4], False)]
    got, want = mined(spark, rows), brute_negatives(rows)
    assert same([(a, p, n, s, t) for a, p, n, _, s, t in got], [(a, p, n, s, t) for a, p, n, _, s, t in want])
    out = [(1, None, [1], True), (2, 1, None, True)]
    assert mined(spark, out) == [] and mined(spark, rows[:0]) == []
    assert same(mined(spark, rows[:40] + out), brute_negatives(rows[:40]))


def test_a_vector_that_most_rows_share(spark):
    r = random.Random(4)
    rows = [(v, v % 4, [7, 7, 7] if v % 3 else [r.randint(-9, 9) for _ in range(3)], v % 20 == 0) for v in range(200)]
    assert same(mined(spark, rows, 1), brute_negatives(rows))


def test_anchors_are_not_broadcast_to_their_buckets(spark):
    """The copies of anchors, one for each bucket, must not go by way of the driver, however small their file is."""
    rows = [(v, v % 3, [v % 7, v % 11], v % 5 == 0) for v in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label int, parts array<long>, is_anchor boolean")
    out = hard_negatives.mine(df, block=8, anchor_block=4)
    assert same([tuple(r) for r in out.collect()], brute_negatives(rows))
    assert "Broadcast" not in out._jdf.queryExecution().toString()


def test_a_bucket_of_several_files(spark, monkeypatch):
    """Blocks of a bucket lie in files of bounded size, for Spark reads a file's blocks at once."""
    dealt = []
    blocks = hard_negatives._blocks
    monkeypatch.setattr(hard_negatives, "_blocks", lambda rows, *more: dealt.append(rows.rdd.getNumPartitions()) or blocks(rows, *more))
    r = random.Random(6)
    rows = [(v, r.randrange(4), [r.randint(-20, 20) for _ in range(4)], v % 40 == 0) for v in range(600)]
    assert same(mined(spark, rows, block=1), brute_negatives(rows))
    assert dealt[0] * hard_negatives.BATCH >= len(rows)


@pytest.mark.parametrize("labels", [1, 2, 9, 700])
def test_limits_that_rise_over_blocks_and_labels(spark, labels):
    """Enough rows that a label's, or a block's, are looked at in several steps; components at the ends of a byte."""
    r = random.Random(labels)
    rows = [(v, r.randrange(labels), [r.choice((-128, 128, r.randint(-128, 128))) for _ in range(5)], v % 60 == 0) for v in range(1500)]
    want = brute_negatives(rows)
    assert same(mined(spark, rows), want)
    assert same(mined(spark, rows, 3, block=400, anchor_block=7), want)


def test_vectors_that_take_no_part(spark):
    rows = [([1.0, 2.0],), (None,), ([1.0, None],), ([float("nan")],), ([float("inf"), 0.0],), ([-0.001, 1e300],)]
    df = spark.createDataFrame(rows, "embedding array<double>")
    assert [r[0] for r in df.select(hard_negatives.usable(F.col("embedding"))).collect()] == [True, False, False, False, False, True]
    assert df.select(hard_negatives.whole_parts(F.col("embedding"))).collect()[-1][0] == [-1, 2**63 - 1]


@pytest.mark.parametrize("bias,size", [(1, 1), (160, 64), (3000, 64), (2**20, 3)])
def test_packed_products_are_exact(bias, size):
    r = np.random.default_rng(5)
    width = (size * (2 * bias) ** 2).bit_length()
    anchors, rows = (r.integers(-bias, bias + 1, (n, size)) for n in (7, 33))
    rows[0], anchors[0] = bias, -bias
    found = hard_negatives.products(anchors, hard_negatives.pack(rows, bias, width), rows.sum(1), bias, width)
    assert (found == anchors @ rows.T).all()


# Operator 13

def brute_search(docs, items, k=20):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    texts = [(d, Counter(term.findall(lower(t)))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, c in texts if c), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(term.findall(lower(text))), []
        for d, c in texts:
            n, score = sum(c.values()), 0
            for t, times in asked.items():
                if c[t]:
                    m = 100 - 25 + (25 * n * n_docs) // n_terms
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def searched(spark, docs, items, **shards):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index, n = lexical_search.build(d, **shards)
    return [tuple(r) for r in lexical_search.search(index, n, spark.createDataFrame(items, "item_id long, text string")).collect()]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(6)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(400)] + ["Über", "naïve", "x-y", "A1"]
    docs = [(k, " ".join(r.choice(words) for _ in range(int(r.paretovariate(0.7)) % 900))) for k in range(700)]
    docs += [(1000 + k, docs[5][1]) for k in range(60)] + [(2000, None), (2001, ""), (2002, "!!! --"), (7, docs[7][1]), (None, docs[9][1]), (2003, "w1 " * 40_000)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 40)))) for k in range(12)]
    return docs, [*items, (50, docs[5][1]), (51, "w1 W1 w2"), (52, None), (53, "unheard"), (54, ""), (51, "über w3"), (None, "w4 w5")]


def test_search_equals_brute_force(spark, corpus):
    want = brute_search(*corpus)
    assert same(searched(spark, *corpus), want)
    assert same(searched(spark, *corpus, shard_docs=60, shard_terms=2000), want)


def test_search_of_nothing(spark, corpus):
    docs, items = corpus
    assert searched(spark, docs[:0], items) == [] and searched(spark, docs[:5], items[:0]) == []
    assert searched(spark, [(1, None), (2, "??")], items) == []


def test_windows_and_blocks_reject_without_loss():
    """Many shards' worth of postings, in windows of every size: the best are those of adding everything up, and blocks stay compressed."""
    r = np.random.default_rng(8)
    for _ in range(60):
        n, k = int(r.integers(1, 3000)), int(r.integers(1, 25))
        lists, total = [], np.zeros(n, np.int64)
        for share in r.choice([0.9, 0.3, 0.02, 0.002], r.integers(1, 9)):
            at = np.flatnonzero(r.random(n) < share)
            if not len(at):
                continue
            impact, w = r.integers(1, 40, len(at)), int(r.integers(1, 30))
            total[at] += w * impact
            data, size = lexical_search.packed(np.stack([np.diff(np.r_[-1, at]), impact], 1).ravel())
            firsts = np.arange(0, len(at), lexical_search.BLOCK)
            ends = np.cumsum(size.reshape(-1, 2).sum(1))
            lasts = np.r_[firsts[1:], len(at)] - 1
            lists.append((w, lexical_search.Postings(at[lasts], np.maximum.reduceat(impact, firsts), ends[lasts], data.tobytes())))
        found, scores = lexical_search.evaluate(lists, n, k, first=int(r.integers(1, 600)))
        order = np.lexsort((np.arange(n), -total))[:k]
        order = order[total[order] > 0]
        assert found.tolist() == order.tolist() and scores.tolist() == total[order].tolist()


def test_blocks_of_hopeless_candidates_stay_compressed():
    n = 60_000
    rare, common = np.arange(0, n, 997), np.arange(n)
    def postings(at, impact):
        data, size = lexical_search.packed(np.stack([np.diff(np.r_[-1, at]), impact], 1).ravel())
        firsts = np.arange(0, len(at), lexical_search.BLOCK)
        lasts = np.r_[firsts[1:], len(at)] - 1
        return lexical_search.Postings(at[lasts], np.maximum.reduceat(impact, firsts), np.cumsum(size.reshape(-1, 2).sum(1))[lasts], data.tobytes())
    impact = np.ones(n, np.int64)
    impact[:2000] = 50
    many, few = postings(common, impact), postings(rare, np.full(len(rare), 100))
    found, _ = lexical_search.evaluate([(1, many), (100, few)], n, 2)
    assert found.tolist() == [0, 997] and many.whole is None and many.read < len(many.data) / 10


@pytest.mark.parametrize("values", [[], [0], [127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 1]])
def test_packed_numbers(values):
    data, size = lexical_search.packed(np.array(values, np.int64))
    assert lexical_search.unpacked(data).tolist() == values and size.sum() == len(data)


def test_texts_are_digested_where_they_are_decoded(spark):
    """The same rows as by way of the texts, with one step of Python after the ids are joined up."""
    encoded = sentencepieces.encode(spark.createDataFrame([(1, "Some text\nof two lines"), (2, ""), (3, None), (4, "\u6f22\u5b57 \U0001f600")], "doc_id int, text string"), MODEL)
    out = sentencepieces.digest(encoded, MODEL)
    assert sorted(out.collect()) == sorted(sentencepieces.digest(sentencepieces.decode(encoded, MODEL)).collect())
    steps = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert steps(out) == steps(encoded) + 1
