"""Operator 6: toxicity scores from a factorization machine over hashed terms (Rendle 2010).

The machine's score is w0 + sum of weights + sum over pairs of <v_i, v_j>, so that terms that
are harmless alone count together. Every term of the training rows, hashed into ``BUCKETS``,
may become one of its features, by either part of that sum: terms that tell the classes apart
alone (the likelihood ratio of their document counts), and terms of *pairs* that do. A first
machine learns from the former; for every pair of the other terms, however rare, the labels of
the rows that hold both are compared with what that machine expects there, and pairs that are
further out than chance makes any of them bring their terms in, however little each of them
says alone. The last machine learns weights and factors of all these terms.

It is trained by iterative parameter mixing (McDonald et al. 2010): in each round every shard
of the rows trains from the common parameters, and their mean starts the next round. Pairs are
looked at exactly: terms whose rows the machine explains so well that no pair of theirs can be
far out are set aside first, and the others' pairs are dealt to tasks by the groups of their
terms, so that a pair's rows meet in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, WordHashes, few, fields, fold, mapped, pieces, saved

BUCKETS, FACTORS = 1 << 22, 8
#: The least likelihood ratio of a term alone, and how many standard deviations a pair must be out.
LEAST_RATIO, LEAST_PAIR = 12.0, 5.5
#: The chance that any pair is found where none tells, and the least chance that the machine is taken to give a class.
CHANCE, LEAST_CHANCE = 0.05, 0.005
#: Labelled rows that the machine is learned from at most.
TRAINING_ROWS = 40_000
TOXIC = 0.7
#: The weight of class 1 when it is the rarer one: the odds, but not more than this.
MOST_WEIGHT = 10.0
SHARDS, ROUNDS, EPOCHS, RATE, DECAY = 6, 6, 6, 0.3, 1e-5
#: Terms are dealt to groups; the pairs of two groups, or of one with itself, are one task's.
GROUPS = 4


def _terms(batches):
    hashes = WordHashes()
    for batch in pieces(batches):
        terms = [np.unique(hashes.of(WORD.findall((t or "").lower())) % np.uint64(BUCKETS)).astype(np.int32) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("shard"), pa.array(terms, pa.list_(pa.int32()))], ["doc_id", "label", "shard", "terms"])


class Features(dict):
    """word -> number of its feature, or -1."""

    def __init__(self, buckets: list[int]):
        super().__init__()
        self.at, self.hashes = {b: k for k, b in enumerate(buckets)}, WordHashes()

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        k = self[word] = self.at.get(self.hashes[word] % BUCKETS, -1)
        return k

    def of(self, text: str | None) -> list[int]:
        found = set(map(self.__getitem__, WORD.findall((text or "").lower())))
        found.discard(-1)
        return sorted(found)


def _dense(rows: list, width: int) -> np.ndarray:
    x = np.zeros((len(rows), width), np.float32)
    for k, r in enumerate(rows):
        x[k, r] = 1
    return x


def _value(x: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return w0 + x @ w + 0.5 * ((x @ v) ** 2 - x @ (v * v)).sum(1)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _shards(batches):
    """(shard, terms, labels) of each shard, whose rows stand together; a shard holds a bounded share of the training rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cut = [0, *(np.nonzero(shard[1:] != shard[:-1])[0] + 1).tolist(), len(shard)]
        for lo, hi in zip(cut, cut[1:], strict=False):
            if held and hi > lo and held[-1].column("shard")[0].as_py() != int(shard[lo]):
                yield _shard(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield _shard(held)


def _shard(held: list[pa.RecordBatch]):
    t = pa.Table.from_batches(held)
    return t["shard"][0].as_py(), [np.asarray(x, np.int32) for x in t["terms"].to_pylist()], t["label"].to_numpy().astype(np.float32)


def _features(rows: list[np.ndarray], buckets: np.ndarray) -> list[np.ndarray]:
    """The numbers of each row's terms among the sorted ``buckets``."""
    if not len(buckets):
        return [np.zeros(0, int)] * len(rows)
    at = [np.searchsorted(buckets, r).clip(max=len(buckets) - 1) for r in rows]
    return [k[buckets[k] == r] for k, r in zip(at, rows, strict=True)]


def _round(p: np.ndarray, buckets: np.ndarray, turn: int, positive: float):
    """Each shard's epochs of AdaGrad from the parameters ``p``, rows of class 1 weighing ``positive``; gives (parameters, rows)."""
    width = len(buckets)

    def run(batches):
        for shard, terms, y in _shards(batches):
            rows, q, rng = _features(terms, buckets), p.copy(), np.random.default_rng([turn, shard])
            square = np.full(len(q), 1e-2, np.float32)
            for _ in range(EPOCHS):
                order = rng.permutation(len(rows))
                for lo in range(0, len(rows), 128):
                    at = order[lo : lo + 128]
                    x, w, v = _dense([rows[k] for k in at], width), q[1 : 1 + width], q[1 + width :].reshape(width, FACTORS)
                    g = (_sigmoid(_value(x, q[0], w, v)) - y[at]) * np.where(y[at] == 1, positive, 1) / len(at)
                    dv = x.T @ (g[:, None] * (x @ v)) - v * (x.T @ g)[:, None]
                    d = np.concatenate([[g.sum()], x.T @ g + DECAY * w, (dv + DECAY * v).ravel()]).astype(np.float32)
                    square += d * d
                    q -= RATE * d / np.sqrt(square)
            yield pa.RecordBatch.from_arrays([pa.array([q.tobytes()], pa.binary()), pa.array([len(rows)], pa.int64())], ["p", "n"])

    return run


def _chances(terms: list[np.ndarray], machine: Machine, positive: float) -> np.ndarray:
    """The machine's chances of label 1, without the weight of class 1."""
    s = machine.score(_features(terms, np.array(machine.buckets, np.int64))).astype(float)
    return np.clip(s / (s + (1 - s) * positive), LEAST_CHANCE, 1 - LEAST_CHANCE)


def _deviance(positive: np.ndarray, n: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Twice the Chernoff exponent of ``positive`` of ``n`` rows where ``expected`` are: with what chance e**(-d/2) at most they come about, on either side."""
    e = np.clip(expected, LEAST_CHANCE * n, (1 - LEAST_CHANCE) * n)
    part = lambda k, of: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / of), 0.0)
    return 2 * (part(positive, e) + part(n - positive, n - e))


def _left(machine: Machine, positive: float):
    """(row, terms, y, s, deviance) of each training row: its label, the chance by the machine, and how far the one is from the other."""
    def run(batches):
        for shard, terms, y in _shards(batches):
            s = _chances(terms, machine, positive)
            row = np.arange(len(y), dtype=np.int64) + (shard << 40)
            columns = (row, pa.array(terms, pa.list_(pa.int32())), y.astype(float), s, _deviance(y, np.ones(len(y)), s))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "terms", "y", "s", "deviance"])

    return run


def _dealt(held: np.ndarray):
    """(block, row, y, s, a, b): the row's terms among ``held`` for each pair of their groups, as places within the group."""
    def run(batches):
        for batch in pieces(batches):
            out = []
            for row, terms, y, s in zip(*(batch.column(c).to_pylist() for c in ("row", "terms", "y", "s")), strict=True):
                at = _features([np.asarray(terms, np.int64)], held)[0]
                parts = [at[at % GROUPS == g] // GROUPS for g in range(GROUPS)]
                out += [(i * GROUPS + j, row, y, s, parts[i], parts[j]) for i in range(GROUPS) for j in range(i, GROUPS) if len(parts[i]) and len(parts[j])]
            columns, ints = list(zip(*out, strict=True)) or [[]] * 6, pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.float64(), pa.float64(), ints, ints), strict=True)], ["block", "row", "y", "s", "a", "b"])

    return run


def _pair_sums(a: list[np.ndarray], b: list[np.ndarray], y: np.ndarray, s: np.ndarray, width: int):
    """For each term of ``a`` in order: (term, rows, positive rows, expected ones, variance), the sums by term of ``b`` over the rows that hold both."""
    size = np.array([len(r) for r in b])
    start, flat = np.cumsum(size) - size, np.concatenate(b)
    owner, term = np.repeat(np.arange(len(a)), [len(r) for r in a]), np.concatenate(a)
    order = np.argsort(term, kind="stable")
    owner, term = owner[order], term[order]
    cut = np.nonzero(np.diff(term, prepend=-1))[0]
    for k, rows in zip(term[cut].tolist(), np.split(owner, cut[1:]), strict=True):
        n = size[rows]
        at = np.arange(n.sum()) + np.repeat(start[rows] - (np.cumsum(n) - n), n)
        with_ = flat[at]
        sums = [np.bincount(with_, np.repeat(x, n), width) for x in (y[rows], s[rows], s[rows] * (1 - s[rows]))]
        yield k, np.bincount(with_, minlength=width).astype(float), *sums


def _found(alone: np.ndarray, least: float):
    """(term): the places among all terms of those in a pair of the block that lies ``least`` out, from what the machine expects and from what either term, or both, say by themselves."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        i, j = divmod(table["block"][0].as_py(), GROUPS)
        a, b = ([np.asarray(x, np.int64) for x in table[c].to_pylist()] for c in ("a", "b"))
        y, s = table["y"].to_numpy(), table["s"].to_numpy()
        there = alone[j::GROUPS]
        found: set[int] = set()
        for k, n, o, e, v in _pair_sums(a, b, y, s, len(there)):
            here = k * GROUPS + i
            at = np.nonzero(n)[0]
            at = at[at * GROUPS + j != here]
            at = at[_deviance(o[at], n[at], e[at]) >= least]
            o, n, e, v, side = o[at], n[at], e[at], v[at], np.sign(o[at] - e[at])
            far = np.ones(len(at), bool)
            for says in (alone[here], there[at], alone[here] + there[at]):
                x = e + v * says
                far &= (_deviance(o, n, x) >= least) & (np.sign(o - x) == side)
            if far.any():
                found |= {here, *(at[far] * GROUPS + j).tolist()}
        return pa.table({"term": pa.array(sorted(found), pa.int32())})

    return run


class Machine:
    def __init__(self, buckets: list[int], p: np.ndarray):
        self.buckets, self.p = buckets, p

    def score(self, rows: list) -> np.ndarray:
        k = len(self.buckets)
        out = [_value(_dense(rows[lo : lo + 2048], k), self.p[0], self.p[1 : 1 + k], self.p[1 + k :].reshape(k, FACTORS)) for lo in range(0, len(rows), 2048)]
        return _sigmoid(np.concatenate(out)) if out else np.zeros(0)


def _trained(train: DataFrame, buckets: list[int], positive: float) -> Machine:
    k, held = len(buckets), np.array(buckets, np.int64)
    p = np.random.default_rng(7).normal(0, 0.05, 1 + k + k * FACTORS).astype(np.float32)
    p[: 1 + k] = 0
    for turn in range(ROUNDS):
        parts = train.mapInArrow(_round(p, held, turn, positive), "p binary, n long").collect()
        size = sum(r.n for r in parts)
        if not size:
            break
        p = sum(np.frombuffer(r.p, np.float32) * np.float32(r.n / size) for r in sorted(parts, key=lambda r: (r.n, r.p)))
    return Machine(buckets, p)


def _alone(counts: DataFrame, n1: float, n0: float) -> list[int]:
    """The buckets whose document counts by class have a likelihood ratio of ``LEAST_RATIO``."""
    part = lambda c, total, both: F.when(c > 0, c * F.log(c * (n1 + n0) / (total * both))).otherwise(0.0)
    k1, k0 = F.col("n1"), F.col("n") - F.col("n1")
    both, none = k1 + k0, (n1 + n0) - k1 - k0
    ratio = 2 * (part(k1, n1, both) + part(k0, n0, both) + part(n1 - k1, n1, none) + part(n0 - k0, n0, none))
    return sorted(r.term for r in counts.where(ratio >= LEAST_RATIO).select("term").collect())


def _together(train: DataFrame, machine: Machine, positive: float) -> list[int]:
    """The buckets of the terms that stand in a pair that lies ``LEAST_PAIR`` standard deviations out, and so far that chance gives none among all pairs looked at."""
    rows = saved(train.mapInArrow(_left(machine, positive), "row long, terms array<int>, y double, s double, deviance double"))
    least = LEAST_PAIR**2
    # A pair is no further out than the rows that hold it are together (the log-sum inequality), nor these than all rows of either term.
    sums = rows.select("y", "s", "deviance", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("deviance").alias("deviance"), F.sum(F.expr("y - s")).alias("left"), F.sum(F.expr("s * (1 - s)")).alias("spread"))
    held = sums.where(F.col("deviance") >= least).orderBy("term").toArrow()
    m = held.num_rows
    least = max(least, 2 * math.log(max(1, m * (m - 1)) / CHANCE))
    held = held.filter(pc.greater_equal(held["deviance"], least))
    if held.num_rows < 2:
        return []
    terms, alone = held["term"].to_numpy().astype(np.int64), held["left"].to_numpy() / held["spread"].to_numpy()
    dealt = rows.mapInArrow(_dealt(terms), "block int, row long, y double, s double, a array<int>, b array<int>")
    found = dealt.groupBy("block").applyInArrow(_found(alone, least), "term int").distinct().collect()
    return [int(terms[r.term]) for r in found]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", training_rows: int = TRAINING_ROWS) -> Machine:
    """Learned from the texts of ``docs`` whose doc_id has a 0/1 ``label`` in ``labels``.

    At most about ``training_rows`` labelled rows, chosen by a hash of doc_id, are used; that
    bounded set of ids is what is broadcast, and the bound limits the terms and pairs that are
    looked at. Null ids, other labels and null labels are left out; a repeated
    label or document counts as often as it stands; null texts count as empty. Without labels of
    both classes every text scores the same: 0.5 of none, else near the class there is.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    share = training_rows / max(1, usable.count())
    sample = usable if share >= 1 else usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1e6))
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = float(n.get(1, 0)), float(n.get(0, 0))
    if not n1 or not n0:
        p = np.zeros(1, np.float32)
        p[0] = 0 if n1 == n0 else 5 if n1 else -5
        return Machine([], p)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int"))
    train = saved(rows.select("doc_id", "label", "shard", "text").mapInArrow(
        _terms, fields(rows, ("label", "text"), label=T.IntegerType(), shard=T.IntegerType(), terms=T.ArrayType(T.IntegerType()))))
    counts = saved(few(train.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("n1"))))
    train = saved(few(train.repartition(SHARDS, "shard").sortWithinPartitions("shard", "doc_id", "label", "terms")))
    positive = min(MOST_WEIGHT, max(1.0, n0 / n1))
    alone = _alone(counts, n1, n0)
    machine = _trained(train, alone, positive)
    together = _together(train, machine, positive)
    every = sorted({*alone, *together})
    return machine if every == alone else _trained(train, every, positive)


def score(docs: DataFrame, machine: Machine, keep_text: bool = False) -> DataFrame:
    """``docs`` (text and any other columns) with the column score, the chance of label 1; text goes unless it is kept, and a column named score is replaced.

    Whole texts count, null ones as empty. A row in, a row out, equal texts with equal scores.
    """
    keep = [c for c in docs.columns if (keep_text or c != "text") and c != "score"]

    def run(batches):
        of = Features(machine.buckets).of
        for batch in pieces(batches):
            s = machine.score([of(t) for t in batch.column("text").to_pylist()]).astype(float)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s)], [*keep, "score"])

    return mapped(docs, run, fields(docs, () if keep_text else ("text",), score=T.DoubleType()))


def training_labels(labels: DataFrame) -> DataFrame:
    """The label rows that models learn from: those whose crc32(doc_id as text) mod 3 is not 1."""
    return labels.where(fold(F.col("doc_id"), 3) != 1)
