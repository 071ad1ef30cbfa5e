"""Operator 4: quality scores from a regularised quadratic discriminant (Friedman 1989).

Each text is described by a dozen transformed statistics. Each class has a mean and a
covariance, shrunk towards the pooled covariance and then towards its diagonal; the score is
the logistic of the difference of the two Gaussian log densities plus the log prior odds. The
Cholesky factors are computed once and used for every row.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, mapped, pieces

STATISTICS = ("words", "word_length", "distinct", "top_word", "symbols", "upper", "digits", "repeats", "same_lines", "line_words", "stops", "bare_marks", "entropy", "marked_words")
TO_POOLED, TO_DIAGONAL, RIDGE = 0.1, 0.1, 1e-3

_kinds = None


def _kind() -> np.ndarray:
    """0 other, 1 upper, 2 other letter, 3 digit, 4 white space."""
    global _kinds
    if _kinds is None:
        _kinds = np.fromiter((1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 0 for c in map(chr, range(0x110000))), np.uint8, 0x110000)
    return _kinds


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; null counts as empty, and an empty text has values too."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    other, upper, lower, digit, _ = np.bincount(_kind()[codes], minlength=5).tolist()
    words = text.split()
    n = len(words)
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = np.array(list(count.values()), float) / max(1, n)
    rate = lambda x, of: float(np.log((x + 0.5) / (of + 50)))
    return [
        float(np.log1p(n)),
        float(np.log1p((upper + lower) / max(1, n))),
        float(np.log((len(count) + 1) / (n + 2))),
        float(np.log((max(count.values(), default=0) + 1) / (n + 2))),
        rate(other, len(codes)),
        rate(upper, upper + lower),
        rate(digit, len(codes)),
        rate(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
        rate(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        rate(sum(w[-1] in ".,;:!?" for w in words), n),
        rate(sum(k for w, k in count.items() if not any(c.isalnum() for c in w)), n),
        float(-(share * np.log(share)).sum() / np.log(n + 2)) if n else 0.0,
        rate(sum(k for w, k in count.items() if len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum()), n),
    ]


def _describe(batches):
    for batch in pieces(batches):
        values = [statistics(t) for t in batch.column("text").to_pylist()]
        keys = [c for c in batch.schema.names if c not in ("text", "statistics")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(values, pa.list_(pa.float64()))], [*keys, "statistics"])


def describe(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` replaced by ``statistics``, an array in the order of STATISTICS; one row for each row, whatever other columns there are."""
    return mapped(docs, _describe, fields(docs, ("text",), statistics=T.ArrayType(T.DoubleType())))


class Discriminant:
    """Class means and Cholesky factors; ``one`` and ``zero`` are (n, sums, sums of products)."""

    def __init__(self, one, zero):
        moments = [(n, s / n, p / n - np.outer(s / n, s / n)) for n, s, p in (one, zero)]
        total = sum(m[0] for m in moments)
        pooled = sum(m[0] * m[2] for m in moments) / total
        self.prior = float(np.log(moments[0][0] / moments[1][0]))
        self.parts = []
        for _, mean, cov in moments:
            cov = (1 - TO_POOLED) * cov + TO_POOLED * pooled
            cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + RIDGE * np.eye(len(mean))
            root = np.linalg.cholesky(cov)
            self.parts.append((mean, np.linalg.inv(root), np.log(np.diag(root)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        log = [-0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) - size for mean, inverse, size in self.parts]
        return 1 / (1 + np.exp(-np.clip(log[0] - log[1] + self.prior, -40, 40)))


def fit(labelled: DataFrame, label: str) -> Discriminant | float:
    """Learned from every row of ``labelled`` (statistics and ``label``, 0 or 1; null and other labels are left out).

    Only sums by class reach the driver; repeated rows count as often as they stand. If one class
    is absent the result is the constant share of class 1 (0.5 of nothing).
    """
    k = len(STATISTICS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    s = F.col("statistics")
    sums = [F.sum(s[i]).alias(f"s{i}") for i in range(k)] + [F.sum(s[i] * s[j]).alias(f"p{i}_{j}") for i, j in pairs]
    got = {}
    rows = labelled.select(F.col(label).cast("int").alias("label"), "statistics").where("label in (0, 1)")
    for r in rows.groupBy("label").agg(F.count("*").alias("n"), *sums).collect():
        products = np.zeros((k, k))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"p{i}_{j}"]
        got[r["label"]] = (r.n, np.array([r[f"s{i}"] for i in range(k)]), products)
    if len(got) < 2:
        return float(next(iter(got))) if got else 0.5
    return Discriminant(got[1], got[0])


def score(described: DataFrame, model: Discriminant | float) -> DataFrame:
    """``described`` with its statistics replaced by score, the chance of class 1; a row in, a row out, equal rows with equal scores."""
    if not isinstance(model, Discriminant):
        return described.drop("statistics").withColumn("score", F.lit(model))
    keys = [n for n in described.columns if n not in ("statistics", "score")]

    def run(batches):
        for batch in batches:
            x = batch.column("statistics").flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(model.score(x))], [*keys, "score"])

    return mapped(described, run, fields(described, ("statistics",), score=T.DoubleType()))
