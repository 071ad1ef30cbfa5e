"""Operator 3: language identification by rank-order profiles (Cavnar and Trenkle 1994).

A profile is the ranked list of the most frequent letter n-grams (one to three letters, word
ends counting as a letter). A document's language is the one whose profile is nearest by
out-of-place distance: the sum of the rank differences of the document's n-grams, an n-gram
that the profile lacks counting as ``top``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, fields, mapped, pieces, saved

TOP = 300
#: Documents of each language that the profiles are learned from at most.
TRAINING_ROWS = 20_000

_letters = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str | None) -> np.ndarray:
    """The n-grams of a whole text, repeats included; none if it has no letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[codes] if len(codes) else np.zeros(0, bool)
    if not letter.any():
        return np.zeros(0, np.uint64)
    c = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.uint64)
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    two = c[:-1] | c[1:] << np.uint64(21)
    three = (two[:-1] | c[2:] << np.uint64(42))[c[1:-1] != 0]
    return np.concatenate([c[c != 0], two, three])


def ranked(text: str | None, top: int) -> np.ndarray:
    values, count = np.unique(grams(text), return_counts=True)
    return values[np.lexsort((values, -count))[:top]]


def _count(batches):
    """The n-grams of each language in a piece of rows, with their numbers; every text is counted by itself."""
    for batch in pieces(batches):
        found: dict[str, list] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            found.setdefault(lang, []).append(np.unique(grams(text), return_counts=True))
        for lang in sorted(found):
            values, at = np.unique(np.concatenate([v for v, _ in found[lang]]), return_inverse=True)
            count = np.bincount(at, np.concatenate([n for _, n in found[lang]]), len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(count)], ["lang", "gram", "n"])


def learn_profiles(labelled: DataFrame, top: int = TOP, training_rows: int = TRAINING_ROWS) -> dict[str, np.ndarray]:
    """language -> its ``top`` n-grams in order, from rows (doc_id, text, lang); rows without a language or a text are left out.

    Every language is learned, from about ``training_rows`` of its documents at most, which a hash
    of doc_id and text chooses; repeated rows count as often as they stand, equally frequent
    n-grams rank by code point. Only the profiles reach the driver.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = saved(few(rows.groupBy("lang").agg(F.count("*").alias("rows"))))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1e6
    sample = rows.join(counts, "lang").where(part * F.col("rows") < training_rows).select("lang", "text")
    counted = sample.mapInArrow(_count, "lang string, gram long, n long")
    best = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    found: dict[str, list] = {}
    for r in kept.collect():
        found.setdefault(r.lang, []).append((r["rank"], r.gram))
    return {k: np.array([g for _, g in sorted(found[k])], np.int64).view(np.uint64) for k in sorted(found)}


def _predict(langs: list[str], vocabulary: np.ndarray, ranks: np.ndarray, top: int):
    def run(batches):
        for batch in pieces(batches):
            lang, score = [], []
            for text in batch.column("text").to_pylist():
                g = ranked(text, top)
                if not len(g) or not langs:
                    lang.append("und")
                    score.append(0.0)
                    continue
                at = np.searchsorted(vocabulary, g).clip(max=len(vocabulary) - 1)
                place = ranks[at]
                apart = np.abs(place - np.arange(len(g))[:, None])
                apart[(vocabulary[at] != g)[:, None] | (place < 0)] = top
                total = apart.sum(0)
                k = int(total.argmin())
                lang.append(langs[k])
                score.append(1 - float(total[k]) / (top * len(g)))
            keys = [c for c in batch.schema.names if c not in ("text", "lang_pred", "score")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keys, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """``docs`` (text and any key columns) with text replaced by lang_pred and score (1: the profile's very order, 0: nothing shared).

    Whole texts count. A text that is null or has no letters, or no profiles at all, gives ``und``
    and 0; ties go to the language that comes first. A row in, a row out, repeated ones alike;
    columns named lang_pred or score are replaced, others may have any name.
    """
    langs = sorted(profiles)
    vocabulary = np.unique(np.concatenate([profiles[k] for k in langs])) if langs else np.zeros(0, np.uint64)
    ranks = np.full((len(vocabulary), len(langs)), -1)
    for j, k in enumerate(langs):
        ranks[np.searchsorted(vocabulary, profiles[k]), j] = np.arange(len(profiles[k]))
    return mapped(docs, _predict(langs, vocabulary, ranks, top), fields(docs, ("text",), lang_pred=T.StringType(), score=T.DoubleType()))
