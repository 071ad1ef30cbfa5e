"""What several operators share: reading, cutting lineage, word hashes, components."""

from __future__ import annotations

import re
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import few, new_path, saved

__all__ = ["few", "saved"]
SHINGLE_WORDS = 5
ROWS_PER_PIECE = 500
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """``saved``, dealt to as many buckets by ``column`` as the session has shuffle partitions: what groups or joins by it moves the other side alone."""
    spark, name = df.sparkSession, f"loomkit_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, column).option("path", new_path(spark)).format("parquet").saveAsTable(name)
    out = spark.table(name)
    # The frame knows its files and buckets; the catalogue need not keep the name. The files stay, for the table is an external one.
    out.schema  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    return out


def mapped(df: DataFrame, function, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name, dots in it too."""
    names = df.columns

    def run(batches):
        return function(batch.rename_columns(names) for batch in batches)

    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, schema)


def pieces(batches, rows: int = ROWS_PER_PIECE):
    """The batches in pieces of at most so many rows; Spark bounds a batch by its bytes, this bounds what a task unpacks of it at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; -1 of a null id, which so is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def fields(df: DataFrame, drop: tuple[str, ...] = (), **more: T.DataType) -> T.StructType:
    """The columns of ``df`` without ``drop`` and without those that ``more`` names, and then ``more``."""
    return T.StructType([f for f in df.schema.fields if f.name not in drop and f.name not in more] + [T.StructField(n, k) for n, k in more.items()])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """word -> 64-bit hash, filled as words come; emptied when it holds a million, so that memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` values, in order; one of all values if there are fewer; none of nothing."""
    n = len(h)
    if not n:
        return h
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out += h[k : n - width + 1 + k] * _FACTORS[k % 64]
    return mix(out + np.uint64(width))


def shingles(text: str | None, hashes: WordHashes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; words are lower-cased and stand between white space."""
    return np.unique(windows(hashes.of((text or "").lower().split()), width))


def segments(batches, key: str):
    """Whole groups from Arrow batches that are sorted by ``key``, several groups at a time."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        keys = t[key].to_pylist()
        cut = len(keys)
        while cut and keys[cut - 1] == keys[-1]:
            cut -= 1
        if cut or (held and held[-1][key][-1].as_py() != keys[-1]):
            if cut:
                held.append(t.slice(0, cut))
                yield pa.concat_tables(held)
                held = [t.slice(cut)]
            else:
                yield pa.concat_tables(held)
                held = [t]
        else:
            held.append(t)
    if held:
        yield pa.concat_tables(held)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n points and the links a-b: the least point of each point's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): (node, root), the root being the least node; nodes without a link are absent.

    Large-star and small-star steps (Kiveris et al. 2014) until nothing changes; each step is an
    aggregate and a join by node, and no node's neighbours are ever gathered in one place.
    """
    e = saved(few(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    seen = None
    while True:
        # Every larger neighbour of a node goes to the least of its neighbours and itself; then every smaller one. A link gives one link.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        large = saved(few(e.join(least, F.col("b") == F.col("node")).select("a", F.col("m").alias("b"))))
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        e = saved(few(large.join(low, F.col("a") == F.col("node")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    e = e.distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


WORD = re.compile(r"\w+")
