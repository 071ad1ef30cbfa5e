"""Ranked lexical search by Block-Max MaxScore over a sharded index.

A shard is a run of documents of bounded size. The index holds, for every term of a shard, its
postings in the order of doc_id: the place of the document in the shard and the impact, which is
the share of a term's weight that the document gets. Postings lie in compressed blocks with the
last place and the largest impact of each block in the clear.

A search joins the index with the items' terms and evaluates each item in each shard. A term's weight
times its largest impact in the shard bounds what it can add. Terms whose bounds together cannot
lift a document over the 20th best so far are not essential: their postings are not read
through. Candidates come from the essential lists; for the others, a candidate's block maximum is
looked up first, and only blocks of candidates that may still get in are decompressed. The
shards' heaps are merged by Spark.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, pieces, saved

#: Maximal runs of ASCII letters and digits and of all characters beyond ASCII: for texts, and for their bytes in UTF-8.
TERM, TERM_BYTES = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: A shard ends after so many documents or terms.
SHARD_DOCS, SHARD_TERMS = 32_768, 4_000_000
BLOCK = 128
#: Items that are evaluated together in a shard.
ITEMS = 256


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, only A-Z lower-cased; bytes.lower leaves all other characters as they are."""
    return TERM_BYTES.findall((text or "").encode("utf-8", "surrogatepass").lower())


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms all have together."""
    n = F.regexp_count(F.col(f"`{text}`"), F.lit(TERM))
    found = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    return found[0], found[1] or 0


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers under 2**28 in groups of seven bits, low groups first, the high bit set where more follow; and the bytes of each."""
    size = 1 + (values >= 1 << 7) + (values >= 1 << 14) + (values >= 1 << 21)
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(4):
        some = size > k
        out[(ends - size)[some] + k] = values[some] >> 7 * k & 127 | (size[some] > k + 1) << 7
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    out = (data[starts] & 127).astype(np.int64)
    for k in range(1, 4):
        longer = np.flatnonzero(ends - starts >= k)
        out[longer] |= (data[starts[longer] + k] & 127).astype(np.int64) << 7 * k
    return out


def _indexed(rows: DataFrame, n_docs: int, n_terms: int, most_docs: int, most_terms: int) -> DataFrame:
    """(shard, term, n, lasts, maxima, ends, data, docs) of ``rows`` (doc_id, text); one row of each shard, of the empty term, has its doc_ids as docs."""
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("lasts", ints),
                           T.StructField("maxima", ints), T.StructField("ends", ints), T.StructField("data", T.BinaryType()), T.StructField("docs", T.ArrayType(rows.schema["doc_id"].dataType))])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        shard, known, ids, found, sizes = TaskContext.get().partitionId() << 32, {}, [], [], []

        def closed():
            doc_ids = pa.concat_arrays(ids)
            # Nulls come last; equal ids in the order of reading.
            order = pc.array_sort_indices(doc_ids).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([""]), pa.array([0]), *(pa.nulls(1, f.type) for f in list(kinds)[3:7]), pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), doc_ids.take(pa.array(order)))], schema=kinds)
            n = np.array(sizes, np.int64)[order]
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            # One number for each pair of a term and a place, sorted: the postings of all terms, one after the other.
            key, tf = np.unique(np.concatenate(found).astype(np.int64) << 32 | np.repeat(place, sizes), return_counts=True)
            if not len(key):
                return
            term, at = key >> 32, key & 0xFFFFFFFF
            m = 75 + 25 * n[at] * n_docs // n_terms
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * m)
            begins = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            lengths = np.diff(np.r_[begins, len(term)])
            within = np.arange(len(term)) - np.repeat(begins, lengths)
            gaps = np.r_[0, np.diff(at)]
            gaps[begins] = at[begins] + 1
            data, size = packed(np.stack([gaps, impact], 1).ravel())
            ends = np.cumsum(size.reshape(-1, 2).sum(1))
            firsts = np.flatnonzero(within % BLOCK == 0)
            lasts = np.r_[firsts[1:], len(term)] - 1
            blocks = -(-lengths // BLOCK)
            before = np.repeat(np.r_[0, ends][begins], blocks)
            edges = pa.array(np.r_[0, np.cumsum(blocks)], pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (at[lasts], np.maximum.reduceat(impact, firsts), ends[lasts] - before)]
            words = pa.array(list(known), pa.binary()).cast(pa.string()).take(pa.array(term[begins]))
            bounds = np.r_[0, ends[np.r_[begins[1:], len(term)] - 1]].astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])
            t = pa.Table.from_arrays([pa.array(np.full(len(begins), shard)), words, pa.array(lengths), *lists, blobs, pa.nulls(len(begins), kinds.field("docs").type)], schema=kinds)
            yield from t.to_batches(max_chunksize=10_000)

        for batch in pieces(batches, 50):
            for text in batch.column(1).to_pylist():
                words = terms(text)
                found.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint32, len(words)))
                sizes.append(len(words))
            ids.append(batch.column(0))
            if len(sizes) >= most_docs or sum(sizes) >= most_terms:
                yield from closed()
                shard, known, ids, found, sizes = shard + 1, {}, [], [], []
        if sizes:
            yield from closed()

    return mapped(rows, run, schema)


def build(docs: DataFrame, text: str = "text", shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS) -> tuple[DataFrame, int]:
    """The index of ``docs`` (doc_id, text), written to the shared folder, and the number of documents with terms."""
    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    n_docs, n_terms = totals(rows)
    return saved(_indexed(rows, n_docs, n_terms, shard_docs, shard_terms)), n_docs


class Postings:
    """A term's postings in a shard. Blocks are decompressed when asked for, and kept once that has cost as much as all of them."""

    def __init__(self, lasts: np.ndarray, maxima: np.ndarray, ends: np.ndarray, data: bytes):
        self.lasts, self.maxima, self.ends, self.data = lasts, maxima, ends, np.frombuffer(data, np.uint8)
        self.read, self.whole = 0, None

    def blocks(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts of the blocks from ``low`` up to ``high``."""
        if self.whole is None:
            begin, end = self.ends[low - 1] if low else 0, self.ends[high - 1]
            self.read += end - begin
            if self.read < len(self.data):
                return self._decompressed(low, begin, end)
            self.whole = self._decompressed(0, 0, len(self.data))
        at, impact = self.whole
        return at[low * BLOCK : high * BLOCK], impact[low * BLOCK : high * BLOCK]

    def _decompressed(self, low: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        pairs = unpacked(self.data[begin:end]).reshape(-1, 2)
        return np.cumsum(pairs[:, 0]) + (self.lasts[low - 1] if low else -1), pairs[:, 1]

    def between(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts of the postings at the places from ``begin`` up to ``end``."""
        low, high = np.searchsorted(self.lasts, (begin, end))
        high = min(high + 1, len(self.lasts))
        if low >= high:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, impact = self.blocks(low, high)
        a, b = np.searchsorted(at, (begin, end))
        return at[a:b], impact[a:b]

    def impacts(self, places: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The impacts at ``places``, which stand in ``block`` each, or 0; no other block is decompressed."""
        needed = np.unique(block)
        out = np.zeros(len(places), np.int64)
        for run in np.split(needed, np.flatnonzero(np.diff(needed) > 1) + 1):
            at, impact = self.blocks(run[0], run[-1] + 1)
            a, b = np.searchsorted(block, (run[0], run[-1] + 1))
            k = np.searchsorted(at, places[a:b])
            hit = at[np.minimum(k, len(at) - 1)] == places[a:b]
            out[a:b][hit] = impact[k[hit]]
        return out


def evaluate(lists: list[tuple[int, Postings]], n: int, k: int, first: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best of the ``n`` documents of a shard, equal ones by place; ``lists`` has weights and postings.

    The places are gone through in windows, each twice as long as the one before.
    """
    lists = sorted(lists, key=lambda x: x[0] * int(x[1].maxima.max()))
    # upto[i]: what the first i lists can add together.
    upto = np.cumsum([0] + [w * int(p.maxima.max()) for w, p in lists])
    best, scores, least, begin, width = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, first
    while begin < n:
        end = min(n, begin + width)
        essential = int(np.searchsorted(upto, least, "right")) - 1
        if essential == len(lists):
            break
        sums = np.zeros(end - begin, np.int64)
        for w, p in lists[essential:]:
            at, impact = p.between(begin, end)
            sums[at - begin] += w * impact
        at = np.flatnonzero(sums)
        found = sums[at]
        for i in range(essential - 1, -1, -1):
            w, p = lists[i]
            some = found + upto[i + 1] > least
            at, found = at[some], found[some]
            if not len(at):
                break
            block = np.searchsorted(p.lasts, at + begin)
            there = block < len(p.lasts)
            most = np.where(there, w * p.maxima[np.minimum(block, len(p.lasts) - 1)], 0)
            some = found + most + upto[i] > least
            at, found, block, there = at[some], found[some], block[some], there[some]
            if there.any():
                found[there] += w * p.impacts(at[there] + begin, block[there])
        better = found > least
        best, scores = np.r_[best, at[better] + begin], np.r_[scores, found[better]]
        order = np.lexsort((best, -scores))[:k]
        best, scores = best[order], scores[order]
        if len(best) == k:
            least = int(scores[-1])
        begin, width = end, 2 * width
    return best, scores


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): of each row of ``items`` (item_id, text) the ``k`` documents of ``build``'s index that score highest, if above 0.

    Equal scores are ranked by doc_id, nulls last. A null text, like one without terms, finds nothing and is not found; rows
    of equal ids are items, or documents, of their own.
    """
    items = saved(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    groups = max(1, -(-items.count() // ITEMS))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = items.select("item", F.explode(F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit(TERM), F.lit(0))).alias("term"))
    words = words.groupBy("item", "term").agg(F.count("*").alias("times")).withColumn("items", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int"))
    uses = words.groupBy("items", "term").agg(F.collect_list(F.struct("item", "times")).alias("uses"))
    df = index.where("n > 0").join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    asked = uses.join(df, "term").select("term", "items", weight.alias("weight"), "uses").where("weight > 0")
    # The row of the empty term brings the shard's doc_ids to each group of items.
    asked = saved(asked.unionByName(asked.select(F.lit("").alias("term"), "items", F.lit(0).cast("long").alias("weight")).distinct(), allowMissingColumns=True))
    rows = index.join(asked, "term")
    doc_id = index.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", doc_id), T.StructField("score", T.LongType())])

    def run(t):
        import pyarrow as pa

        docs, lists = None, {}
        for batch in t.to_batches(max_chunksize=500):
            get = {c: batch.column(c) for c in ("lasts", "maxima", "ends", "docs")}
            for r, (w, data, use) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("weight", "data", "uses")), strict=True)):
                if use is None:
                    docs = get["docs"][r].values
                    continue
                p = Postings(*(get[c][r].values.to_numpy() for c in ("lasts", "maxima", "ends")), data)
                for u in use:
                    lists.setdefault(u["item"], []).append((w * u["times"], p))
        found = [(item, *evaluate(of, len(docs), k)) for item, of in lists.items()]
        at = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in found)])
        who = np.repeat(np.array([x[0] for x in found], np.int64), [len(x[1]) for x in found])
        score = np.concatenate([np.zeros(0, np.int64), *(x[2] for x in found)])
        return pa.Table.from_arrays([pa.array(who), docs.take(pa.array(at)), pa.array(score)], schema.names)

    heaps = rows.groupBy("shard", "items").applyInArrow(run, schema)
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = heaps.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
docs AS (SELECT * FROM t WHERE len(terms) > 0), c AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM docs),
p AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, c.n),
q AS (SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
s AS (SELECT q.i, q.item_id, docs.doc_id, p.d, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + (25 * len(docs.terms) * c.n) // c.l))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN docs USING (d), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20"""
