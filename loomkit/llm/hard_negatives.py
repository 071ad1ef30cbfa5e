"""Hard negatives by exact integer products, several candidates to a multiplication.

Candidates' components are made positive by a bias and laid side by side in the bits of one wide
integer, a field for each candidate, wide enough for the whole sum of products. Multiplying such
an integer by an anchor's component multiplies every field, and the sum over components holds
each candidate's product with the anchor in its own field; what the biases added is known and is
taken off. The wide integers are held in doubles, which are exact below 2**53 whatever the
order of the sums; components too large for one field of 53 bits are multiplied one by one as
whole numbers of any length.

Rows are dealt evenly to buckets and packed there by label, in blocks of bounded size. Every block of anchors meets
every block of candidates: once to find each anchor's first positives, and once more, with their
scores as limits, for the negatives of each. A task holds the candidates of one bucket while the
anchors pass, block by block, and keeps the best of each; Spark merges those of the tasks. Anchors
go to every bucket in a shuffle of their own: a join would take their copies for a small table and
broadcast them, by way of the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, pieces, saved

#: Rows of a block of candidates (8,192 at most) or anchors, and the most blocks of candidates of a bucket and of a file, which Spark reads as one batch.
CANDIDATES, ANCHORS, BLOCKS, BATCH = 4096, 1024, 64, 16
#: Anchors that are multiplied at a time, so that products stay in a core's cache, and the candidates that they look at first, to have limits for the others.
TOGETHER, AHEAD = 64, 64
LONG = np.iinfo(np.int64)


def whole_parts(embedding: Column, scale: int = 256) -> Column:
    """array<long>: the components times ``scale``, rounded down; what no long can hold is the nearest that one can."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: Column) -> Column:
    """Whether there is a vector without null, infinite or not-a-number components."""
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def pack(parts: np.ndarray, bias: int, width: int) -> np.ndarray:
    """Of (rows, components) the (components, wide integers) with 53 // width rows to an integer, each field ``width`` bits: the first rows have the first fields."""
    fields = 53 // width
    filled = np.zeros((-(-len(parts) // fields) * fields, parts.shape[1]))
    filled[: len(parts)] = parts + bias
    return np.einsum("fgd,f->dg", filled.reshape(fields, -1, parts.shape[1]), 2.0 ** (width * np.arange(fields)))


def products(anchors: np.ndarray, packed: np.ndarray, sums: np.ndarray, bias: int, width: int) -> np.ndarray:
    """The exact products of ``anchors`` (rows, components) with the packed rows, whose components sum to ``sums``."""
    units = 2.0 ** (width * np.arange(53 // width))
    added = np.zeros((len(units), packed.shape[1]))
    added.ravel()[: len(sums)] = bias * sums
    wide = (anchors + bias).astype(float) @ packed
    # Without what the biases added fields have signs; a product is less than half of its field, so that the field above is the nearest whole number.
    wide -= units @ added
    wide -= (units.sum() * (bias * anchors.sum(1) + anchors.shape[1] * bias * bias))[:, None]
    out = np.empty((len(anchors), *added.shape))
    for f in range(len(units) - 1, 0, -1):
        field = np.multiply(wide, 1 / units[f], out=out[:, f])
        wide -= np.rint(field, out=field) * units[f]
    out[:, 0] = wide
    return out.reshape(len(anchors), -1)[:, : len(sums)]


def first(k: int, group: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the first ``k`` of each group: higher scores first, then smaller ids, null ids last."""
    rank = np.unique(score, return_inverse=True)[1] if score.dtype == object else score
    order = np.lexsort((ids, null, -rank, group))
    g = group[order]
    begins = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    return order[np.arange(len(g)) - np.repeat(begins, np.diff(np.r_[begins, len(g)])) < k]


def _blocks(rows: DataFrame, size: int, bias: int, width: int, most: int, most_anchors: int) -> DataFrame:
    """Of rows that are sorted by label in their partitions, blocks of candidates (block, ids, labels, data, sums), and with at, their places
    among the candidates, blocks of anchors; block >> 32 is the partition."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(T.LongType()))]
                          + [T.StructField(n, T.BinaryType()) for n in ("data", "sums", "at")])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, block, held, places, anchors = to_arrow_schema(schema), TaskContext.get().partitionId() << 32, [], [], []
        narrow = _narrow(bias)

        def dense(t):
            out = np.zeros((t.num_rows, size), np.int64)
            parts = t.column(2).combine_chunks()
            starts = parts.offsets.to_numpy()
            n = np.diff(starts)
            out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(starts[:-1] - starts[0], n)] = parts.flatten().to_numpy()
            return out

        def row(t, data, sums, at):
            lists = [pa.array([t.column(k).to_pylist()], pa.list_(pa.int64())) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists, *(pa.array([x], pa.binary()) for x in (data, sums, at))], schema=kinds)

        def closed():
            nonlocal block
            t = pa.Table.from_batches(held)
            parts = dense(t)
            data = pack(parts, bias, width) if width <= 53 else parts
            yield row(t, data.tobytes(), parts.sum(1).tobytes(), None)
            chosen = np.flatnonzero(t.column(3).fill_null(False).to_numpy())
            anchors.append(t.take(chosen))
            places.append((block << 13) + chosen)
            block += 1
            held.clear()
            if sum(map(len, places)) >= most_anchors:
                yield from asked()

        def asked():
            nonlocal block
            t, at = pa.concat_tables(anchors), np.concatenate(places)
            anchors.clear()
            places.clear()
            for k in range(0, len(at), most_anchors):
                part = t.slice(k, most_anchors)
                yield row(part, dense(part).astype(narrow).tobytes(), None, at[k : k + most_anchors].tobytes())
                block += 1

        n = 0
        for batch in batches:
            for piece in pieces([batch], most):
                while piece.num_rows:
                    held.append(piece.slice(0, most - n))
                    n += held[-1].num_rows
                    piece = piece.slice(held[-1].num_rows)
                    if n == most:
                        yield from closed()
                        n = 0
        if held:
            yield from closed()
        if places:
            yield from asked()

    return mapped(rows, run, schema)


def _narrow(bias: int) -> np.dtype:
    """The smallest whole numbers that hold components from -``bias`` to ``bias``."""
    return np.dtype(next((x for x in (np.int8, np.int16, np.int32) if bias <= np.iinfo(x).max), np.int64))


def _cells(anchors: DataFrame, candidates: DataFrame, buckets: int) -> DataFrame:
    """Each bucket's blocks of candidates, and after them every block of anchors, bucket by bucket."""
    a = anchors.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    c = candidates.withColumn("bucket", F.pmod(F.shiftright("block", 32), F.lit(buckets)).cast("int"))
    return c.unionByName(a, allowMissingColumns=True).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", F.col("at").isNotNull(), "block")


def _ids(x) -> tuple[np.ndarray, np.ndarray]:
    """Values, and which of them are null, of an Arrow list's."""
    return x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), x.is_null().to_numpy(zero_copy_only=False)


def _clipped(x: np.ndarray) -> np.ndarray:
    return np.clip(x, LONG.min, LONG.max).astype(np.int64)


def _nearest(a: dict, candidates: list[dict], k: int, same: bool, multiply) -> tuple[np.ndarray, ...]:
    """(slot, score, null, id): for each slot of the anchors ``a`` the first ``k`` of ``candidates`` within the slot's limits, of the
    anchor's label or of others. A block, whose rows are sorted by label, is not multiplied where no label of it is asked for. What cannot
    be among the first leaves by one comparison with its anchor's limit, which rises as slots fill."""
    n, slots = len(a["parts"]), len(a["anchor"])
    lowest = a["low"].copy()
    begins, ends = (np.searchsorted(a["anchor"], np.arange(n), side) for side in ("left", "right"))
    exact = a["low"].dtype
    held, waiting = [(np.zeros(0, int), np.zeros(0, exact), np.zeros(0, bool), np.zeros(0, np.int64))], 0

    def limits():
        out = np.full(n, np.inf, exact)
        np.minimum.at(out, a["anchor"], lowest)
        return out[:, None]

    def merged():
        together = [np.concatenate(x) for x in zip(*held, strict=True)]
        kept = first(k, *together)
        slot, score = together[0][kept], together[1][kept]
        held[:] = [tuple(x[kept] for x in together)]
        # A slot that is full takes nothing below its last.
        counts = np.bincount(slot, minlength=slots)
        full = np.flatnonzero(counts == k)
        lowest[full] = score[np.cumsum(counts)[full] - 1]
        return limits()

    limit = start = limits()
    least, most = a["labels"][[0, -1]]
    groups = [(x, *_place(a["labels"], x)) for x in np.unique(a["labels"])] if same else [(None, 0, n)]
    for c in candidates:
        if most < c["labels"][0] or least > c["labels"][-1] if same else c["labels"][0] == c["labels"][-1] == least == most:
            continue
        scores = multiply(a["parts"], c)
        steps = _steps(c["labels"], groups, limit == start)
        for step in steps:
            for top, bottom, begin, end in step:
                row, of = np.divmod(np.flatnonzero(scores[top:bottom, begin:end] >= limit[top:bottom]), end - begin)
                row, of = row + top, of + begin
                fits = a["at"][row] != c["place"] + of if same else a["labels"][row] != c["labels"][of]
                row, of = row[fits], of[fits]
                n_slots = ends[row] - begins[row]
                pair = np.repeat(np.arange(len(row)), n_slots)
                slot = begins[row[pair]] + np.arange(len(pair)) - np.repeat(np.cumsum(n_slots) - n_slots, n_slots)
                found = scores[row[pair], of[pair]]
                fits = (found >= lowest[slot]) & (found <= a["high"][slot])
                slot, of = slot[fits], of[pair[fits]]
                held.append((slot, found[fits], c["null"][of], c["ids"][of]))
                waiting += len(slot)
            if waiting > k * slots or waiting and len(steps) > 1:
                limit, waiting = merged(), 0
    merged()
    return held[0]


def _place(labels: np.ndarray, label: int) -> tuple[int, int]:
    """Where a label begins and ends among sorted ones."""
    return tuple(int(np.searchsorted(labels, label, side)) for side in ("left", "right"))


def _steps(labels: np.ndarray, groups: list[tuple], fresh: np.ndarray) -> list[list[tuple]]:
    """Of a block with ``labels`` the parts that groups (label or None for all, first anchor, end) of anchors look at, step by step: (first anchor, end,
    first row, end). Anchors whose limits are ``fresh`` look at a few rows first, so that most of the others have to be compared with a limit only."""
    steps = []
    for label, top, bottom in groups:
        begin, end = (0, len(labels)) if label is None else _place(labels, label)
        edges = [begin, *(x for j in range(8) if fresh[top:bottom].all() and (x := begin + (AHEAD << 2 * j)) < end), end]
        for j, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
            if x < y:
                steps += [[]] * (j == len(steps))
                steps[j].append((top, bottom, x, y))
    return steps


def _best(cells: DataFrame, size: int, bias: int, width: int, k: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """(a_block, at, slot, anchor_id, positive_id, positive_score, id, score): for each anchor of ``cells`` the first ``k`` others of its label, or with
    limits the first ``k`` of other labels for each of its positives, which is its slot; those of one bucket, so that the first of all are among them."""
    schema = T.StructType([T.StructField("a_block", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("slot", T.IntegerType())]
                          + [T.StructField(n, T.LongType()) for n in ("anchor_id", "positive_id", "positive_score", "id", "score")])
    names = cells.columns

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, exact, narrow = to_arrow_schema(schema), float if width <= 53 else object, _narrow(bias)

        def multiply(parts, c):
            if width <= 53:
                return products(parts, c["data"], c["sums"], bias, width)
            return parts.astype(object) @ c["data"].astype(object).T

        def candidate(get):
            (ids, null), data = _ids(get("ids").values), get("data").as_py()
            data = np.frombuffer(data).reshape(size, -1) if width <= 53 else np.frombuffer(data, np.int64).reshape(-1, size)
            return {"ids": ids, "null": null, "labels": get("labels").values.to_numpy(), "data": data, "sums": np.frombuffer(get("sums").as_py(), np.int64), "place": get("block").as_py() << 13}

        def anchor_block(get):
            (ids, null), parts = _ids(get("ids").values), np.frombuffer(get("data").as_py(), narrow).reshape(-1, size).astype(np.int64)
            # The slots: one for each anchor, or one for each of its positives.
            slots = sorted((p["at"], p["rank"], p["id"], p["score"]) for p in get("positives").as_py()) if low is not None else [(i, 0, None, 0) for i in range(len(parts))]
            out = {"parts": parts, "ids": ids, "null": null, "labels": get("labels").values.to_numpy(), "at": np.frombuffer(get("at").as_py(), np.int64)}
            out["anchor"], out["slot"] = (np.array([s[j] for s in slots], int) for j in (0, 1))
            out["positive"], out["limit"] = pa.array([s[2] for s in slots], pa.int64()), np.array([s[3] for s in slots], np.int64)
            score = out["limit"].astype(object)
            out["low"], out["high"] = ((-(-low * score // 100)).astype(exact), (high * score // 100).astype(exact)) if low is not None else (np.full(len(slots), x, exact) for x in (-np.inf, np.inf))
            return out

        def answers(block, a, candidates):
            for begin in range(0, len(a["parts"]), TOGETHER):
                here = {n: a[n][begin : begin + TOGETHER] for n in ("parts", "labels", "at")}
                s = slice(*np.searchsorted(a["anchor"], (begin, begin + TOGETHER)))
                here |= {n: a[n][s] for n in ("low", "high")} | {"anchor": a["anchor"][s] - begin}
                slot, score, null, ids = _nearest(here, candidates, k, low is None, multiply)
                slot = slot + s.start
                at = a["anchor"][slot]
                columns = [np.full(len(slot), block), at.astype(np.int32), a["slot"][slot].astype(np.int32), pa.array(a["ids"][at], pa.int64(), mask=a["null"][at]),
                           a["positive"].take(pa.array(slot)), a["limit"][slot], pa.array(ids, pa.int64(), mask=null), _clipped(score)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=kinds)

        now, candidates = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda n: batch.column(names.index(n))[r]  # noqa: B023, E731
                if get("bucket").as_py() != now:
                    now, candidates = get("bucket").as_py(), []
                if get("at").is_valid:
                    yield from answers(get("block").as_py(), anchor_block(get), candidates)
                else:
                    candidates.append(candidate(get))

    return mapped(cells, run, schema)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = CANDIDATES, anchor_block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, label, parts array<long>, is_anchor).

    A row's score with an anchor is the product of their ``parts``; of vectors of different
    lengths the shorter one ends in zeros. An anchor's positives are its first other rows of the
    same label, and its negatives for a positive the first rows of other labels with ``low`` *
    positive_score <= 100 * negative_score <= ``high`` * positive_score: higher scores first, ties
    by smaller vec_id, null ids last. A row that repeats is a row of its own, an anchor that repeats an anchor
    of its own. Rows without a label or parts take no part; without anchors, positives or negatives there are no rows.
    Scores are exact; one beyond a long is given as the nearest long.
    """
    rows = rows.where("label is not null and parts is not null").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "parts", "is_anchor")
    size, least, most, n = rows.agg(F.max(F.size("parts")), F.min(F.array_min("parts")), F.max(F.array_max("parts")), F.count("*")).first()
    size, bias = max(size or 0, 1), max(-(least or 0), most or 0, 1)
    # A field holds the sum of size products of two numbers from 0 to twice the bias.
    width = (size * (2 * bias) ** 2).bit_length()
    # As many buckets as give the cluster work while there are few rows; then as few as keep merges small.
    tasks = max(32, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    buckets = max(1, -(-n // min(BLOCKS * block, max(block, n // tasks))))
    files = buckets * max(1, -(-n // (buckets * BATCH * block)))
    blocks = saved(_blocks(rows.repartition(files).sortWithinPartitions("label"), size, bias, width, block, anchor_block))
    candidates, anchors = blocks.where("at is null"), blocks.where("at is not null").drop("sums")
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id")))
    found = _best(_cells(anchors, candidates, buckets), size, bias, width, positives).withColumn("rank", rank("a_block", "at")).where(F.col("rank") <= positives)
    listed = found.groupBy(F.col("a_block").alias("block")).agg(F.collect_list(F.struct("at", "rank", "id", "score")).alias("positives"))
    limited = saved(anchors.join(listed, "block"))
    near = _best(_cells(limited, candidates, buckets), size, bias, width, negatives, low, high).withColumn("rank", rank("a_block", "at", "slot")).where(F.col("rank") <= negatives)
    return near.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, a.label AS anchor_label, b.r AS other, b.vec_id, b.label, list_dot_product(a.c, b.c)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.other ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.r = p.r AND s.label <> s.anchor_label AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5"""
