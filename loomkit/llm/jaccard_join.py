"""Operator 1: near-duplicate groups by a chosen-path join over word shingles.

Every text is the set of its runs of five words; two texts are linked if the Jaccard likeness
of their sets is at least 0.8. Texts with the same set are one *class* from the start, so
copies never meet one another. The classes' sets are embedded in ``COORDINATES`` MinHash
values, at each of which two sets agree with a chance that is their likeness (Christiani, Pagh
and Sivertsen 2018). A run of the recursion splits the sets by the value of one coordinate;
four bits of each value are kept for what follows. Small buckets are brute-forced over the embeddings. In a larger
one a few members serve as pivots, drawn anew for each bucket: what resembles a pivot is linked
to it, and leaves if it is so near that its partners must resemble the pivot too; the rest is
split again by ``CHILDREN`` more coordinates, each into children of its own. A pair at the
threshold is then found below a bucket that holds both with a chance that does not fall with
depth (``below``), and the runs are repeated until the target recall. The links found this way
only gather *candidate* groups; in those, every pair is then compared exactly, in tiles of
bounded size, and the exact links make the groups and the counts.

Spark splits the buckets of more than ``MOST`` sets, one level for each round; a task splits
the others to the end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, components, few, mix, pieces, roots, saved, segments, shingles

COORDINATES = 128
CHILDREN = 2
LEAF, PIVOTS, BLOCK = 128, 8, 1024
#: Members as near to a pivot as this leave the bucket with it.
LEAVE = 0.85
MOST = 65_536
TILE_ROWS, TILE_SHINGLES = 1024, 4_000_000
#: Bits of the filter for the rows that are read again: 16 for each of them, and never more than 16 MB in all.
BITS_PER_KEY, MOST_BITS, PROBES = 16, 1 << 27, 3
#: The values of a coordinate that are kept tell 16 apart; so many of the sets that differ agree there by chance.
CHANCE = 1 / 16

_rng = np.random.default_rng(20_231)
_MUL = _rng.integers(1, 2**31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)
_SPREAD = np.uint32(0x9E3779B1)


def below(threshold: float, levels: int = 200) -> float:
    """The chance that a pair at the threshold is found below a bucket that holds both, however deep the splits go on."""
    s = 1.0
    for _ in range(levels):
        s = 1 - (1 - threshold * s) ** CHILDREN
    return s


def runs_needed(recall: float, threshold: float = 0.8) -> int:
    """Runs after which a pair at the threshold has been found with chance ``recall``, half of what may be missed being left to the embedding."""
    return max(1, min(COORDINATES // 2, math.ceil(math.log((1 - recall) / 2) / math.log(1 - threshold * below(threshold)))))


def agreement(likeness: float, deviations: float = 0.0) -> float:
    """The share of equal kept values that sets of this likeness reach, less so many standard deviations."""
    p = likeness + (1 - likeness) * CHANCE
    return p - deviations * math.sqrt(p * (1 - p) / COORDINATES)


def embed(values: np.ndarray) -> np.ndarray:
    x, out = values.astype(np.uint32), np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        out = np.minimum(out, (x[k : k + 2048, None] * _MUL + _ADD).min(0))
    return out


def row_key() -> Column:
    """A hash of (doc_id, text), which tells rows with a null or repeated doc_id apart."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").cast("string"))


def _sketches(runs: int):
    """The set's hash, size, kept values (two of them a byte) and the first buckets, one of each run."""
    order = np.random.default_rng(7).permutation(COORDINATES)[:runs]
    salt = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def run(batches):
        hashes = WordHashes()
        for batch in pieces(batches):
            sets = [shingles(text, hashes) for text in batch.column("text").to_pylist()]
            full = np.array([len(s) > 0 for s in sets])
            m = np.array([embed(s) for s in sets], np.uint32).reshape(-1, COORDINATES)
            kept = (m * _SPREAD >> np.uint32(28)).astype(np.uint8)
            packed = kept[:, ::2] | kept[:, 1::2] << 4
            paths = mix(m[:, order].astype(np.uint64) ^ salt).view(np.int64)
            null = pa.array(~full)
            none = lambda a: pa.compute.if_else(null, pa.scalar(None, a.type), a)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 none(pa.array([p.tobytes() for p in packed], pa.binary())), pa.array([len(s) for s in sets], pa.int64()), pa.array(list(paths), pa.list_(pa.int64()))],
                ["doc_id", "row", "sig", "sketch", "n", "paths"])

    return run


def _matrix(column) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES // 2)
    out = np.empty((len(packed), COORDINATES), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


class Bucket:
    """The links between the sets of one bucket, whose kept values are the rows of ``m``."""

    def __init__(self, m: np.ndarray, seed: int, least: float, leave: float):
        self.m, self.least, self.leave = m, least, leave
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.split(np.arange(len(m)), seed, ())

    def link(self, a, b) -> None:
        self.a.append(np.broadcast_to(a, np.shape(b)).ravel())
        self.b.append(np.asarray(b).ravel())

    def likeness(self, rows: np.ndarray, one: int) -> np.ndarray:
        return (self.m[rows] == self.m[one]).mean(1)

    def compare(self, few: np.ndarray, many: np.ndarray) -> None:
        for one in few:
            near = many[self.likeness(many, one) >= self.least]
            self.link(one, near)

    def split(self, rows: np.ndarray, seed: int, used: tuple[int, ...]) -> None:
        if len(rows) <= LEAF or len(used) == COORDINATES:
            for k in range(len(rows) - 1):
                self.compare(rows[k : k + 1], rows[k + 1 :])
            return
        rng = np.random.default_rng(seed)
        pivots = rng.choice(rows, PIVOTS, replace=False)
        like = np.stack([self.likeness(rows, p) for p in pivots], 1)
        for k, p in enumerate(pivots):
            self.link(p, rows[like[:, k] >= self.least])
        most = like.max(1)
        alone, near = rows[most < self.least], rows[(most >= self.least) & (most < self.leave)]
        if not len(alone):
            return
        if min(len(alone), len(near)) <= BLOCK:
            self.compare(*((alone, near) if len(alone) < len(near) else (near, alone)))
            rows = alone
        else:
            rows = np.concatenate([alone, near])
        if len(rows) <= LEAF:
            self.split(rows, 0, used)
            return
        free = np.setdiff1d(np.arange(COORDINATES), used)
        for c in rng.permutation(free)[:CHILDREN].tolist():
            value = self.m[rows, c]
            for v in np.nonzero(np.bincount(value) > 1)[0].tolist():
                self.split(rows[value == v], int(rng.integers(2**63)), (*used, c))

    def tree(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, first member of its part), for the members that are not first themselves."""
        label = roots(len(self.m), np.concatenate(self.a), np.concatenate(self.b)) if self.a else np.arange(len(self.m))
        at = np.nonzero(label != np.arange(len(label)))[0]
        return at, label[at]


def _links(least: float, leave: float):
    """(a, b) joins each member of a bucket to the first one of its part; rows come sorted by bucket."""

    def run(batches):
        for t in segments(batches, "path"):
            path, m = t["path"].to_numpy(), _matrix(t["sketch"])
            cut = np.concatenate([[0], np.nonzero(path[1:] != path[:-1])[0] + 1, [len(path)]])
            size = np.diff(cut)
            a, b = [], []
            # Small buckets all together: members k apart in the same bucket, for every k.
            small = np.repeat(size <= LEAF, size)
            for step in range(1, int(size[size <= LEAF].max(initial=1))):
                i = np.nonzero((path[:-step] == path[step:]) & small[:-step])[0]
                for k in range(0, len(i), 20_000):
                    j = i[k : k + 20_000]
                    j = j[(m[j] == m[j + step]).mean(1) >= least]
                    a.append(j)
                    b.append(j + step)
            label = roots(len(path), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(path))
            for lo, hi in zip(cut[:-1][size > LEAF], cut[1:][size > LEAF], strict=True):
                at, first = Bucket(m[lo:hi], int(path[lo]) & (2**63 - 1), least, leave).tree()
                label[lo + at] = lo + first
            at = np.nonzero(label != np.arange(len(label)))[0]
            node = t["node"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], ["a", "b"])

    return run


def _hot_split(least: float, leave: float):
    """Of a member of a hot bucket, with the bucket's pivots: its links, and its rows in the children (b null), one for each of their coordinates."""

    def run(batches):
        for batch in pieces(batches, 5_000):
            m, out = _matrix(batch.column("sketch")), {"node": [], "path": [], "b": []}
            for k, (node, path, pivots) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("node", "path", "pivots")), strict=True)):
                pm = _matrix(pa.array([p["sketch"] for p in pivots]))
                like = (pm == m[k]).mean(1)
                for j in np.nonzero(like >= least)[0]:
                    out["node"].append(node)
                    out["path"].append(path)
                    out["b"].append(pivots[j]["node"])
                if like.max() < leave:
                    rng = np.random.default_rng(path & (2**63 - 1))
                    for c in rng.permutation(COORDINATES)[:CHILDREN].tolist():
                        h = mix(np.array([path], np.int64).view(np.uint64) ^ np.uint64((c * 16 + int(m[k, c]) + 1) * 0x9E3779B97F4A7C15 % 2**64))
                        out["node"].append(node)
                        out["path"].append(int(h.view(np.int64)[0]))
                        out["b"].append(None)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64()) for c in ("node", "path", "b")], ["node", "path", "b"])

    return run


def candidate_links(sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between nodes that gather every candidate pair; ``sets`` has node (long), sketch and paths."""
    least, leave = agreement(threshold, 3.5), agreement(LEAVE)
    rows = sets.select("node", "sketch", F.explode("paths").alias("path"))
    found = None
    while True:
        sizes = saved(few(rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")))
        # The number of a row in its bucket keeps the buckets whole: without an operator that needs them so, a skewed join may be dealt anew.
        number = F.row_number().over(W.partitionBy("path").orderBy("node")).alias("number")
        met = rows.join(sizes.where(F.col("size") <= MOST).select("path").hint("merge"), "path").select("path", "node", "sketch", number)
        links = few(met).mapInArrow(_links(least, leave), "a long, b long")
        found = links if found is None else found.union(links)
        hot = sizes.where(F.col("size") > MOST).select("path")
        if hot.isEmpty():
            return found
        hot_rows = rows.join(hot, "path")
        order = F.xxhash64("node", "path")
        slots = hot_rows.groupBy("path", F.pmod(order, F.lit(PIVOTS)).alias("slot")).agg(F.min_by(F.struct("node", "sketch"), order).alias("pivot"))
        pivots = slots.groupBy("path").agg(F.collect_list("pivot").alias("pivots"))
        split = saved(hot_rows.join(pivots, "path").select("node", "path", "sketch", "pivots").mapInArrow(_hot_split(least, leave), "node long, path long, b long"))
        found = found.union(split.where("b is not null").select(F.col("node").alias("a"), "b"))
        rows = split.where("b is null").select("node", "path").distinct().join(sets.select("node", "sketch"), "node").select("node", "sketch", "path")


def _verify(threshold: float, id_type: pa.DataType):
    """Exact likeness of the pairs of a tile: of each member the weighted number of links, and of its part the first member and the least row."""

    def run(batches):
        for t in segments(batches, "tile"):
            tiles = t["tile"].to_pylist()
            starts = [k for k in range(len(tiles)) if k == 0 or tiles[k] != tiles[k - 1]] + [len(tiles)]
            sigs, own, whole, least = t["sig"].to_pylist(), t["diagonal"].to_pylist(), t["blocks"].to_numpy() == 1, [tuple(x.values()) for x in t["least"].to_pylist()]
            values = [np.frombuffer(x, "<u8") for x in t["shingles"].to_pylist()]
            block, weight = t["block"].to_numpy(), t["copies"].to_numpy()
            out = {"sig": [], "links": [], "root": [], "least": [], "whole": []}
            for lo, hi in zip(starts, starts[1:], strict=False):
                at = [k for k in range(lo, hi) if k == lo or sigs[k] != sigs[k - 1]]
                links, label = _tile([values[k] for k in at], block[at], own[lo], weight[at], threshold)
                first = {}
                for k, r in zip(at, label, strict=True):
                    # The part's least row if the whole group is in this tile, else the member's own.
                    r = r if whole[lo] else k
                    first[r] = min(first.get(r, least[k]), least[k])
                out["sig"] += [sigs[k] for k in at]
                out["links"] += links.tolist()
                out["root"] += [sigs[at[r]] for r in label]
                out["least"] += [first[r if whole[lo] else k] for k, r in zip(at, label, strict=True)]
                out["whole"] += [bool(whole[lo])] * len(at)
            parts = list(zip(*out["least"], strict=True)) or [[], [], []]
            struct = pa.StructArray.from_arrays([pa.array(parts[0], pa.bool_()), pa.array(parts[1], id_type), pa.array(parts[2], pa.int64())], ["none", "doc_id", "row"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["sig"], pa.binary()), pa.array(out["links"], pa.int64()), pa.array(out["root"], pa.binary()), struct, pa.array(out["whole"])],
                ["sig", "links", "root", "least", "whole"])

    return run


def _tile(sets: list[np.ndarray], block: np.ndarray, diagonal: bool, weight: np.ndarray, threshold: float):
    m, size = len(sets), np.array([len(s) for s in sets])
    if m == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    shared = np.zeros((m, m))
    if m == 2:
        shared[0, 1] = shared[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        owner = np.repeat(np.arange(m), size)
        values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = count[column] > 1
        owner, column = owner[keep], (np.cumsum(count > 1) - 1)[column[keep]]
        step = max(64, 8_000_000 // m)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            k0, k1 = np.searchsorted(column, [lo, lo + step])
            dense = np.zeros((m, min(step, int(column[-1]) + 1 - lo)), np.float32)
            dense[owner[k0:k1], column[k0:k1] - lo] = 1
            shared += dense @ dense.T
    linked = shared / (size[:, None] + size[None, :] - shared) >= threshold
    np.fill_diagonal(linked, False)
    if not diagonal:
        linked &= block[:, None] != block[None, :]
    a, b = np.nonzero(np.triu(linked))
    return (linked @ weight).astype(np.int64), roots(m, a, b)


def _probes(size: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64("row", F.lit(k)), F.lit(size)) for k in range(PROBES)])


def _filter(keys: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """A Bloom filter of ``row``: its size in bits, which is bounded, and its 64-bit words."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(10, (n * BITS_PER_KEY - 1).bit_length()))
    words = keys.select(F.explode(_probes(size)).alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 64))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return size, out


def _sets(held):
    """The hash and the shingles of the sets whose row the filter holds, each once in a piece."""

    def run(batches):
        hashes, words = WordHashes(), held.value
        for batch in pieces(batches):
            probes = batch.column("probes").flatten().to_numpy().reshape(-1, PROBES)
            hit = ((words[probes >> 6] >> (probes & 63).astype(np.uint64)) & np.uint64(1)).all(1)
            found = {}
            for text in batch.column("text").filter(pa.array(hit)).to_pylist():
                v = shingles(text, hashes).tobytes()
                found[xxhash.xxh3_128_digest(v)] = v
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["sig", "shingles"])

    return run


def _classes(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(doc_id, row, sig, least, n_links, n_copies) of every row; ``least`` is the class's least row (none, doc_id, row), null ids coming last."""
    spark = docs.sparkSession
    id_field = docs.schema["doc_id"].dataType
    binary, long = T.BinaryType(), T.LongType()
    least_type = T.StructType([T.StructField("none", T.BooleanType()), T.StructField("doc_id", id_field), T.StructField("row", long)])
    fields = lambda **kinds: T.StructType([T.StructField(n, k) for n, k in kinds.items()])
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), row_key().alias("row"))
    all_rows = saved(docs.mapInArrow(_sketches(runs_needed(recall, threshold)), fields(doc_id=id_field, row=long, sig=binary, sketch=binary, n=long, paths=T.ArrayType(long))))
    reps = saved(few(all_rows.where("sig is not null").groupBy("sig").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"), F.count("*").alias("copies"),
        F.first("sketch").alias("sketch"), F.first("n").alias("n"), F.first("paths").alias("paths"))).withColumn("node", F.xxhash64("sig")))

    # Nodes are hashes of sets; should two sets share one, they only become candidates of each other.
    groups = components(candidate_links(reps.select("node", "sketch", "paths"), threshold))
    members = reps.select("node", "sig", "least", "copies", "n").join(groups, "node").drop("node")
    blocks = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total")).select(
        "root", F.ceil(F.greatest(F.col("m") / TILE_ROWS, F.col("total") / TILE_SHINGLES)).cast("int").alias("blocks"))
    members = saved(few(members.join(blocks, "root")).withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")))
    count, most = members.agg(F.count("*"), F.max("blocks")).first()

    size, words = _filter(members.select("least.row"), count)
    held = spark.sparkContext.broadcast(words)
    sets = docs.select("text", _probes(size).alias("probes")).mapInArrow(_sets(held), "sig binary, shingles binary")
    found = sets.join(members.hint("merge"), "sig")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = found.select("*", other.alias("other")).select(
        F.concat_ws("-", F.col("root"), F.least("block", "other"), F.greatest("block", "other")).alias("tile"),
        (F.col("block") == F.col("other")).alias("diagonal"), "sig", "shingles", "copies", "block", "blocks", "least")
    verified = saved(few(tiles.repartition("tile").sortWithinPartitions("tile", "sig")).mapInArrow(
        _verify(threshold, pa_type(id_field)), fields(sig=binary, links=long, root=binary, least=least_type, whole=T.BooleanType())))
    held.unpersist()

    info = verified.where("whole").select("sig", "links", "least")
    if (most or 0) > 1:
        split = verified.where("not whole")
        head = components(split.select(F.col("sig").alias("a"), F.col("root").alias("b")))
        own = split.groupBy("sig").agg(F.sum("links").alias("links"), F.first("least").alias("own"))
        own = saved(few(own.join(head.withColumnRenamed("node", "sig"), "sig", "left")).withColumn("head", F.coalesce("root", "sig")))
        info = info.union(own.join(own.groupBy("head").agg(F.min("own").alias("least")), "head").select("sig", "links", "least"))
    per_set = reps.select("sig", F.col("least").alias("own"), "copies").join(info, "sig", "left").select(
        "sig", F.coalesce("least", "own").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "copies")
    return all_rows.select("doc_id", "row", "sig").join(per_set, "sig", "left").select(
        "doc_id", "row", "sig", "least", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def jaccard_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies), one row for each row of ``docs`` (doc_id, text).

    ``class_id`` is the least doc_id of the documents that chains of links join; ``n_links``
    counts the other documents linked directly, copies included; ``n_copies`` the rows with the
    same set of shingles. A text of fewer than five words has one shingle, all its words. A text
    without words (null, empty, blank) is linked to nothing: its class is its own doc_id. Rows
    with a null or repeated doc_id are documents of their own; repeated rows are copies. Whole
    texts count, however long. Other columns, whatever their names, are ignored.
    """
    rows = _classes(docs, threshold, recall)
    return rows.select("doc_id", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"), "n_links", "n_copies")


def keep_one(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the least doc_id stays, null ids coming last.

    Rows are told apart by doc_id and text, so that a repeated doc_id with another text is a
    document of its own; of rows equal in both one stays. Texts without words are duplicates of
    nothing and all stay. Columns keep their names, order and values.
    """
    rows = saved(_classes(docs, threshold, recall).where("sig is not null").select("row", F.col("least.row").alias("stays")))
    gone = rows.where("row != stays").select("row").distinct()
    again = rows.where("row = stays").groupBy("row").count().where("count > 1").select("row")
    whole = docs.select(row_key().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    marked = whole.join(gone.withColumn("mark", F.lit(1)).union(again.withColumn("mark", F.lit(2))).hint("shuffle_hash"), "row", "left").where("mark is null or mark = 2")
    once = marked.where("mark = 2").groupBy("row").agg(F.first("whole").alias("whole"))
    out = marked.where("mark is null").select("whole").union(once.select("whole"))
    return out.select(*[F.col(f"whole.`{c}`") for c in docs.columns])
