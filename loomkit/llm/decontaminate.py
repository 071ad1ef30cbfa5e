"""Operator 5: benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised words) and units turn into typed
placeholders, other words into lower case. A word at the start of a sentence may be a name or
not, so each text has two templates, one of either reading. Runs of ``WINDOW`` template tokens
are joined by hash with those of the benchmark items, so that a question with other numbers or
names still meets its original. A match counts only if its slots are consistent: at one
alignment of text and item, equal slots of the item stand for equal slots of the text, and
the other way round.

Two exact paths go beside the templates, both over the tokens' own hashes. ``RUN`` consecutive
tokens of an item are a leak however long the item is, and an item too dense in numbers, names
and units to have a window of enough literals is looked up by its words as they stand.

All three are one Spark join of the items' windows with the documents' windows. Of the
documents only windows that pass a Bloom filter of the items', whose size is bounded, leave
the scan; neither texts nor items are gathered anywhere.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, fields, mix, pieces, saved, segments, windows

WINDOW, LEAST_LITERALS, LEAST_SHARE = 8, 5, 0.3
#: So many consecutive tokens word for word are a leak, whatever share of the item they are.
RUN = 13
#: Bits of the filter: 64 for each window of the benchmark, and never more than 16 MB in all.
BITS_PER_KEY, MOST_BITS, PROBES = 64, 1 << 27, 3

# The units that count as slots.
UNITS = frozenset("% $ € £ ° mm cm m km in ft mi mg g kg lb oz ml l s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year mph kmh km/h dollars dollar euros euro cents cent percent metres meters miles inches feet grams kilograms litres liters".split())
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,]\d+)*|[%$€£°]|[.!?]+(?=\s|$)|\n+")
LITERAL, CAPITAL, NUMBER, UNIT, END = range(5)
_PLACE = mix(np.arange(1, 6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: The paths by which a window may match: as a template, word for word, as a run.
TEMPLATE, PLAIN, LONG = range(3)
_PATH = mix(np.arange(11, 14, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Vocabulary(dict):
    """token -> its hash with the last three bits giving its kind; emptied when it holds half a million."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        low = token.lower()
        kind = END if token[0] in ".!?\n" else NUMBER if token[0].isdigit() else UNIT if low in UNITS else CAPITAL if token.istitle() else LITERAL
        k = self[token] = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) & ~7 | kind
        return k


class Reading:
    """Several texts read together: their tokens' hashes and kinds without sentence ends, ``cut`` between the texts.

    ``kinds`` has two rows: capitalised words at the start of a sentence are literals in the first, names in the second.
    """

    def __init__(self, known: Vocabulary, texts: list[str | None]):
        coded = [np.fromiter(map(known.__getitem__, TOKEN.findall(t or "")), np.uint64) for t in texts]
        ends = np.cumsum([0, *map(len, coded)])
        coded = np.concatenate([*coded, np.zeros(0, np.uint64)])
        kind, h = (coded & np.uint64(7)).astype(np.int8), coded & ~np.uint64(7)
        first = np.ones(len(kind), bool)
        first[1:] = kind[:-1] == END
        first[ends[:-1][ends[:-1] < len(first)]] = True
        stays = kind != END
        self.cut = np.concatenate([[0], np.cumsum(stays)])[ends]
        self.h = h[stays]
        self.kinds = np.stack([np.where((kind == CAPITAL) & first, LITERAL, kind), kind])[:, stays].astype(np.int8)
        self.templates = np.where(self.kinds == LITERAL, self.h, _PLACE[self.kinds])
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.cut))

    def places(self, width: int) -> np.ndarray:
        """Where windows of ``width`` tokens begin, none reaching over a text's end."""
        at = np.arange(max(0, len(self.h) - width + 1))
        return at[self.owner[at] == self.owner[at + width - 1]]

    def template_windows(self, width: int):
        """(row of ``kinds``, places, hashes): the windows by the first reading, and those that the second reads otherwise."""
        at = self.places(width)
        if not len(at):
            return
        one, two = (windows(t, width)[at] for t in self.templates)
        yield 0, at, one ^ _PATH[TEMPLATE]
        other = one != two
        yield 1, at[other], two[other] ^ _PATH[TEMPLATE]

    def plain_windows(self, width: int, path: int):
        at = self.places(width)
        return (at, windows(self.h, width)[at] ^ _PATH[path]) if len(at) else (at, np.zeros(0, np.uint64))


ITEM_WINDOWS = T.StructType([T.StructField(n, k) for n, k in (
    ("item_id", T.LongType()), ("path", T.IntegerType()), ("width", T.IntegerType()), ("hash", T.LongType()), ("offset", T.IntegerType()), ("tokens", T.BinaryType()), ("slots", T.BinaryType()), ("windows", T.LongType()))])


def _item_windows(batches):
    """The windows by which each item may be found, with the hashes and slot kinds of their tokens, and how many windows the item has."""
    known = Vocabulary()
    for batch in pieces(batches):
        out = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            r = Reading(known, [text])
            n = len(r.h)
            if not n:
                continue
            width = min(WINDOW, n)
            rows = [
                (TEMPLATE, int(at), int(h), kinds[at : at + width]) for k, places, hashes in r.template_windows(width) for kinds in [r.kinds[k]] for at, h in zip(places, hashes, strict=True)
                if (kinds[at : at + width] == LITERAL).sum() >= min(LEAST_LITERALS, width)]
            rows = rows or [(PLAIN, int(at), int(h), np.zeros(width, np.int8)) for at, h in zip(*r.plain_windows(width, PLAIN), strict=True)]
            total = len({at for _, at, _, _ in rows})
            if n >= RUN:
                rows += [(LONG, int(at), int(h), np.zeros(0, np.int8)) for at, h in zip(*r.plain_windows(RUN, LONG), strict=True)]
            out += [(item, path, RUN if path == LONG else width, np.uint64(h).astype(np.int64), at, b"" if path == LONG else r.h[at : at + width].tobytes(), slots.tobytes(), total) for path, at, h, slots in rows]
        cols = list(zip(*out, strict=True)) or [[]] * 8
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ITEM_WINDOWS.names)


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """The filter's bits of each hash, one column for each probe."""
    return np.stack([mix(hashes + np.uint64(k)) % np.uint64(size) for k in range(PROBES)], 1).astype(np.int64)


def _filter(hashes: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the column ``hash``, as 64-bit words; its size is bounded."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(12, (n * BITS_PER_KEY - 1).bit_length()))

    def probe(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bits(batch.column("hash").to_numpy().view(np.uint64), size).ravel())], ["bit"])

    words = hashes.select("hash").mapInArrow(probe, "bit long").groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 64))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _document_windows(held, template_widths: list[int], plain_widths: list[int]):
    """(row, doc_id, hash, place, tokens, slots): the windows that the filter holds."""
    def run(batches):
        known, words = Vocabulary(), held.value
        size = len(words) * 64
        for batch in pieces(batches):
            r = Reading(known, batch.column("text").to_pylist())
            found = [(places, hashes, r.kinds[k], w) for w in template_widths for k, places, hashes in r.template_windows(w)]
            found += [(*r.plain_windows(w, PLAIN), None, w) for w in plain_widths] + [(*r.plain_windows(RUN, LONG), None, 0)]
            at, hashes, tokens, slots = [], [], [], []
            for places, h, kinds, width in found:
                first = _bits(h, size) if len(h) else np.zeros((0, PROBES), np.int64)
                hit = np.nonzero(((words[first >> 6] >> (first & 63).astype(np.uint64)) & np.uint64(1)).all(1))[0]
                at.append(places[hit])
                hashes.append(h[hit])
                tokens += [r.h[p : p + width].tobytes() for p in places[hit]]
                slots += [b"" if kinds is None else kinds[p : p + width].tobytes() for p in places[hit]]
            at, hashes = np.concatenate(at), np.concatenate(hashes)
            owner = r.owner[at] if len(at) else at
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(take), batch.column("doc_id").take(take), pa.array(hashes.view(np.int64)), pa.array((at - r.cut[owner]).astype(np.int32)), pa.array(tokens, pa.binary()), pa.array(slots, pa.binary())],
                ["row", "doc_id", "hash", "place", "doc_tokens", "doc_slots"])

    return run


def _consistent(rows: list[tuple]) -> list[bool]:
    """Of the matching windows at one alignment, in order, which ones have consistent slots; (item's tokens, item's slots, text's tokens, text's slots) each."""
    there, back, ok = {}, {}, []
    for item_h, item_kind, doc_h, doc_kind in rows:
        pairs = {(int(item_h[k]), int(doc_h[k])) for k in np.nonzero((item_kind != LITERAL) | (doc_kind != LITERAL))[0]}
        good = len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}) and all(there.get(a, b) == b and back.get(b, a) == a for a, b in pairs)
        ok.append(good)
        if good:
            there.update(pairs)
            back.update((b, a) for a, b in pairs)
    return ok


def _covered(offsets: set[int]) -> int:
    """How many tokens of an item lie in its runs that begin at ``offsets``."""
    at = sorted(offsets)
    return RUN + sum(min(RUN, y - x) for x, y in zip(at, at[1:], strict=False)) if at else 0


def _judge(batches):
    """One row for each pair of a document and an item whose windows met; rows come sorted by pair."""
    for t in segments(batches, "pair"):
        rows = t.to_pylist()
        out, lo = [], 0
        while lo < len(rows):
            hi = lo
            while hi < len(rows) and rows[hi]["pair"] == rows[lo]["pair"]:
                hi += 1
            matched: dict[int, bool] = {}
            runs: set[int] = set()
            by: dict[int, list[dict]] = {}
            for r in rows[lo:hi]:
                if r["path"] == LONG:
                    runs.add(r["offset"])
                elif r["path"] == PLAIN:
                    matched[r["offset"]] = True
                else:
                    by.setdefault(r["place"] - r["offset"], []).append(r)
            for d in sorted(by):
                some = sorted(by[d], key=lambda r: (r["offset"], r["slots"], r["doc_slots"]))
                read = [(np.frombuffer(r["tokens"], "<u8"), np.frombuffer(r["slots"], np.int8), np.frombuffer(r["doc_tokens"], "<u8"), np.frombuffer(r["doc_slots"], np.int8)) for r in some]
                for r, ok in zip(some, _consistent(read), strict=True):
                    if ok:
                        matched[r["offset"]] = matched.get(r["offset"], False) or r["tokens"] == r["doc_tokens"]
            r = rows[lo]
            out.append((r["row"], r["doc_id"], r["item_id"], len(matched), r["windows"], sum(matched.values()), _covered(runs)))
            lo = hi
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], t["doc_id"].type), *(pa.array(c, pa.int64()) for c in cols[2:])], ["row", "doc_id", "item_id", "matched", "windows", "verbatim", "in_runs"])


def row_key() -> Column:
    """A hash of (doc_id, text): rows that are equal in both are one document."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").cast("string"))


def _leaks(docs: DataFrame, benchmark: DataFrame, least_share: float) -> DataFrame:
    spark, long = docs.sparkSession, T.LongType()
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = saved(few(items).mapInArrow(_item_windows, ITEM_WINDOWS))
    widths = [(r["path"], r.width) for r in items.groupBy("path", "width").count().orderBy("path", "width").collect()]
    held = spark.sparkContext.broadcast(_filter(items, items.count()))
    rows = docs.select(row_key().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    of = lambda path: [w for p, w in widths if p == path]
    schema = fields(rows, ("text",), hash=long, place=T.IntegerType(), doc_tokens=T.BinaryType(), doc_slots=T.BinaryType())
    found = rows.mapInArrow(_document_windows(held, of(TEMPLATE), of(PLAIN)), schema)
    met = found.join(items, "hash").withColumn("pair", F.concat_ws(" ", "row", "item_id"))
    # The rows of equal documents and items repeat windows, which are counted once.
    judged = few(met.repartition("pair").sortWithinPartitions("pair")).mapInArrow(_judge, T.StructType([
        T.StructField("row", long), rows.schema["doc_id"], *[T.StructField(n, long) for n in ("item_id", "matched", "windows", "verbatim", "in_runs")]]))
    return judged.where((F.col("matched") >= F.col("windows") * least_share) & (F.col("matched") > 0) | (F.col("in_runs") > 0))


def leaks(docs: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, item_id, matched, windows, verbatim, in_runs): the items that a document holds, by template or word for word.

    ``matched`` of the item's ``windows`` are in the text with consistent slots, ``verbatim`` of
    them word for word, and ``in_runs`` of its tokens lie in runs of ``RUN`` or more that are in
    the text word for word; at least ``least_share`` of the windows must be matched, or one run
    be held. An item of fewer than eight tokens is one window. An item with no window of five
    literal words (or, if it is shorter, with a slot) has its windows matched word for word only.
    An item without tokens is never found. Whole texts are searched, however long. Null and empty
    texts hold nothing; rows with a null item_id are left out; repeated items count once, and so
    do documents that are equal in doc_id and text. Other columns are ignored.
    """
    return _leaks(docs, benchmark, least_share).drop("row")


def clean(docs: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, told apart by doc_id and text; columns keep their names, order and values."""
    gone = _leaks(docs, benchmark, least_share).select("row").distinct()
    whole = docs.select(row_key().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    kept = whole.join(gone.hint("shuffle_hash"), "row", "left_anti")
    return kept.select(*[F.col(f"whole.`{c}`") for c in docs.columns])
