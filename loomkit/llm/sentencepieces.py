"""SentencePiece ids of whole texts and back, segmenting each distinct marked word once.

Where no piece of a model holds a white space marker behind another character, no merge crosses
from one marked word into the next, so a text's ids are those of its marked words, one after the
other. A task cuts its texts into marked words and keeps each text as places in a dictionary of
its block (a run of documents of bounded size). The words of all blocks are dealt out by their
hash, so that each distinct one is segmented once; the ids go back to their block by
place, and a text's ids are joined up by position.

A null text counts as an empty one; both have the begin and the end id alone. Repeated rows stay
repeated, rows of an equal doc_id are documents of their own, an empty table gives none. All
other columns stay, whatever they are called.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, mapped, pieces

MARK = "▁"
#: A block ends at so many marked words; one document is never parted, so that a longer one is a block by itself.
BLOCK_WORDS = 6_000_000
#: Words travel in lists by the remainder of their hash; a task holds the distinct words of one such bucket at a time.
BUCKETS = 4096


class Segmenter:
    """A model's ids of marked words; a model whose pieces cross markers, or that sets no marker before a text, is refused."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        several = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in several) or self.model.normalize("a") != MARK + "a":
            raise ValueError(f"the pieces of {model} may cross white space markers")
        self.lead = self.model.piece_to_id(MARK)
        # A character that only stands alone parts words as well; what it leads is segmented behind a marker, whose id then goes.
        alone = not any("\n" in p for p in several) and self.model.normalize("a\nb") == f"{MARK}a\nb" and self.model.encode("\na")[0] == self.lead
        self.words = re.compile(f"{MARK}+[^{MARK}\n]*|\n+[^{MARK}\n]*" if alone else f"{MARK}+[^{MARK}]*")

    def cut(self, text: str | None) -> list[str]:
        return self.words.findall(self.model.normalize(text)) if text else []

    def ids(self, words: list[str]) -> list[list[int]]:
        """The model itself sets the first marker of a word."""
        found = self.model.encode([w[1:] if w[0] == MARK else w for w in words], num_threads=1)
        # A marker alone is what an empty text lacks.
        return [i[1:] if w[0] != MARK else i or [self.lead] for w, i in zip(words, found, strict=True)]


@lru_cache(maxsize=4)
def segmenter(model: str) -> Segmenter:
    return Segmenter(model)


class _Places(dict):
    """word -> its place in the order of first use"""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _packed(numbers) -> bytes:
    """Numbers under 2**32 as planes of bytes, the higher of which are mostly zeros, compressed."""
    return zstandard.compress(np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _marked(places: np.ndarray, base: int) -> np.ndarray:
    """``places`` one higher, and 0 where a word is used for the first time: its place is the next one, and ``base`` words were known before."""
    places = places.astype(np.int64)
    known = np.maximum.accumulate(np.r_[base - 1, places])[:-1]
    return np.where(places > known, 0, places + 1)


def _placed(marked: np.ndarray, base: int) -> np.ndarray:
    places = marked.astype(np.int64) - 1
    new = places < 0
    places[new] = base + np.arange(new.sum())
    return places


def _blocks(rows: DataFrame, model: str, most: int) -> DataFrame:
    """Of ``rows`` (row, text): (block, row, base, places) of each document, and (block, bucket, places, words) of each bucket of a block's distinct words."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("row", rows.schema["row"].dataType), T.StructField("places", T.BinaryType()),
                           T.StructField("base", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("words", T.BinaryType())])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, cut = to_arrow_schema(schema), segmenter(model).cut
        block, held, n = TaskContext.get().partitionId() << 32, _Places(), 0

        def out(size, **columns):
            columns["block"] = pa.array([block] * size, pa.int64())
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in kinds], schema=kinds)

        def dictionary():
            # A normalised word holds no space, so that spaces part the words of a list.
            words = list(held)
            bucket = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words)) % BUCKETS
            order = np.argsort(bucket, kind="stable")
            parts = [x for x in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(x)]
            lists = [zstandard.compress(" ".join(map(words.__getitem__, x.tolist())).encode(), 1) for x in parts]
            return out(len(parts), bucket=pa.array([int(bucket[x[0]]) for x in parts], pa.int32()), places=pa.array(map(_packed, parts), pa.binary()), words=pa.array(lists, pa.binary()))

        for batch in pieces(batches):
            begin, places, bases = 0, [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = cut(text)
                bases.append(len(held))
                places.append(_packed(_marked(np.fromiter(map(held.__getitem__, words), np.uint32, len(words)), bases[-1])))
                n += len(words)
                if n >= most or k + 1 == batch.num_rows:
                    yield out(k + 1 - begin, row=batch.column(0).slice(begin, k + 1 - begin), base=pa.array(bases, pa.int32()), places=pa.array(places, pa.binary()))
                    begin, places, bases = k + 1, [], []
                if n >= most:
                    yield dictionary()
                    block, held, n = block + 1, _Places(), 0
        if held:
            yield dictionary()

    return mapped(rows, run, schema)


def _segmented(lists: DataFrame, model: str) -> DataFrame:
    """(block, bucket, counts, ids) of ``lists`` (block, bucket, words), which lie sorted by bucket: each distinct word of a bucket is segmented once."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType())] + [T.StructField(n, T.BinaryType()) for n in ("counts", "ids")])

    def run(batches):
        import pyarrow as pa

        now, known, seg = None, {}, segmenter(model)
        for batch in pieces(batches):
            counts, ids = [], []
            for bucket, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                words = zstandard.decompress(packed).decode().split(" ")
                new = [w for w in words if w not in known]
                known.update(zip(new, (array("i", i) for i in seg.ids(new)), strict=True))
                found = [known[w] for w in words]
                counts.append(_packed(np.fromiter(map(len, found), np.uint32, len(found))))
                ids.append(_packed(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], schema.names)

    return mapped(lists, run, schema)


def _gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts`` and are ``counts`` long, for each of ``at`` in turn."""
    n = counts[at]
    return values[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def encode(docs: DataFrame, model: str, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without ``text``, with ids array<int>: what the library's encode gives for the whole text, begin and end ids included.

    ``model`` is the path of the model's file, the same on every executor.
    """
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*([F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)] or [F.lit(0).alias("none")])).alias("row"), F.col(f"`{text}`").alias("text"))
    blocks = bucketed(_blocks(rows, model, block_words), "block")
    lists = blocks.where("words is not null").select("block", "bucket", "words")
    known = _segmented(lists.repartition("bucket").sortWithinPartitions("bucket"), model)
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def joined(texts, entries):
        import pyarrow as pa
        import pyarrow.compute as pc

        seg = segmenter(model).model
        # The ids of the block's words by place, and behind them the begin and the end id as two words more.
        own = {b: p for b, p in zip(texts["bucket"].to_pylist(), texts["places"].to_pylist(), strict=True) if b is not None}
        parts = {"places": [own[b] for b in entries["bucket"].to_pylist()]} | {c: entries[c].to_pylist() for c in ("counts", "ids")}
        place, count, values = (np.concatenate([np.zeros(0, np.uint32), *map(_unpacked, parts[c])]).astype(np.int64) for c in ("places", "counts", "ids"))
        last = len(place)
        counts, starts = np.ones(last + 2, np.int64), np.zeros(last + 2, np.int64)
        counts[place], starts[place] = count, np.cumsum(count) - count
        starts[last:] = len(values) + np.arange(2)
        values = np.r_[values, seg.bos_id(), seg.eos_id()].astype(np.int32)
        for part in texts.filter(pc.is_null(texts["bucket"])).select(["row", "base", "places"]).to_batches(max_chunksize=500):
            at = [np.r_[last, _placed(_unpacked(p), b), last + 1] for b, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            ends = np.cumsum(np.fromiter((counts[x].sum() for x in at), np.int64, len(at)))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(_gathered(values, starts, counts, np.concatenate(at))))
            yield [part.column(0), lists]

    def run(texts, entries):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, schema=kinds) for x in joined(texts, entries)], kinds)

    # A block's texts and the places of its words stay where they were written; the ids of its words come to them.
    texts = blocks.select("block", "row", "base", "places", "bucket")
    out = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)
    return out.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(others)], "ids")


def _decoded(batches, model: str, at: int):
    """Batches with a column more: the text of the ids in column ``at``."""
    import pyarrow as pa

    for batch in pieces(batches):
        found = segmenter(model).model.decode([i or [] for i in batch.column(at).to_pylist()], num_threads=1) if batch.num_rows else []
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [f"c{k}" for k in range(batch.num_columns + 1)])


def decode(encoded: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with ``text``: what the library's decode gives for ``ids``; null ids give an empty text."""
    names, at = [*encoded.columns, text], encoded.columns.index(ids)
    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(encoded.schema.fields)] + [T.StructField(f"c{len(names) - 1}", T.StringType())])
    return mapped(encoded, lambda batches: _decoded(batches, model, at), schema).toDF(*names)


def digest(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encoded`` (doc_id, ids) and its text; ids count as little-endian 32-bit numbers.

    With a ``model`` the text is what ``decode`` gives, and is digested where it is decoded, a few at a time, for
    each step of Python that follows another has workers and buffers of its own.
    """
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa

        for batch in _decoded(batches, model, 1) if model else batches:
            starts = batch.column(1).offsets.to_numpy()
            flat = np.ascontiguousarray(batch.column(1).values.to_numpy(zero_copy_only=False), "<i4")
            hashes = [sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            texts = [sha256(t.encode()).hexdigest() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts), pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], schema.names)

    return mapped(encoded.select("doc_id", "ids", *["text"] * (model is None)), run, schema)
