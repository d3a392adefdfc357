"""Substring dedup with a count-min prefilter.

A window is ``width`` consecutive words of one document.  Words are removed
that a window covers whose word sequence also starts in a document of smaller
id.

Nearly all windows of a corpus are unique, so they should not be shuffled.  A
first pass adds every document's distinct windows to count-min sketches, one for
each task; sketches are merged counter by counter.  A window's estimate is the
least of its counters and never below the number of documents that have it.  The
second pass keeps only windows estimated in two documents or more; these are
grouped exactly (by 96 bits of hash) to find the first document of each: first
within a task, which sends each window on for one document only, so that a hot
window has no more rows than there are tasks; then over all tasks, by parts of
the hash space, with windows packed into a few bytes each.  What the sketch
overestimates is dropped there, and nothing is lost whatever the sketch's size.

Counters saturate at 2, all the second pass asks for, so the merged sketch is a
bit for each counter.  It has ``COUNTERS_PER_WORD`` counters for each expected
window and ``MAX_COUNTERS`` at most, which bounds its broadcast (16 MB a 2^27
counters); beyond that more unique windows pass the prefilter and meet the
exact grouping instead.

Defined cases: null and empty texts have no words; documents shorter than a
window keep all words; rows of equal id count as one document for each other
(neither removes from the other) and keep their rows; a null id is smaller than
all others; an empty table gives an empty frame; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.llm.hashing import window_hashes, word_hashes, words
from salesengine.session import reliable_checkpoint

WIDTH = 13
DEPTH = 2
COUNTERS_PER_WORD = 8  # all rows of the sketch together
BYTES_PER_WORD = 6  # only sizes the sketch
MAX_COUNTERS = 1 << 30
SEGMENT = 1 << 20
#: Windows a task holds before it sends its sketch on and begins another.
FLUSH = 3_000_000
#: Windows that one part of the hash space has at most, about.
PART = 4_000_000
NULL_ID = -(1 << 63)


@dataclass(frozen=True)
class Shape:
    """Of a sketch: ``segments`` segments a row; and how many windows a task holds."""

    segments: int
    segment: int = SEGMENT
    flush: int = FLUSH

    @property
    def row(self) -> int:
        return self.segments * self.segment


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def windows(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window, in order."""
    low, high = word_hashes(*words(_data(text)), 21, 22)
    return window_hashes(low, width, 23), window_hashes(high, width, 24)


def _places(low: np.ndarray, high: np.ndarray, shape: Shape) -> list[np.ndarray]:
    """Each sketch row's counter for every window: rows lie one after another."""
    size = np.uint64(shape.row)
    return [((low + np.uint64(d) * high) % size + np.uint64(d) * size).astype(np.uint32) for d in range(DEPTH)]


# ------------------------------------------------------------------ the sketch

def _packed(places: np.ndarray) -> bytes:
    """Sorted counter numbers within a segment as compressed gaps (byte planes, as the high bytes are nearly all alike)."""
    gaps = np.diff(places, prepend=0).astype("<u4")
    return zstandard.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def _sketches(shape: Shape, width: int):
    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(held))
        number = every // shape.segment
        cuts = np.flatnonzero(np.diff(number)) + 1
        parts = np.split(every, cuts)
        names = [int(p[0]) // shape.segment for p in parts]
        blobs = [_packed(p - n * shape.segment) for p, n in zip(parts, names, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["segment", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column("text"):
                low, high = windows(text.as_py(), width)
                if len(low):
                    _, first = np.unique(low, return_index=True)  # a document counts a window once
                    held += _places(low[first], high[first], shape)
                    size += len(first)
                if size > shape.flush:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)
    return run


def _merge(size: int):
    """One bit for each counter of a segment: set if the tasks' counts add up to 2 or more.  Rows come sorted by segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: np.ndarray | None = None
        twice = np.zeros(0, bool)
        now = -1

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zstandard.compress(np.packbits(twice, bitorder="little").tobytes(), 1)], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            for segment, blob in zip(batch.column("segment").to_pylist(), batch.column("counts"), strict=True):
                if segment != now:
                    if seen is not None:
                        yield done()
                    seen, twice, now = np.zeros(size, bool), np.zeros(size, bool), segment
                at = _unpacked(blob.as_py())
                twice[at[1:][at[1:] == at[:-1]]] = True
                twice[at[seen[at]]] = True
                seen[at] = True
        if seen is not None:
            yield done()
    return run


def sketch(docs: DataFrame, shape: Shape, width: int = WIDTH) -> dict[int, bytes]:
    """Bits of all counters that reach 2, compressed, by segment; at most MAX_COUNTERS / 8 bytes."""
    parts = docs.select("text").mapInArrow(_sketches(shape, width), "segment int, counts binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge(shape.segment), "segment int, bits binary")
    return {r["segment"]: bytes(r["bits"]) for r in reliable_checkpoint(merged).toLocalIterator()}


def _flags(bits: dict[int, bytes], shape: Shape) -> np.ndarray:
    out = np.zeros(DEPTH * shape.row // 8, np.uint8)
    for segment, blob in bits.items():
        at = segment * shape.segment // 8
        out[at:at + shape.segment // 8] = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return out


# ------------------------------------------------------------------ windows that may repeat

def _planes(a: np.ndarray) -> bytes:
    """The bytes of all numbers' first places, then of their second places, and so on: like bytes lie together."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _from_planes(data: memoryview, kind: str, n: int) -> tuple[np.ndarray, memoryview]:
    size = np.dtype(kind).itemsize * n
    return np.ascontiguousarray(np.frombuffer(data[:size], np.uint8).reshape(-1, n).T).view(kind).ravel(), data[size:]


def _pack_windows(low: np.ndarray, high: np.ndarray, row: np.ndarray, place: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> bytes:
    """Windows sorted by ``low`` with the rows (numbers into ids and keys) that have them."""
    used, row = np.unique(row, return_inverse=True)
    order = np.argsort(ids[used], kind="stable")
    rank = np.empty(len(used), np.uint32)
    rank[order] = np.arange(len(used))
    used = used[order]
    body = b"".join(map(_planes, (
        np.diff(low, prepend=np.uint64(0)), high, rank[row], place.astype(np.uint32),
        np.diff(ids[used].view(np.uint64), prepend=np.uint64(0)), keys[used].astype(np.int32),
    )))
    return np.array([len(low), len(used)], "<i8").tobytes() + zstandard.compress(body, 1)


def _unpack_windows(blob: bytes) -> tuple[np.ndarray, ...]:
    """(low, high, doc_id, row_key, place)."""
    n, docs = np.frombuffer(blob[:16], "<i8").tolist()
    data = memoryview(zstandard.decompress(blob[16:]))
    out = []
    for kind, size in (("u8", n), ("u4", n), ("u4", n), ("u4", n), ("u8", docs), ("i4", docs)):
        x, data = _from_planes(data, kind, size)
        out.append(x)
    low, high, row, place, ids, keys = out
    return np.cumsum(low, dtype=np.uint64), high, np.cumsum(ids, dtype=np.uint64).view(np.int64)[row], keys[row], place


def _pack_places(place: np.ndarray) -> bytes:
    wide = len(place) and int(place.max()) >= 1 << 16
    return (b"4" if wide else b"2") + place.astype("<u4" if wide else "<u2").tobytes()


def _unpack_places(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob[1:], "<u4" if blob[:1] == b"4" else "<u2").astype(np.int64)


def _not_first(low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by window and document, and which places of it have a window that a smaller document has, too."""
    order = np.lexsort((doc, high, low))
    low, high, doc = low[order], high[order], doc[order]
    start = np.ones(len(order), bool)
    start[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    first = np.flatnonzero(start)
    return order, doc > np.repeat(doc[first], np.diff(np.append(first, len(doc))))


_DEALT = pa.schema([("part", pa.int32()), ("windows", pa.binary()), ("doc_id", pa.int64()), ("row_key", pa.int32()), ("places", pa.binary())])


def _gone_rows(doc: np.ndarray, key: np.ndarray, place: np.ndarray, part) -> pa.RecordBatch:
    """A row for each document with its removed windows' places."""
    order = np.lexsort((key, doc))
    doc, key, place = doc[order], key[order], place[order]
    start = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else np.empty(0, np.int64)
    blobs = [_pack_places(p) for p in np.split(place, start[1:])] if len(doc) else []
    n = len(start)
    return pa.RecordBatch.from_arrays([pa.array(part(doc[start]), pa.int32()), pa.nulls(n, pa.binary()), pa.array(doc[start], pa.int64()), pa.array(key[start].astype(np.int32)), pa.array(blobs, pa.binary())], schema=_DEALT)


def _repeated(bits, shape: Shape, width: int, part_bits: int):
    """The windows that the sketch estimates in two documents or more, dealt by their hash.

    What a task can tell by itself, that a window isn't in its first document, it settles at once: of each window
    a task deals out the occurrences in one document only, however common the window is.
    """
    def emit(held: list[tuple], ids: list, keys: list) -> Iterator[pa.RecordBatch]:
        low, high, row, place = (np.concatenate(c) for c in zip(*held, strict=True))
        ids, keys = np.array(ids, np.int64), np.array(keys, np.int32)
        order, later = _not_first(low, high, ids[row])
        gone, order = order[later], order[~later]
        yield _gone_rows(ids[row[gone]], keys[row[gone]], place[gone], lambda doc: (doc & ((1 << part_bits) - 1)).astype(np.int32))
        low, high, row, place = low[order], high[order], row[order], place[order]
        part = (low >> np.uint64(64 - part_bits)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(part)) + 1
        blobs = [_pack_windows(*x, ids, keys) for x in zip(*(np.split(c, cuts) for c in (low, high, row, place)), strict=True)] if len(low) else []
        n = len(blobs)
        numbers = part[np.append(0, cuts)] if n else part
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _flags(bits.value, shape)
        held, ids, keys, size = [], [], [], 0
        for batch in batches:
            for doc, key, text in zip(*(batch.column(c) for c in ("doc_id", "row_key", "text")), strict=True):
                low, high = windows(text.as_py(), width)
                if not len(low):
                    continue
                keep = np.ones(len(low), bool)
                for at in _places(low, high, shape):
                    keep &= (flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                place = np.flatnonzero(keep)
                if not len(place):
                    continue
                held.append((low[place], (high[place] >> np.uint64(32)).astype(np.uint32), np.full(len(place), len(ids), np.uint32), place.astype(np.uint32)))
                ids.append(doc.as_py())
                keys.append(key.as_py())
                size += len(place)
                if size > shape.flush // 2:
                    yield from emit(held, ids, keys)
                    held, ids, keys, size = [], [], [], 0
        if held:
            yield from emit(held, ids, keys)
    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the tasks' windows, part by part (rows come sorted by part)."""
    held: list[tuple] = []
    now = None

    def emit() -> pa.RecordBatch:
        low, high, doc, key, place = (np.concatenate(c) for c in zip(*held, strict=True))
        order, later = _not_first(low, high, doc)
        gone = order[later]
        return _gone_rows(doc[gone], key[gone], place[gone], lambda doc: np.zeros(len(doc), np.int32))

    for batch in batches:
        settled = batch.filter(batch.column("places").is_valid())
        if settled.num_rows:
            yield settled.select(["doc_id", "row_key", "places"])
        rest = batch.filter(batch.column("windows").is_valid())
        for part, blob in zip(rest.column("part").to_pylist(), rest.column("windows"), strict=True):
            if part != now and held:
                yield emit().select(["doc_id", "row_key", "places"])
                held = []
            now = part
            held.append(_unpack_windows(blob.as_py()))
    if held:
        yield emit().select(["doc_id", "row_key", "places"])


def _cut(width: int):
    """Applies the places of removed windows to whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, text, places in zip(*(batch.column(c) for c in ("doc_id", "text", "places")), strict=True):
                buf = _data(text.as_py())
                parts = buf.split()  # bytes: ASCII white space only
                n = len(parts)
                removed = 0
                if places.is_valid:
                    cover = np.zeros(n + 1, np.int64)
                    at = np.concatenate([_unpack_places(x.as_py()) for x in places.values])
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + width, -1)
                    gone = np.cumsum(cover[:n]) > 0
                    removed = int(gone.sum())
                    parts = [p for p, g in zip(parts, gone.tolist(), strict=True) if not g]
                for c, v in zip(out, (doc.as_py(), n, removed, b" ".join(parts)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], batch.schema.field("doc_id").type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                pa.array([b.decode("utf-8", "surrogatepass") for b in out[3]], pa.string()),
                pa.array([hashlib.sha256(b).hexdigest() for b in out[3]], pa.string()),
            ], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id as long (null: the least), a hash that tells rows of one id apart, and the text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.hash("text").alias("row_key"), "text")


def removals(docs: DataFrame, width: int = WIDTH, shape: Shape | None = None) -> DataFrame:
    """(doc_id, row_key, places): where the windows start that also start in a document of smaller id, in several rows a document.

    ``shape`` is the sketch's, by default one that fits the size of the texts.
    """
    spark = docs.sparkSession
    expected = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_PER_WORD
    counters = min(MAX_COUNTERS, max(DEPTH * SEGMENT, expected * COUNTERS_PER_WORD))
    shape = shape or Shape(-(-counters // (DEPTH * SEGMENT)))
    bits = spark.sparkContext.broadcast(sketch(docs, shape, width))
    # parts of at most PART windows, even if all of them repeated
    part_bits = max(6, math.ceil(math.log2(max(1, expected / PART))))
    dealt = _keyed(docs).mapInArrow(_repeated(bits, shape, width, part_bits), "part int, windows binary, doc_id long, row_key int, places binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_settle, "doc_id long, row_key int, places binary")


def deduplicated(docs: DataFrame, width: int = WIDTH, shape: Shape | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) of every row: the words that are left, joined by a space, and their hash."""
    gone = removals(docs, width, shape).groupBy("doc_id", "row_key").agg(F.collect_list("places").alias("places"))
    met = _keyed(docs).join(gone, ["doc_id", "row_key"], "left").select("doc_id", "text", "places")
    out = met.mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
