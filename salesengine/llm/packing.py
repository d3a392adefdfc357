"""Best-fit packing with certified bounds.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.
Pieces are dealt into groups of bounded size; each group is packed best-fit
decreasing.  Dual-feasible functions map lengths to weights of which no feasible
sequence holds more than its capacity, so the weights' sum bounds the number of
sequences from below; a group that needs no more sequences than its bound
is certified.  Groups with a gap keep the sequences that are full and
release the pieces of the others; the released pieces of several groups meet in
new groups, which rerun best-fit decreasing.  A certified group
releases its emptiest sequence as well, since the bounds of several groups
round up more often than one.  It ends when one group is left or when a round
saves no sequence (the pieces then stay where they were).

Only slim rows (ids, lengths, checksums) are shuffled.  Pieces are dealt by a
hash of a number that each row has got, so a group has about ``group_rows``
pieces whatever the data, equal rows included.

Defined cases: a null text is empty; a document without tokens is the end
token alone; rows of equal id and text are packed each by itself; documents of
one id but different texts keep their own pieces; an empty table gives an empty
frame; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import os
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.session import reliable_checkpoint

CAPACITY = 2048
END_ID = 0
GROUP_ROWS = 40_000

PIECES = "doc_id {id}, copy long, piece int, start long, length long, ids_crc32 long"


# ------------------------------------------------------------------ tokens

def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordCache:
    """Ids of a text as little-endian 32-bit bytes, by a tokenizer that drops white space and treats the words between alone.

    Ids are kept by word, and by the letter runs, digits and sign runs that the
    tokenizer splits a word into, for as many of either as ``limit`` allows.
    Only words of ASCII or Latin letters without a special token are split here;
    the tokenizer gets all others whole.
    """

    #: White space as the tokenizer's \\s knows it, and its split of lower-case words (fixed values).
    space = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    ascii_parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
    latin_parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, tokenizer_json: str, limit: int = 800_000, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        # the byte-level letters: printable Latin-1 stands for itself, other bytes for what follows from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = iter(range(256, 512))
        self.letters = [chr(b if b in plain else next(others)) for b in range(256)]
        self.limit, self.longest = limit, longest
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _split(self, word: str) -> list[str] | None:
        """The parts of a word as the tokenizer's model gets them, None for a word that the tokenizer should see."""
        if "<|" not in word:
            if word.isascii():
                return self.ascii_parts.findall(word.lower())
            if max(word) < "\u0250":
                return self.latin_parts.findall(unicodedata.normalize("NFC", word).lower())
        return None

    def _part(self, part: str) -> bytes:
        if not (part.isascii() and part.isprintable()):
            part = "".join([self.letters[b] for b in part.encode("utf-8")])
        return _bytes([t.id for t in self.model.tokenize(part)])

    def _word(self, word: str) -> bytes:
        parts = self._split(word)
        if parts is None:
            return _bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        held = self.parts
        out = []
        for p in parts:
            ids = held.get(p)
            if ids is None:
                ids = self._part(p)
                if len(p) <= self.longest:
                    held[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        words, known = self.space.split(text), self.words
        if len(known) > self.limit:
            known.clear()
        if len(self.parts) > self.limit:
            self.parts.clear()
        out = list(map(known.get, words))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            w = words[k]
            out[k] = known.get(w) or self._word(w)  # it may be known from an earlier place by now
            if len(w) <= self.longest:
                known[w] = out[k]
        return b"".join(out)


_CACHES: dict[int, WordCache] = {}  # of a Python worker, which runs many tasks


def _cache(tokenizer_json: str) -> WordCache:
    key = hash(tokenizer_json)
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = WordCache(tokenizer_json)
    return _CACHES[key]


def _pieces(tokenizer_json, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(tokenizer_json.value)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc, copy, text in zip(*(batch.column(c) for c in ("doc_id", "copy", "text")), strict=True):
                ids = cache.encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for col, v in zip(cols, (doc.as_py(), copy.as_py(), piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32"]
            types = [batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, copy, piece, start, length, ids_crc32) of every piece; ``copy`` is a hash of the text, which tells rows of one id apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokenizer_json = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text("utf-8"))  # the driver's file, of fixed size
    texts = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    return texts.mapInArrow(_pieces(tokenizer_json, capacity), PIECES.format(id=kind))


# ------------------------------------------------------------------ one group

def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every length, and the room left in every bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r set: a bin has room r
    room: list[int] = []
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = rooms >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1  # the tightest room that holds n
            b = open_bins[r].pop()
            if not open_bins[r]:
                rooms &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r - n
        if r > n:
            open_bins[r - n].append(b)
            rooms |= 1 << (r - n)
    return bins, offsets, np.array(room, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound that the dual-feasible functions below give for the number of bins."""
    count = np.bincount(lengths, minlength=capacity + 1)[:capacity + 1]
    sizes = np.arange(capacity + 1)
    best = -(-int(count @ sizes) // capacity)
    below, mass = np.cumsum(count), np.cumsum(count * sizes)
    # lengths over capacity - e count as whole bins, those under e as nothing
    for e in range(1, capacity // 2 + 1):
        whole = len(lengths) - below[capacity - e]
        middle = mass[capacity - e] - mass[e - 1]
        best = max(best, int(whole) - int(-middle // capacity))
    # rounding down to multiples of capacity / k, where a length that is a multiple stays
    for k in range(2, 21):
        scaled = (k + 1) * sizes
        weight = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)
        best = max(best, -(-int(count @ weight) // (k * capacity)))
    return best


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        if len(room) <= lower_bound(lengths, capacity):
            out = np.flatnonzero(room == room.max())[:1]  # certified: only the slack of the rounding is worth an exchange
        else:
            out = np.flatnonzero(room > 0)
        kept = np.ones(len(room), bool)
        kept[out[room[out] > 0]] = False
        pdf["sequence_id"] = (pdf["grp"].to_numpy(np.int64) << 24) + bins
        pdf["offset"] = offsets
        pdf["kept"] = kept[bins]
        return pdf.drop(columns="grp")
    return run


# ------------------------------------------------------------------ rounds

def pack(sized: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``sized`` (doc_id, copy, piece, start, length, ids_crc32) with sequence_id and offset: gapless from 0 in each sequence."""
    names = sized.columns
    sized = reliable_checkpoint(sized.withColumn("_row", F.monotonically_increasing_id()))
    # a piece of full length is a sequence by itself; numbers below zero are theirs
    whole = sized.where(F.col("length") == capacity)
    done = [whole.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = sized.where(F.col("length") < capacity)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema) + ", sequence_id long, offset long, kept boolean"
    first_group, before, round_ = 0, None, 0
    while groups := math.ceil(rest.count() / group_rows):
        # dealt by a hash of the row's number, not by document or length, so that no group is hot and every group has all lengths
        deal = F.pmod(F.xxhash64("doc_id", "copy", "piece", "_row", F.lit(round_)), F.lit(groups)) + first_group
        round_ += 1
        packed = reliable_checkpoint(rest.select(*names, "_row", deal.alias("grp")).groupBy("grp").applyInPandas(_pack(capacity), schema))
        if before is not None and packed.agg(F.count_distinct("sequence_id")).first()[0] >= before:
            break  # the exchange saves nothing: the released pieces stay where they were
        done.append(packed.where("kept").select(*names, "sequence_id", "offset"))
        rest = packed.where("not kept")
        before = rest.agg(F.count_distinct("sequence_id")).first()[0]
        first_group += groups
        if groups == 1:
            break
    if before:
        done.append(rest.select(*names, "sequence_id", "offset"))
    return reliable_checkpoint(reduce(DataFrame.unionByName, done))
