"""Document fingerprints by MinHash.

A text's shingles (five words; fewer words: the whole sequence) are hashed to 32
bits and put through ``PERMUTATIONS`` universal hash functions; the least values
are its signature, computed in numpy for many shingles and functions at once.
Signatures of two texts agree in as many places as the texts' shingle sets are
alike (Jaccard).

A fingerprint is the signature's places, a byte of each.

``near_duplicates`` joins signature bands in Spark and verifies candidates by
their exact shingle sets.

Defined cases: null and empty texts have no words and the signature of the
empty set, which is like itself only; equal texts have equal signatures; rows of
equal id keep their rows; an empty table gives an empty frame; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.llm.graph import components
from salesengine.llm.hashing import coefficients, window_hashes, word_hashes, words
from salesengine.session import reliable_checkpoint

SHINGLE_WORDS = 5
PERMUTATIONS = 256
#: Texts of likeness 0.8 share a band of 5 rows but for 2 pairs in 10^9; unlike texts hardly do.
BAND_ROWS = 5
SIMILARITY = 0.8
#: Bits of a place that a digest keeps; unlike places agree in them by chance once in 2 ** BITS.
BITS = 8
_BLOCK = 2048

_A = coefficients(PERMUTATIONS, 11)
_B = coefficients(PERMUTATIONS, 12)


def shingles(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hashes of the text's shingles, repeats included."""
    hashes = word_hashes(*words((text or "").encode("utf-8", "surrogatepass")), 5)[0]
    return window_hashes(hashes, max(1, min(width, len(hashes))), 6)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least value of (a h + b) mod 2^64, without its low half, over the 32-bit hashes h, for each function."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    h = hashes >> np.uint64(32)
    for k in range(0, len(h), _BLOCK):
        np.minimum(least, (_A[:, None] * h[None, k:k + _BLOCK] + _B[:, None]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def digest(sig: np.ndarray) -> str:
    """A fingerprint as text: the low ``BITS`` bits of every place, in hexadecimal."""
    return (sig & np.uint32((1 << BITS) - 1)).astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Jaccard likeness that two fingerprints show: the share of equal places, less what chance makes equal."""
    if a == b:
        return 1.0
    equal = float((np.frombuffer(bytes.fromhex(a), np.uint8) == np.frombuffer(bytes.fromhex(b), np.uint8)).mean())
    return max(0.0, (equal - 2.0**-BITS) / (1 - 2.0**-BITS))


# ------------------------------------------------------------------ signatures of a table

def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [shingles(t.as_py()) for t in batch.column("text")]
        sigs = [signature(h).view(np.int32) for h in hashes]
        flat = pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int32))
        offsets = pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * PERMUTATIONS)
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.ListArray.from_arrays(offsets, flat)], names=["row_key", "signature"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(shingles(t.as_py())).view(np.int64) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(found, pa.list_(pa.int64()))], names=["row_key", "shingles"])


def _keyed(docs: DataFrame) -> DataFrame:
    """The texts by a hash of theirs; the empty and the missing text have one."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """(row_key, signature array<int>) of every row; row_key is a hash of the text."""
    return _keyed(docs).select("row_key", "text").mapInArrow(_signatures, "row_key long, signature array<int>")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every row: the least doc_id reachable over links of texts at least ``similarity`` alike.

    Texts that share a band of their signatures are candidates; equal texts are one candidate.  In each round the
    next member of every bucket is compared, by exact shingle sets, with the members after it that aren't in its
    class yet; a bucket is done when its members are in one class or all were compared.  So the members of a class,
    however many, cost a comparison each and not one for each pair.
    """
    keyed = _keyed(docs)
    least = reliable_checkpoint(keyed.groupBy("row_key").agg(F.min("doc_id").alias("least")))
    bands = F.array(*(F.xxhash64(F.lit(b), F.slice("signature", b * BAND_ROWS + 1, BAND_ROWS)) for b in range(PERMUTATIONS // BAND_ROWS)))
    members = signatures(docs).select("row_key", F.explode(bands).alias("bucket")).distinct()
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = reliable_checkpoint(members.join(shared, "bucket"))
    wanted = members.select("row_key").distinct()
    texts = keyed.select("row_key", "text").join(wanted, "row_key", "left_semi").groupBy("row_key").agg(F.min("text").alias("text"))
    sets = reliable_checkpoint(texts.select("row_key", "text").mapInArrow(_sets, "row_key long, shingles array<long>"))
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    tried = links
    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    centres = members.groupBy("bucket").agg(F.min("row_key").alias("centre"))
    while True:
        named = members.join(roots, members["row_key"] == roots["node"], "left").select("bucket", "row_key", F.coalesce("root", "row_key").alias("root"))
        open_ = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
        centres = reliable_checkpoint(centres.join(open_, "bucket", "left_semi"))
        if centres.isEmpty():
            break
        middle = centres.join(named, ["bucket"]).where("centre = row_key").select("bucket", "centre", F.col("root").alias("its_root"))
        pairs = middle.join(named, "bucket").where("row_key > centre and root != its_root").select(F.col("centre").alias("a"), F.col("row_key").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = reliable_checkpoint(pairs)
        both = (pairs.join(sets.select(F.col("row_key").alias("a"), F.col("shingles").alias("x")), "a")
                .join(sets.select(F.col("row_key").alias("b"), F.col("shingles").alias("y")), "b"))
        common = F.size(F.array_intersect("x", "y"))
        alike = both.where(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")
        links = reliable_checkpoint(links.unionByName(alike))
        tried = reliable_checkpoint(tried.unionByName(pairs))
        roots = components(links)
        after = members.join(centres, "bucket").where("row_key > centre")
        centres = after.groupBy("bucket").agg(F.min("row_key").alias("centre"))
    classes = least.join(roots, least["row_key"] == roots["node"], "left").select("row_key", "least", F.coalesce("root", "row_key").alias("root"))
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("row_key", "class_id")
    return keyed.select("doc_id", "row_key").join(named, "row_key").select("doc_id", "class_id")


# ------------------------------------------------------------------ a text and its successor

def _edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as many first code points of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, place): each is compared with the next of its bucket; guests only end a bucket."""
    held = None
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
        for bucket, guest, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")), strict=True):
            text = text or ""
            if guest and (held is None or held[0] != bucket):
                continue  # the bucket's last row has its successor already
            print_ = digest(signature(shingles(text)))
            if held is not None and held[0] == bucket:
                _, before, its_text, its_print = held
                changed = _edited(its_text, text)
                own = digest(signature(shingles(changed)))
                for k, v in zip(out, (before, len(its_text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), its_print, own, likeness(its_print, own), likeness(its_print, print_)), strict=True):
                    out[k].append(v)
            held = None if guest else (bucket, doc, text, print_)
        types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


def _range(cuts: list[float]):
    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(np.array(cuts), ids.to_numpy(), side="right")))
    return number


def with_edited_and_next(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint, that of its edited text, and its likeness to the edited and to the next row's text.

    Rows are in order of doc_id (nulls first, equal ids by a hash of their text); the last is followed by the first.
    They are dealt into id ranges; each range gets a copy of the first row after it, so each text is shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # cut points: as many numbers as there are ranges
    cuts = sorted(set(docs.where("doc_id is not null").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts)))
    dealt = rows.withColumn("bucket", _range(cuts)(F.col("doc_id").cast("double")))
    heads = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("head")).orderBy("bucket").collect()
    # each range's first row ends the range before it; the first of all ends the last
    before = [(heads[i - 1]["bucket"], h["head"]["doc_id"], h["head"]["h"]) for i, h in enumerate(heads)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    guests = F.broadcast(spark.createDataFrame(before, f"bucket int, head_id {kind}, head_h long"))
    guest_rows = (rows.join(guests, F.col("doc_id").eqNullSafe(F.col("head_id")) & F.col("h").eqNullSafe(F.col("head_h")))
                  .select("bucket", F.lit(1).alias("guest"), "doc_id", "h", "text"))
    every = dealt.select("bucket", F.lit(0).alias("guest"), "doc_id", "h", "text").unionByName(guest_rows)
    ordered = every.repartition("bucket").sortWithinPartitions("bucket", "guest", "doc_id", "h")
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("bucket", "guest", "doc_id", "text").mapInArrow(_neighbours, schema)
