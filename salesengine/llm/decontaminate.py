"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document if at least ``threshold`` of the item's
distinct five-word shingles occur in the document.  Jaccard likeness says
nothing here, as documents may be a thousand times longer than items, so
containment is searched with bottom-k MinHash sketches cut to measure:

* Shingles are hashed once; an item's sketch is its k least hashes.  An item
  of n shingles that is contained misses at most n - ceil(threshold n) of
  them, so with k = n - ceil(threshold n) + 1 at least one sketch hash is in
  the document: the search loses nothing.
* Items are partitioned by size (powers of two).  Each partition has its
  largest sketch hash and its least required size; a document looks only at its
  hashes up to the largest sketch hash of the partitions that fit into it.
* An item of fewer than five words is one shingle of all its words.  Only where
  a benchmark has such items do documents give shingles of their widths, too.
* Candidates are verified by exact containment of their shingle texts.

All steps are DataFrame functions.  Item sketches are broadcast in blocks of at
most ``SKETCH_BLOCK`` rows; a larger benchmark takes one pass over the
documents for each block.

Words are the maximal runs of letters and digits, in lower case.

Defined cases: null and empty texts have no words and match nothing; repeated items and repeated rows each
count by themselves, equal result rows come once; an empty table on either side
gives an empty frame; other columns are ignored by ``contained_items`` and kept
by ``clean``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesengine.session import reliable_checkpoint

SHINGLE_WORDS = 5
THRESHOLD = 0.8
SKETCH_BLOCK = 400_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def _starts(array: str, width: int) -> Column:
    """0 .. size - width, none for a shorter array."""
    n = F.size(array)
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.expr("cast(array() as array<int>)"))


def shingle_hashes(word_hashes: str, width: int = SHINGLE_WORDS) -> Column:
    """64-bit hash of each shingle, from a column that has each word's hash."""
    return F.transform(_starts(word_hashes, width), lambda i: F.xxhash64(*(_at(word_hashes, i + k) for k in range(width))))


def shingle_texts(words_column: str, width: int = SHINGLE_WORDS) -> Column:
    return F.array_distinct(F.transform(_starts(words_column, width), lambda i: F.concat_ws(" ", *(_at(words_column, i + k) for k in range(width)))))


def _hashed(df: DataFrame, *keep: Column) -> DataFrame:
    return df.select(*keep, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("wh"))


def _whole(word_hashes: str) -> Column:
    """The hash of a text of one to four words as one shingle, as ``shingle_hashes`` of its width has it."""
    out = F.lit(None).cast("long")
    for width in range(1, SHINGLE_WORDS):
        out = F.when(F.size(word_hashes) == width, F.xxhash64(*(_at(word_hashes, F.lit(k)) for k in range(width)))).otherwise(out)
    return out


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, n, need, size_class, width, sketch): the bottom-k sketch of every item that has a word; size class -1: items of one short shingle."""
    s = _hashed(items, F.col("item_id")).where(F.size("wh") > 0)
    short = F.size("wh") < SHINGLE_WORDS
    h = F.when(short, F.array(_whole("wh"))).otherwise(F.array_distinct(shingle_hashes("wh")))
    s = s.select("item_id", F.least(F.size("wh"), F.lit(SHINGLE_WORDS)).alias("width"), h.alias("h"))
    # a hair below, so that a product like 0.8 * 5 in floating point doesn't ask for one more
    s = s.withColumn("n", F.size("h")).withColumn("need", F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int"))
    sketch = F.slice(F.array_sort("h"), F.lit(1), F.col("n") - F.col("need") + 1)
    size_class = F.when(F.col("width") < SHINGLE_WORDS, -1).otherwise(F.floor(F.log2("n")).cast("int"))
    return s.select("item_id", "n", "need", size_class.alias("size_class"), "width", sketch.alias("sketch"))


def candidates(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame | None:
    """(doc_id, row_key, item_id) with a shared sketch hash; None if no item has a shingle."""
    made = reliable_checkpoint(sketches(items, threshold))
    # one row a power of two of sizes, and one for each of four short widths
    classes = (made.groupBy("size_class", "width").agg(F.min("need").alias("need"), F.max(F.array_max("sketch")).alias("top"), F.sum(F.size("sketch")).alias("n"))
               .orderBy("size_class", "width").collect())
    if not classes:
        return None
    row_key = F.xxhash64("text")
    hashed = _hashed(docs, F.col("doc_id"), row_key.alias("row_key"))
    top = F.lit(None).cast("long")
    fits, size = [], F.size("wh") - (SHINGLE_WORDS - 1)
    for c in sorted((c for c in classes if c["size_class"] >= 0), key=lambda c: c["need"]):
        fits.append((c["need"], max([c["top"], *(t for _, t in fits)])))
    for need, most in fits:  # the last that holds wins
        top = F.when(size >= need, F.lit(most)).otherwise(top)
    parts = None
    if fits:
        small = F.filter(shingle_hashes("wh"), lambda h: h <= F.col("top"))
        parts = hashed.withColumn("size", size).withColumn("top", top).where("top is not null").select("doc_id", "row_key", "size", F.explode(small).alias("h"))
    for c in classes:
        if c["size_class"] < 0:
            short = hashed.select("doc_id", "row_key", F.lit(1).alias("size"), F.explode(F.array_distinct(shingle_hashes("wh", c["width"]))).alias("h"))
            short = short.where(F.col("h") <= c["top"])
            parts = short if parts is None else parts.unionByName(short)
    table = made.select("item_id", "need", F.explode("sketch").alias("h"))
    blocks = math.ceil(sum(c["n"] for c in classes) / SKETCH_BLOCK)
    found = None
    for b in range(blocks):
        block = table.where(F.pmod(F.xxhash64("item_id", "h"), F.lit(blocks)) == b) if blocks > 1 else table
        hits = parts.join(F.broadcast(block), "h").where("size >= need").select("doc_id", "row_key", "item_id")
        found = hits if found is None else found.unionByName(hits)
    return reliable_checkpoint(found.distinct())


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row_key, item_id, n_shared, n_item, containment) of every item contained in a document.

    ``docs`` has doc_id and text, ``items`` item_id and text.  row_key is a hash of the document's text, which tells rows of one id apart.
    """
    pairs = candidates(docs, items, threshold)
    if pairs is None:
        none = docs.select("doc_id", F.xxhash64("text").alias("row_key")).limit(0)
        ids = items.select("item_id").limit(0)
        return none.join(ids, F.lit(True)).select("doc_id", "row_key", "item_id", F.lit(0).alias("n_shared"), F.lit(0).alias("n_item"), F.lit(0.0).alias("containment"))
    item_words = items.select("item_id", words(F.col("text")).alias("w"))
    whole = F.array(F.array_join("w", " "))
    item_texts = item_words.select("item_id", F.when(F.size("w").between(1, SHINGLE_WORDS - 1), whole).otherwise(shingle_texts("w")).alias("item_shingles"))
    short = item_words.where(F.size("w").between(1, SHINGLE_WORDS - 1)).select(F.size("w").alias("width")).distinct()
    widths = [SHINGLE_WORDS, *(r["width"] for r in short.orderBy("width").collect())]  # five at most
    keyed = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    hit = pairs.select("doc_id", "row_key").distinct()
    mine = (keyed.alias("d").join(hit.alias("h"), F.col("d.row_key").eqNullSafe(F.col("h.row_key")) & F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")))
            .select("d.doc_id", "d.row_key", words(F.col("d.text")).alias("w"))
            .select("doc_id", "row_key", F.concat(*(shingle_texts("w", width) for width in widths)).alias("doc_shingles")))
    wanted = pairs.alias("p").join(item_texts.alias("i"), F.col("p.item_id").eqNullSafe(F.col("i.item_id"))).select("p.*", "i.item_shingles")
    shared = F.size(F.array_intersect("w.item_shingles", "m.doc_shingles"))
    out = (mine.alias("m").join(wanted.alias("w"), F.col("m.row_key").eqNullSafe(F.col("w.row_key")) & F.col("m.doc_id").eqNullSafe(F.col("w.doc_id")))
           .select("m.doc_id", "m.row_key", "w.item_id", shared.alias("n_shared"), F.size("w.item_shingles").alias("n_item"))
           .where(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - 1e-9).where("n_item > 0"))
    return out.select("*", F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment")).distinct()


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no item."""
    bad = contained_items(docs, items, threshold).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(bad["_key"]), "left_anti")
