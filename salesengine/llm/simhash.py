"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are the leaves of a binary trie.  Node pairs are traversed
together from the root: a pair's children are the pairs of their children, a
pair adds a differing bit where its children take different sides, and a pair
over the error budget is pruned with all that lies below.

Two traversals find every link.  A pair within 4 of 64 bits has at most 2
differing bits in one half, so the first traversal allows 2 in the first 32
bits (4 in all) and the second does the same with the halves swapped.  That
keeps the number of node pairs small in the dense upper levels.

The top levels of the trie are dealt out by Spark: fingerprints are cut into
blocks by their first bits (hot prefixes into several blocks), each block meets
the blocks whose prefix is within the budget, and each block pair is traversed
in one task of bounded memory.  A block pair gives a spanning forest of its
links, not the links: equal and near texts in any number never become all pairs.

Defined cases: a null text has no words, and texts without words have
fingerprint zero and link like any other; rows with equal texts or equal ids
keep their rows; a null id is nobody's least id unless all of a component are
null; an empty table gives an empty frame; other columns are ignored (kept by
``distinct_documents``), whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.llm.graph import components
from salesengine.session import reliable_checkpoint

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
#: Fingerprints a block holds at most, on average; two blocks are traversed in one task.
BLOCK = 8192
#: The counts by prefix go to every task: 2 ** MAX_PREFIX rows at most.
MAX_PREFIX = 14


# ------------------------------------------------------------------ fingerprints

def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of the whole text: bit set if set in over half the shingles' XXH64 (seed 42), repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    ends = ends[-n:].tolist()
    h64 = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        h = np.array([h64(joined[s:e], 42) for s, e in zip(starts[k:k + (1 << 16)], ends[k:k + (1 << 16)], strict=True)], ">u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64 if len(h) > 255 else np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(fps)], names=["doc_id", "row_key", "fp"])
    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, row_key, fp): row_key is a hash of the text, fp holds the 64 bits as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text").mapInArrow(_fingerprints(width), f"doc_id {kind}, row_key long, fp long")


# ------------------------------------------------------------------ one block pair

def _ones(keys: np.ndarray, depth: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)))


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i and j in ``label`` (each entry points at the least index of its component)."""
    while len(i):
        a, b = label[i], label[j]
        keep = a != b
        i, j, a, b = i[keep], j[keep], a[keep], b[keep]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def trie_links(a: np.ndarray, b: np.ndarray | None, distance: int, half: int, step: int = 1 << 17) -> list[tuple[int, int]]:
    """A spanning forest of the links between two sets of distinct keys (b None: within a), as pairs of keys.

    A pair links within ``distance`` bits if at most ``half`` of them are among the first 32.
    """
    a = np.sort(a)
    own = b is None
    b = a if own else np.sort(b)
    every = a if own else np.concatenate((a, b))
    shift = 0 if own else len(a)
    label = np.arange(len(every))
    ones_a = [_ones(a, d) for d in range(64)]
    ones_b = ones_a if own else [_ones(b, d) for d in range(64)]
    # node pairs: ranges [alo, ahi) and [blo, bhi) of sorted keys, and the bits that differ so far
    stack = [(0, *(np.array([x], np.int64) for x in (0, len(a), 0, len(b), 0)))] if len(a) and len(b) else []
    while stack:
        depth, alo, ahi, blo, bhi, off = stack.pop()
        if len(alo) > step:
            stack += [(depth, *(x[k:k + step] for x in (alo, ahi, blo, bhi, off))) for k in range(0, len(alo), step)]
            continue
        # few leaves below: compare them directly
        pairs = (ahi - alo) * (bhi - blo)
        few = pairs <= 16
        if few.any():
            n, lo_a, lo_b, nb = pairs[few], alo[few], blo[few], (bhi - blo)[few]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.repeat(lo_a, n) + k // np.repeat(nb, n), np.repeat(lo_b, n) + k % np.repeat(nb, n)
            x = a[i] ^ b[j]
            ok = (np.bitwise_count(x) <= distance) & (np.bitwise_count(x >> np.uint64(32)) <= half)
            if own:
                ok &= i < j
            _hook(label, i[ok], j[ok] + shift)
            alo, ahi, blo, bhi, off = (v[~few] for v in (alo, ahi, blo, bhi, off))
        if not len(alo):
            continue
        oa, ob = ones_a[depth], ones_b[depth]
        am, bm = ahi - (oa[ahi] - oa[alo]), bhi - (ob[bhi] - ob[blo])
        most = half if depth < 32 else distance
        parts = [(alo, am, blo, bm, off), (am, ahi, bm, bhi, off)]
        near = off < most
        twin = own & (alo == blo) & (ahi == bhi)
        for p, keep in (((alo, am, bm, bhi, off + 1), near), ((am, ahi, blo, bm, off + 1), near & ~twin)):
            parts.append(tuple(v[keep] for v in p))
        nxt = [np.concatenate(v) for v in zip(*parts, strict=True)]
        full = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3])
        if full.any():
            stack.append((depth + 1, *(v[full] for v in nxt)))
    members = np.flatnonzero(label != np.arange(len(label)))
    return list(zip(every[members].tolist(), every[label[members]].tolist(), strict=True))


def _traverse(distance: int, half: int, turn: int):
    back = np.uint64((64 - turn) % 64)

    def keys(values) -> np.ndarray:
        return np.asarray(values.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)

    def unturned(xs: list[int]) -> np.ndarray:
        x = np.array(xs, np.uint64)
        return ((x << back) | (x >> np.uint64(turn)) if turn else x).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ka, kb in zip(batch.column("ka"), batch.column("kb"), strict=True):
                out += trie_links(keys(ka), keys(kb) if kb.is_valid else None, distance, half)
            if out:
                x, y = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(unturned(list(x))), pa.array(unturned(list(y)))], names=["a", "b"])
    return run


# ------------------------------------------------------------------ all block pairs

def _half_links(fps: DataFrame, count: int, distance: int, turn: int) -> DataFrame:
    """Links of distinct fingerprints (column fp) with at most distance // 2 differing bits among the 32 that come first after the turn."""
    half = distance // 2
    bits = min(MAX_PREFIX, max(0, math.ceil(math.log2(max(1, count) / BLOCK))))
    key = F.expr(f"shiftleft(fp, {turn}) | shiftrightunsigned(fp, {64 - turn})") if turn else F.col("fp")
    keyed = fps.select(key.alias("key")).withColumn("g", F.expr(f"cast(shiftrightunsigned(key, {64 - bits}) as int)") if bits else F.lit(0))
    # 2 ** MAX_PREFIX rows at most, whatever the input
    cuts = keyed.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts"))
    cuts = reliable_checkpoint(cuts)
    blocks = (keyed.join(F.broadcast(cuts), "g")
              .withColumn("s", F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int"))
              .groupBy("g", "s").agg(F.collect_list("key").alias("keys"), F.first("cuts").alias("cuts")))
    blocks = reliable_checkpoint(blocks)
    masks = [sum(1 << b for b in c) for r in range(half + 1) for c in combinations(range(bits), r)]
    other = F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("g").bitwiseXOR(m))
    # each block meets the blocks of near prefixes from itself on, by an equality join
    left = (blocks.select("g", "s", "keys", F.explode(other).alias("h")).where("h >= g")
            .join(F.broadcast(cuts.select(F.col("g").alias("h"), F.col("cuts").alias("n"))), "h")
            .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("h > g or t >= s"))
    right = blocks.select(F.col("g").alias("h"), F.col("s").alias("t"), F.col("keys").alias("kb"))
    pairs = left.join(right, ["h", "t"]).select(F.col("keys").alias("ka"), F.when(F.expr("g = h and s = t"), F.lit(None)).otherwise(F.col("kb")).alias("kb"))
    return pairs.repartition(F.xxhash64("ka", "kb")).mapInArrow(_traverse(distance, half, turn), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, row_key, fp, root, component_id) for every row: root is a fingerprint of the component, component_id the least doc_id reachable over links of at most ``distance`` bits."""
    prints = reliable_checkpoint(fingerprints(docs, width))
    classes = reliable_checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    count = classes.count()
    links = _half_links(classes, count, distance, 0).unionByName(_half_links(classes, count, distance, 32))
    root = components(links)
    joined = classes.join(root, classes["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # only classes that have links take part in the second aggregate
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = joined.join(least, "root").select("fp", "root", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "row_key", "fp", "root", "component_id")


def distinct_documents(docs: DataFrame, distance: int = MAX_DISTANCE, width: int = SHINGLE_WORDS) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns: the one of least doc_id (of equal ids, of least text hash)."""
    heads = (near_duplicates(docs, distance, width).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .groupBy("root").agg(F.min(F.struct("row_key", "component_id")).alias("head")).select(F.col("head.row_key").alias("key"), "head.component_id"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("row_key"))
    kept = rows.join(heads, F.col("row_key").eqNullSafe(F.col("key")) & F.col("id").eqNullSafe(F.col("component_id")), "left_semi")
    return kept.dropDuplicates(["row_key", "id"]).select("row.*")
