"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes.  Each byte becomes a learned vector; learned filters
slide over every position; positions are pooled by their maximum in chunks of
``CHUNK`` bytes that overlap by half and cover the whole document.  The mean and
the maximum over the chunks, with the logarithm of the length, go through one
hidden layer to one probability.

The network is fitted on the driver from at most ``TRAIN_ROWS`` labelled rows
and ``TRAIN_BYTES`` bytes of text, taken in the order of a hash of their id;
scoring reads every byte of every document, slice by slice, in the tasks.

Defined cases: null and empty texts score like a text of no bytes; equal texts
have equal scores; labels that are null count as missing; without any labels
of both classes every score is the share of label 1 (0.5 without labels); an
empty table gives an empty frame; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 128  # positions pooled together; a chunk is two neighbouring blocks
CHUNK = 2 * BLOCK
WIDTH = 6
EMBED = 8
FILTERS = 32
HIDDEN = 16
PAD = 256
TRAIN_ROWS = 4000
TRAIN_BYTES = 12_000_000
STEPS = 1200
BATCH = 32
#: Blocks convolved at once: bounds a task's memory whatever the length of a text.
SLICE = 64
THRESHOLD = 0.3


@dataclass
class Network:
    """Weights; ``prior`` is what an unfitted network answers."""

    prior: float = 0.5
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of byte numbers, each padded to whole blocks (with WIDTH - 1 pads at least), and each one's number of blocks."""
    blocks = np.array([max(1, -(-(len(t) + WIDTH - 1) // BLOCK)) for t in texts], np.int64)
    out = np.full(int(blocks.sum()) * BLOCK + WIDTH - 1, PAD, np.int16)
    at = 0
    for t, n in zip(texts, blocks.tolist(), strict=True):
        out[at:at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * BLOCK
    return out, blocks


def _windows(vectors: np.ndarray) -> np.ndarray:
    n = len(vectors) - WIDTH + 1
    view = np.lib.stride_tricks.as_strided(vectors, (n, WIDTH * EMBED), (vectors.strides[0], vectors.strides[1]))
    return np.ascontiguousarray(view)


def _pooled(codes: np.ndarray, blocks: np.ndarray, w: dict[str, np.ndarray], arg: bool = False):
    """Maximum of each filter in each block (before the bias and the ramp, which keep order), and its place if asked."""
    n = len(codes) // BLOCK
    last = np.zeros(n, bool)
    last[np.cumsum(blocks) - 1] = True
    best = np.empty((n, FILTERS), w["filter"].dtype)
    place = np.empty((n, FILTERS), np.int64) if arg else None
    for k in range(0, n, SLICE):
        m = min(SLICE, n - k)
        part = codes[k * BLOCK:(k + m) * BLOCK + WIDTH - 1]
        y = (_windows(w["embed"][part]) @ w["filter"]).reshape(m, BLOCK, FILTERS)
        y[last[k:k + m], BLOCK - WIDTH + 1:] = -np.inf  # windows that reach into the next text; only pads begin there
        if arg:
            at = y.argmax(1)
            best[k:k + m] = np.take_along_axis(y, at[:, None], 1)[:, 0]
            place[k:k + m] = at + (np.arange(k, k + m) * BLOCK)[:, None]
        else:
            y.max(1, out=best[k:k + m])
    return (best, place) if arg else best


def _combine(best: np.ndarray, blocks: np.ndarray, sizes: np.ndarray, w: dict[str, np.ndarray]):
    """Per document: hidden input (mean and maximum over chunks, length), and the chunks behind it."""
    ramp = np.maximum(best + w["bias"], 0)
    last = np.cumsum(blocks) - 1
    first = last - blocks + 1
    follower = np.arange(1, len(ramp) + 1)
    follower[last] = np.maximum(last - 1, first)  # the last chunk is the last two blocks; one block is a chunk alone
    chunks = np.maximum(ramp, ramp[follower])
    mean = np.add.reduceat(chunks, first, axis=0) / blocks[:, None]
    most = np.maximum.reduceat(chunks, first, axis=0)
    length = np.log1p(sizes)[:, None] / 10
    return np.concatenate([mean, most, length], 1).astype(best.dtype), ramp, chunks, follower, first, mean, most


def _head(x: np.ndarray, w: dict[str, np.ndarray]):
    hidden = np.maximum(x @ w["hidden"] + w["hidden_bias"], 0)
    return hidden, 1 / (1 + np.exp(-(hidden @ w["out"] + w["out_bias"])))


def predict(texts: list[bytes], net: Network) -> np.ndarray:
    """Probability of label 1 for each text, rounded to 6 digits so that a batch's make-up doesn't show."""
    if not net.weights:
        return np.full(len(texts), net.prior)
    # matrix products of other shapes round differently: doubles keep that far below the last digit given
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    codes, blocks = _padded(texts)
    x = _combine(_pooled(codes, blocks, w), blocks, np.array([len(t) for t in texts], np.float64), w)[0]
    return _head(x, w)[1].round(6)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """A network fitted by Adam on the log loss."""
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Network(float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    w = {
        "embed": rng.normal(0, 0.5, (PAD + 1, EMBED)), "filter": rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)),
        "bias": np.zeros(FILTERS), "hidden": rng.normal(0, (2 / (2 * FILTERS + 1)) ** 0.5, (2 * FILTERS + 1, HIDDEN)), "hidden_bias": np.zeros(HIDDEN),
        "out": rng.normal(0, HIDDEN**-0.5, HIDDEN), "out_bias": np.zeros(1),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    w["embed"][PAD] = 0
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    while step < STEPS:
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            pick = order[k:k + BATCH]
            grads = _gradients([texts[i] for i in pick], labels[pick], w)
            step += 1
            rate = 4e-3 * min(1, step / 20) * max(0.1, 1 - 0.9 * step / STEPS)
            for name, g in grads.items():
                m1[name] += 0.1 * (g - m1[name])
                m2[name] += 0.01 * (g * g - m2[name])
                w[name] -= rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-7)
            w["embed"][PAD] = 0
    return Network(float(labels.mean()), w)


def _gradients(texts: list[bytes], labels: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    codes, blocks = _padded(texts)
    best, place = _pooled(codes, blocks, w, arg=True)
    x, ramp, chunks, follower, first, _, most = _combine(best, blocks, np.array([len(t) for t in texts], np.float64), w)
    hidden, p = _head(x, w)
    d = ((p - labels) / len(labels)).astype(np.float32)
    out = {"out": hidden.T @ d, "out_bias": d.sum(keepdims=True)}
    dh = np.outer(d, w["out"]) * (hidden > 0)
    out |= {"hidden": x.T @ dh, "hidden_bias": dh.sum(0)}
    dx = dh @ w["hidden"].T
    doc = np.repeat(np.arange(len(blocks)), blocks)
    dchunk = dx[:, :FILTERS][doc] / blocks[doc][:, None]
    dmost = dx[:, FILTERS:2 * FILTERS]
    tied = chunks == most[doc]
    dchunk = dchunk + tied * dmost[doc] / np.maximum(np.add.reduceat(tied, first, axis=0, dtype=np.float32), 1)[doc]
    here = ramp >= ramp[follower]
    dramp = dchunk * here
    there = dchunk * ~here
    last = np.cumsum(blocks) - 1
    inner = np.ones(len(ramp), bool)
    inner[last] = False
    for rows in (np.flatnonzero(inner), last):  # followers don't repeat within either
        dramp[follower[rows]] += there[rows]
    dbest = (dramp * (ramp > 0)).astype(np.float32)
    out["bias"] = dbest.sum(0)
    cols, rows = np.nonzero(dbest.T)  # filter by filter
    g, at = dbest[rows, cols], place[rows, cols]
    near = codes[at[:, None] + np.arange(WIDTH)]  # bytes under each maximum
    cuts = np.searchsorted(cols, np.arange(1, FILTERS))
    seen = np.split(w["embed"][near].reshape(len(g), -1), cuts)
    out["filter"] = np.stack([x.T @ y for x, y in zip(seen, np.split(g, cuts), strict=True)], 1)
    back = (w["filter"].T[cols] * g[:, None]).reshape(-1, EMBED)
    out["embed"] = np.stack([np.bincount(near.ravel(), back[:, k], PAD + 1) for k in range(EMBED)], 1)
    return {k: v.astype(np.float32) for k, v in out.items()}


# ------------------------------------------------------------------ Spark

def held_out(doc_id="doc_id"):
    """Rows kept from learning: crc32 of the id as text leaves 0 modulo 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Network:
    """A network from labelled rows that aren't held out; the sample is bounded by ``TRAIN_ROWS`` and ``TRAIN_BYTES``."""
    marked = labels.where(F.col(target).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(target).alias("y"))
    sized = docs.select("doc_id", F.octet_length("text").alias("bytes")).where("bytes > 0").join(marked, "doc_id")
    sample = sized.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).collect()
    used, ids = 0, {}
    for r in sample:
        if used + r["bytes"] <= TRAIN_BYTES:
            used += r["bytes"]
            ids[r["doc_id"]] = int(r["y"] > 0)
    if not ids:
        return Network()
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in ids], docs.select("doc_id").schema))  # TRAIN_ROWS rows at most
    rows = docs.where("octet_length(text) > 0").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return train([r["text"].encode("utf-8", "surrogatepass") for r in rows], np.array([ids[r["doc_id"]] for r in rows]))


def _scorer(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[float] = []
            group, size = [], 0
            for t in batch.column("text"):
                group.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(group[-1])
                if size > 1 << 20:
                    scores += predict(group, net).tolist()
                    group, size = [], 0
            if group:
                scores += predict(group, net).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])
    return run


def score(docs: DataFrame, net: Network, *keep: str) -> DataFrame:
    """The named columns of ``docs`` and score (double), for every row."""
    names = list(dict.fromkeys(["text", *keep]))
    schema = docs.select(*names).schema.add("score", "double")
    return docs.select(*names).mapInArrow(_scorer(net), schema).select(*keep, "score")


def predicted(threshold: float = THRESHOLD):
    return F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int")


def accepted(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return score(rows, net, "row").where(F.col("score") >= threshold).select("row.*")
