"""Toxicity by class-conditional Kneser-Ney models of toxic and ordinary text.

A word is a maximal run of ASCII letters and non-ASCII bytes of the lower-cased
text.  For each class c there is an interpolated Kneser-Ney bigram model:

* ``P_c(w | h) = max(n_c(h, w) - D_c, 0) / n_c(h) + back_c(h) P_c(w)`` with
  plain counts of word pairs;
* ``P_c(w) = max(k_c(w) - D_c, 0) / k_c + back * P(w)``, where k_c(w) is the number
  of different words that w follows in class c, so that copies count once;
* ``P(w)``, shared by both classes: as before, from the pairs of both classes
  together, with a discount of 0.75 whose mass goes evenly to all words.

The toxic discount is one of ``DISCOUNTS``; the ordinary one is set so that both
classes give the same mass back to P(w).  So an expression that is rare in
both classes, or unseen, is as likely in one as in the other, and only those
whose count exceeds a discount are entries of the model: few of the counted
ones, and more with more input.  The head, a logistic regression, reads the log-likelihood
ratio per word of the bigram model and of P_c(w) over the whole text, and of
P_c(w) over the most toxic ``SPANS`` consecutive words, as one insult in a long
text changes its average little.

Labelled rows are split by the checksum of their id modulo 5: 0 is never read, 1
to 3 are counted (all of them, in Spark), and 4 fit the head and choose the
discount (about ``HEAD_ROWS`` rows, by a hash; only their features reach the
driver).  The model is
broadcast where it has at most ``BROADCAST_ENTRIES`` entries; a larger one is
joined: blocks of documents ask for their words' entries and get those alone.
Labels are broadcast up to ``BROADCAST_LABELS`` rows, else joined.

Defined cases: null and empty texts have no words, so all their features are 0; equal
texts have equal scores; null labels count as missing; without labels of both
classes every score is the share of label 1 (0 without labels); an empty table
gives an empty frame; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from salesengine.llm.hashing import mix, word_hashes
from salesengine.session import reliable_checkpoint

DISCOUNTS = (2.0, 4.0, 8.0, 12.0)
SHARED_DISCOUNT = 0.75
SPANS = (16, 1)
HEAD_ROWS = 5000
BROADCAST_ENTRIES = 1 << 22
BROADCAST_LABELS = 1 << 22
BLOCK_CHARS = 8_000_000
THRESHOLD = 0.5
#: Candidates of the ordinary class's discount: its sum is exact at each and read off between them.
_GRID = [0.0, *(0.25 * 2 ** (k / 2) for k in range(48))]
#: Texts are hashed and looked up so many bytes at a time.
_SLICE = 1 << 20
_FLUSH = 1 << 21
#: Log ratios are summed as whole numbers of this size, so sums don't depend on what stands beside a text.
_UNIT = 2.0**-30
_START = np.uint64(1)
_PAIR = np.uint64(0x9E3779B97F4A7C15)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# ------------------------------------------------------------------ words

def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of lower-cased texts, and the number of words of each text."""
    data = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(buf) + 1, bool)
    inside[1:] = _LETTER[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    stops = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, stops), prepend=0)
    return word_hashes(buf, starts, ends, 11)[0], counts


def _before(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """40 bits of the word before each word of its text, ``_START`` before the first; there are fewer words than that tells apart."""
    out = np.empty_like(words)
    out[1:] = words[:-1] >> np.uint64(24)
    firsts = np.cumsum(counts) - counts
    out[firsts[counts > 0]] = _START
    return out


def _pairs(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + words)


def _slices(texts: Iterator[str | None]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        group.append((t or "").lower().encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size > _SLICE:
            yield group
            group, size = [], 0
    if group:
        yield group


# ------------------------------------------------------------------ counts

def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word pairs of labelled texts, summed as far as memory is kept small."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flushed() -> pa.RecordBatch:
        before, words, toxic = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((before, words))
        before, words, toxic = before[order], words[order], toxic[order]
        first = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (words[1:] != words[:-1])]))
        n = np.diff(np.append(first, len(words)))
        bad = np.add.reduceat(toxic, first)
        columns = (before[first].view(np.int64), words[first].view(np.int64), bad.astype(np.int64), (n - bad).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["before", "word", "toxic", "ordinary"])

    for batch in batches:
        texts, labels = batch.column("text").to_pylist(), batch.column("label").to_pylist()
        at = 0
        for group in _slices(iter(texts)):
            words, counts = _words(group)
            held.append((_before(words, counts), words, np.repeat(np.array(labels[at:at + len(group)], np.int64), counts)))
            at += len(group)
            size += len(words)
            if size > _FLUSH:
                yield flushed()
                held, size = [], 0
    if size:
        yield flushed()


def fold(doc_id: str = "doc_id") -> Column:
    """The checksum of the id as text, modulo 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def labelled(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> DataFrame:
    """doc_id, text, label of the rows that may be learnt from."""
    marked = labels.where(F.col(target).isNotNull() & (fold() != 0)).groupBy("doc_id").agg((F.max(target) > 0).cast("long").alias("label"))
    marked = reliable_checkpoint(marked)
    if marked.count() <= BROADCAST_LABELS:  # 16 bytes a row
        marked = F.broadcast(marked)
    return docs.select("doc_id", "text").join(marked, "doc_id")


@dataclass
class Model:
    """``entries``: key, kind (0 word, 1 pair, 2 word before) and value, a row each; ``head``: weights on the features; ``prior`` where nothing could be learnt."""

    prior: float = 0.0
    entries: DataFrame | None = None
    size: int = 0
    discount: float = 0.0
    head: np.ndarray = field(default_factory=lambda: np.zeros(3 + len(SPANS)))


def _given_back(sums: dict, column: str, discount: float) -> float:
    """Share of a class's counts that the discount takes, from sums at the points of ``_GRID``."""
    return float(np.interp(discount, _GRID, [sums[f"{column}{k}"] for k in range(len(_GRID))])) / max(sums[column], 1)


def _discount_for(sums: dict, column: str, share: float) -> float:
    points = np.array([sums[f"{column}{k}"] for k in range(len(_GRID))], float) / max(sums[column], 1)
    keep = np.concatenate([[True], np.diff(points) > 0])
    return float(np.interp(share, points[keep], np.array(_GRID)[keep]))


def _discount_sums(counts: DataFrame) -> dict:
    """For either class the sum of its counts, and of what each point of the grid would take; one row."""
    exprs = [F.sum(c).alias(c) for c in ("toxic", "ordinary")]
    exprs += [F.sum(F.least(F.col(c), F.lit(d))).alias(f"{c}{k}") for c in ("toxic", "ordinary") for k, d in enumerate(_GRID)]
    return {k: v or 0 for k, v in counts.agg(*exprs).first().asDict().items()}


@dataclass
class Counts:
    """What all discounts share: sums over words and pairs, and the pairs and words before them that the least discount leaves."""

    words: DataFrame
    sums: dict
    pair_sums: dict
    total: int
    kinds: int
    beyond: DataFrame
    around: DataFrame

    def cuts(self, sums: dict, discount: float) -> dict[str, float]:
        return {"toxic": discount, "ordinary": _discount_for(sums, "ordinary", _given_back(sums, "toxic", discount))}


def _kept(c: str, cuts: dict[str, float]) -> Column:
    return F.greatest(F.col(c) - F.lit(cuts[c]), F.lit(0.0))


def _any_kept(cuts: dict[str, float]) -> Column:
    return (F.col("toxic") > cuts["toxic"]) | (F.col("ordinary") > cuts["ordinary"])


def _counts(pairs: DataFrame) -> Counts:
    one = F.lit(1)
    words = reliable_checkpoint(pairs.groupBy("word").agg(
        F.sum(F.least("toxic", one)).alias("toxic"), F.sum(F.least("ordinary", one)).alias("ordinary"), F.count("*").alias("shared")))
    total, kinds = words.agg(F.sum("shared"), F.count("*")).first()
    out = Counts(words, _discount_sums(words), _discount_sums(pairs), total or 0, kinds, pairs, pairs)
    out.beyond = reliable_checkpoint(pairs.where(_any_kept(out.cuts(out.pair_sums, min(DISCOUNTS)))))
    out.around = reliable_checkpoint(pairs.join(out.beyond.select("before").distinct(), "before", "left_semi").groupBy("before").agg(
        F.sum("toxic").alias("h_toxic"), F.sum("ordinary").alias("h_ordinary")))
    return out


def _entries(counts: Counts, discount: float) -> DataFrame:
    """key, kind, value: log ratios of everything whose count exceeds the discount of its class."""
    cuts, pair_cuts = counts.cuts(counts.sums, discount), counts.cuts(counts.pair_sums, discount)
    share = _given_back(counts.sums, "toxic", discount)
    shared = (F.col("shared") - SHARED_DISCOUNT) / counts.total + SHARED_DISCOUNT * counts.kinds / counts.total / (counts.kinds + 1)
    classes = ("toxic", "ordinary")
    likely = [(_kept(c, cuts) / F.lit(float(counts.sums[c])) + share * shared).alias(f"p_{c}") for c in classes]
    single = counts.words.where(_any_kept(cuts)).select(F.col("word").alias("key"), F.lit(0).alias("kind"), F.log(likely[0] / likely[1]).alias("value"))

    beyond = counts.beyond.where(_any_kept(pair_cuts)).select("before", "word", *(_kept(c, pair_cuts).alias(f"k_{c}") for c in classes))
    used = beyond.groupBy("before").agg(*(F.sum(f"k_{c}").alias(f"u_{c}") for c in classes))
    # a discount takes something from every pair, so no back-off is 0
    back = [F.when(F.col(f"h_{c}") > 0, 1 - F.col(f"u_{c}") / F.col(f"h_{c}")).otherwise(1.0).alias(f"back_{c}") for c in classes]
    around = counts.around.join(used, "before").select("before", *(f"h_{c}" for c in classes), *back)
    context = around.select(F.col("before").alias("key"), F.lit(2).alias("kind"), F.log(F.col("back_toxic") / F.col("back_ordinary")).alias("value"))
    told = [F.col(f"k_{c}") / F.greatest(F.col(f"h_{c}"), F.lit(1)) + F.col(f"back_{c}") * F.col(f"p_{c}") for c in classes]
    double = beyond.join(around, "before").join(counts.words.select("word", *likely), "word").select("before", "word", F.log(told[0] / told[1]).alias("value"))
    return single.unionByName(context).unionByName(double.mapInArrow(_keyed, "key long, kind int, value double"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before, word = (batch.column(c).to_numpy().view(np.uint64) for c in ("before", "word"))
        key = _pairs(before, word).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.ones(len(key), np.int32)), batch.column("value")], names=["key", "kind", "value"])


# ------------------------------------------------------------------ features

@dataclass
class Table:
    """Sorted keys and values of each kind."""

    keys: list[np.ndarray]
    values: list[np.ndarray]

    @classmethod
    def of(cls, key: np.ndarray, kind: np.ndarray, value: np.ndarray) -> Table:
        keys, values = [], []
        for k in range(3):
            part = kind == k
            mine = key[part].view(np.uint64)
            order = np.argsort(mine)
            keys.append(mine[order])
            values.append(np.rint(value[part][order] / _UNIT).astype(np.int64))
        return cls(keys, values)

    def find(self, kind: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, known) of each wanted key."""
        keys = self.keys[kind]
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        known = keys[at] == wanted
        return np.where(known, self.values[kind][at], 0), known


def features(texts: list[bytes], table: Table) -> np.ndarray:
    """Per text: log-likelihood ratio a word by pairs, by words, and by words in the most toxic span of each length."""
    words, counts = _words(texts)
    before = _before(words, counts)
    single, _ = table.find(0, words)
    double, known = table.find(1, _pairs(before, words))
    both = np.where(known, double, table.find(2, before)[0] + single)
    some = np.flatnonzero(counts)
    out = np.zeros((len(texts), 2 + len(SPANS)))
    if len(some):
        lengths = counts[some]
        firsts = (np.cumsum(counts) - counts)[some]
        out[some, 0] = np.add.reduceat(both, firsts) / lengths
        out[some, 1] = np.add.reduceat(single, firsts) / lengths
        total = np.concatenate([[0], np.cumsum(single)])
        ends = np.repeat(firsts + lengths, lengths)
        at = np.arange(len(words))
        for k, span in enumerate(SPANS, 2):  # words beyond a text's end add nothing
            out[some, k] = np.maximum.reduceat(total[np.minimum(at + span, ends)] - total[:-1], firsts) / span
    return out * _UNIT


def _probability(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Rounded to 6 digits, so that a batch's make-up doesn't show."""
    z = x @ head[:-1] + head[-1]
    return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).round(6)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and intercept by Newton's method, with a small ridge on standardised features."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        grad = z.T @ (p - y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    out = w.copy()
    out[:-1] /= scale
    out[-1] -= (w[:-1] * mean / scale).sum()
    return out


def _loss(x: np.ndarray, y: np.ndarray, head: np.ndarray) -> float:
    p = np.clip(_probability(x, head), 1e-6, 1 - 1e-6)
    return -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


# ------------------------------------------------------------------ fit

def _scored(docs: DataFrame, entries: DataFrame, size: int, names: list[str]) -> DataFrame:
    """The named columns and ``features`` of every row of ``docs`` (with ``text``)."""
    docs = docs.select(*dict.fromkeys(["text", *names]))
    schema = StructType([*docs.select(*names).schema.fields, StructField("features", ArrayType(DoubleType()))])
    if size <= BROADCAST_ENTRIES:
        rows = entries.toArrow()
        table = Table.of(*(rows.column(c).to_numpy() for c in ("key", "kind", "value")))
        shared = docs.sparkSession.sparkContext.broadcast((table.keys, table.values))
        return docs.mapInArrow(_mapper(shared, names), schema)
    # blocks of documents ask for the entries of their words; a block's answer is no longer than its text
    rows = docs.groupBy(*docs.columns).agg(F.count("*").alias("copies"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in docs.columns)), F.lit(-(-chars // BLOCK_CHARS) + 1)).alias("block")
    dealt = reliable_checkpoint(rows.select(block, "*"))
    asked = dealt.select("block", "text").mapInArrow(_asker, "block long, key long").distinct()
    answers = asked.join(entries, "key")
    names = [*names, "copies"]
    schema = StructType([*dealt.select(*names).schema.fields, StructField("features", ArrayType(DoubleType()))])
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answered(names), schema)
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def _featured(columns: list[pa.Array], texts: list[str | None], table: Table, names: list[str]) -> pa.RecordBatch:
    parts = [features(group, table) for group in _slices(iter(texts))]
    flat = np.concatenate(parts) if parts else np.zeros((0, 2 + len(SPANS)))
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))], names=[*names, "features"])


def _mapper(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            yield _featured([batch.column(c) for c in names], batch.column("text").to_pylist(), table, names)
    return run


def _asker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = np.asarray(batch.column("block").to_pylist(), np.int64)
        for b in np.unique(blocks):
            texts = [t for t, x in zip(batch.column("text").to_pylist(), blocks, strict=True) if x == b]
            for group in _slices(iter(texts)):
                words, counts = _words(group)
                before = _before(words, counts)
                keys = np.unique(np.concatenate([words, before, _pairs(before, words)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), b)), pa.array(keys.view(np.int64))], names=["block", "key"])


def _answered(names: list[str]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        table = Table.of(*(answers.column(c).to_numpy() for c in ("key", "kind", "value")))
        docs = docs.combine_chunks()
        batch = _featured([docs.column(c).combine_chunks() for c in names], docs.column("text").to_pylist(), table, names)
        return pa.Table.from_batches([batch])
    return run


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> Model:
    """A model of the labelled rows that aren't held out."""
    rows = labelled(docs, labels, target)
    known = rows.groupBy(fold().isin(1, 2, 3).alias("counted"), "label").agg(F.count("*").alias("n")).collect()
    n = {(r["counted"], r["label"]): r["n"] for r in known}
    positive = sum(v for (_, y), v in n.items() if y)
    prior = positive / max(1, sum(n.values()))
    if len(n) < 4:  # a class is missing among the counted rows or those of the head
        return Model(prior)
    counted = rows.where(fold().isin(1, 2, 3)).select("text", "label").mapInArrow(_counter, "before long, word long, toxic long, ordinary long")
    pairs = reliable_checkpoint(counted.groupBy("before", "word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    counts = _counts(pairs)
    if not counts.sums["toxic"] or not counts.sums["ordinary"]:
        return Model(prior)
    heads = n[False, 0] + n[False, 1]
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1, HEAD_ROWS / heads))
    sample = reliable_checkpoint(rows.where((fold() == 4) & share).select("text", "label"))
    best: tuple[float, Model] | None = None
    for discount in DISCOUNTS:
        entries = reliable_checkpoint(_entries(counts, discount))
        size = entries.count()
        got = _scored(sample, entries, size, ["label"]).toPandas()
        if got["label"].nunique() < 2:
            return Model(prior)
        x, y = np.array(got["features"].tolist()), got["label"].to_numpy(float)
        head = _logistic(x, y)
        loss = _loss(x, y, head)
        if best is None or loss < best[0] - 1e-9:
            best = loss, Model(prior, entries, size, discount, head)
    return best[1]


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The named columns of ``docs`` and score (double), for every row."""
    if model.entries is None:
        return docs.select(*keep, F.lit(model.prior).alias("score"))
    rows = _scored(docs, model.entries, model.size, list(keep))
    z = F.lit(float(model.head[-1]))
    for k, w in enumerate(model.head[:-1]):
        z += F.element_at("features", k + 1) * F.lit(float(w))
    return rows.select(*keep, F.round(1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0)))), 6).alias("score"))


def predicted(threshold: float = THRESHOLD) -> Column:
    return F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int")
