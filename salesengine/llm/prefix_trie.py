"""Prefix trie of conversations, as balanced parentheses.

Every distinct sequence of first turns is a node.  A node is known by the sum of
hashes of its turns with their places (128 bits), so a sequence's nodes are the
running sums of its turns, and texts needn't travel.

Sequences are cut into *segments* of ``SEGMENT`` turns; all segments below one
node form a small trie of their own, and the totals of a deeper one are handed to
the node it hangs from.  Segments are sorted by their nodes, which is the order
of the trie, and cut into ranges of a bounded number of nodes.  Each range (a
*shard*) writes its trie as a row of parentheses, a pair a node, and answers from
it:

* ``findclose`` delimits a subtree: the excess of open over closed parentheses is
  kept with its minimum for each block and each pair of blocks above, so the
  search goes up and down that tree of minima and reads two blocks;
* the rank of ``()`` pairs up to either end of a subtree counts its leaves;
* cumulative sums in the order of opening give its members and savings.

Only the nodes above a shard's first and last segment (its *spines*) can have
parts in other shards.  Spines are sent on as two rows a shard, each node with
what is known below it, and the same job merges them, in ever fewer shards
until there is one.

Nothing is collected; every round is written to the shared checkpoint folder. A
conversation's turns are numbered in ranges that a long conversation may span,
with one number a range carried over; its segments are rows of their own.

Defined cases: rows without a conversation id belong to no conversation; null
role or text is empty, null turns come first; rows of one turn stand in the
order of a digest of role and text, repeated rows all count; no rows at all give
an empty frame (no root); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesengine.llm.hashing import mix
from salesengine.session import reliable_checkpoint

SEGMENT = 1024
SHARD_NODES = 20_000
CHUNK_IDS = 100_000
BLOCK = 64
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


# ------------------------------------------------------------------ parentheses

class Parentheses:
    """A trie in depth-first order, from the depth of each node (the root has 0, the others at least 1 and at most one more than the node before)."""

    def __init__(self, depths: np.ndarray):
        depths = np.asarray(depths, np.int64)
        n = len(depths)
        closed = np.append(depths[:-1] - depths[1:] + 1, depths[-1] + 1)  # closed after each node's opening
        self.opens = np.arange(n) + np.concatenate([[0], np.cumsum(closed)[:-1]])
        self.bits = np.zeros(2 * n, np.int8)
        self.bits[self.opens] = 1
        self.excess = np.cumsum(2 * self.bits.astype(np.int64) - 1)
        blocks = max(1, -(-2 * n // BLOCK))
        size = 1 << (blocks - 1).bit_length()
        padded = np.full(size * BLOCK, np.iinfo(np.int64).max)
        padded[:2 * n] = self.excess
        self._blocks = padded.reshape(size, BLOCK)
        self.minima = [self._blocks.min(1)]  # of blocks, of pairs of blocks, ...
        while len(self.minima[-1]) > 1:
            self.minima.append(self.minima[-1].reshape(-1, 2).min(1))
        self.leaves = np.cumsum((self.bits == 1) & (np.append(self.bits[1:], 0) == 0))  # rank of () pairs

    def _within(self, block: np.ndarray, target: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The first place in each block, beyond place ``after``, with at most the target excess; -1 if none."""
        out = np.full(len(block), -1)
        for k in range(0, len(block), 1 << 14):
            part = slice(k, k + (1 << 14))
            places = block[part, None] * BLOCK + np.arange(BLOCK)
            hit = (self._blocks[block[part]] <= target[part, None]) & (places > after[part, None])
            out[part] = np.where(hit.any(1), block[part] * BLOCK + hit.argmax(1), -1)
        return out

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The closing place of each opening place."""
        opens = np.asarray(opens, np.int64)
        target = self.excess[opens] - 1
        out = self._within(opens // BLOCK, target, opens)
        left = np.flatnonzero(out < 0)
        at = opens[left] // BLOCK
        level = np.zeros(len(left), np.int64)
        going = np.ones(len(left), bool)
        for up, minima in enumerate(self.minima):  # up, until the neighbour to the right holds the target
            here = going & (level == up)
            right = here & (at % 2 == 0) & (at + 1 < len(minima))
            found = right.copy()
            found[right] = minima[at[right] + 1] <= target[left[right]]
            at[found] += 1
            going &= ~found
            climb = here & ~found
            at[climb] //= 2
            level[climb] += 1
        for down in range(len(self.minima) - 1, 0, -1):  # down, to the leftmost half that holds it
            here = level == down
            child = 2 * at[here]
            low = self.minima[down - 1][child] <= target[left[here]]
            at[here] = np.where(low, child, child + 1)
            level[here] -= 1
        out[left] = self._within(at, target[left], opens[left])
        return out

    def subtree(self, values: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """For each node the sum of ``values`` (by node) over its subtree."""
        total = np.concatenate([[0], np.cumsum(values)])
        first = np.arange(len(self.opens))
        return total[self.before(closes)] - total[first]

    def before(self, places: np.ndarray) -> np.ndarray:
        """Nodes opened up to each place."""
        return (self.excess[places] + places + 1) // 2


# ------------------------------------------------------------------ one shard

#: A row is one path from its trie's root: nodes (a, b), code points of their texts, and what hangs at each node besides
#: the nodes that the rows name: members, the least of their ids, children, leaves and savings.  ``last`` is the path's depth.
_PATH = ("depth0 long, root_a long, root_b long, a array<long>, b array<long>, chars array<long>, members array<long>, least array<long>, "
         "children array<long>, leaves array<long>, saved array<long>")
_LISTS = ("a", "b", "chars", "members", "least", "children", "leaves", "saved")
_NODE = "final boolean, depth0 long, depth long, root_a long, root_b long, a long, b long, parent_a long, parent_b long, n_convs long, conv_id long, n_children long, n_leaves long, saved long"
_NONE = np.iinfo(np.int64).max


class _Shard:
    """The trie of sorted rows, which may belong to several roots (all roots are children of one that isn't given out)."""

    def __init__(self, rows: Iterator[dict]):
        self.depth, self.parent, self.root, self.info = [0], [-1], [0], [(0, 0, 0, 0, 0)]
        self.held = [[0, _NONE, 0, 0, 0]]
        stack, spine, self.first = [0], [], 0
        self.rows = 0
        for row in rows:
            # a path begins with the root of its trie
            path = list(zip([row["root_a"], *row["a"]], [row["root_b"], *row["b"]], strict=True))
            known = 0
            while known < min(len(path), len(spine)) and spine[known] == path[known] and (known or self.depth0 == row["depth0"]):
                known += 1
            del stack[known + 1:]
            self.depth0 = row["depth0"]
            for k in range(known, len(path)):
                self.parent.append(stack[-1])
                self.depth.append(k + 1)
                self.root.append(self.root[stack[-1]] if k else len(self.root))
                self.info.append((row["depth0"], *path[k], row["chars"][k], k))
                self.held.append([0, _NONE, 0, 0, 0])
                stack.append(len(self.depth) - 1)
            spine = path
            for k, node in enumerate(stack[1:]):
                held = self.held[node]
                held[0] += row["members"][k]
                held[1] = min(held[1], row["least"][k])
                for x, name in enumerate(("children", "leaves", "saved"), 2):
                    held[x] += row[name][k]
            if not self.rows:
                self.first_spine = set(stack)
            self.rows += 1
        self.last_spine = list(stack)

    def solve(self, alone: bool) -> tuple[list[tuple], list[dict]]:
        """The nodes that are known in full, and the spines as rows (none if the shard stands ``alone``)."""
        tree = Parentheses(np.array(self.depth))
        closes = tree.findclose(tree.opens)
        held = np.array([x[:1] + x[2:] for x in self.held], np.int64)
        parent = np.array(self.parent)
        members = tree.subtree(held[:, 0], closes)
        children = np.bincount(parent[1:], minlength=len(parent)) + held[:, 1]
        bare = children == 0
        # leaf pairs by rank; a node without children here may have some elsewhere
        pairs = tree.leaves[closes] - np.concatenate([[0], tree.leaves])[tree.opens]
        hidden = np.zeros(len(parent), np.int64)
        hidden[(np.bincount(parent[1:], minlength=len(parent)) == 0) & ~bare] = 1
        leaves = pairs - tree.subtree(hidden, closes) + tree.subtree(held[:, 2], closes)
        chars = np.array([x[3] for x in self.info], np.int64)
        own = np.where(members > 0, members - 1, 0) * chars
        saved = tree.subtree(own + held[:, 3], closes)
        least = [x[1] for x in self.held]
        for k in range(len(parent) - 1, 0, -1):
            least[parent[k]] = min(least[parent[k]], least[k])
        spine = set() if alone else self.first_spine | set(self.last_spine)
        out = []
        given = [list(x) for x in self.held]
        for k in range(1, len(parent)):
            if k in spine:
                continue
            depth0, a, b, _, d = self.info[k]
            p = self.info[parent[k]]
            out.append((True, depth0, depth0 + d, *self.info[self.root[k]][1:3], a, b, *(p[1:3] if d else (None, None)), int(members[k]), least[k], int(children[k]), int(leaves[k]), int(saved[k])))
            if parent[k] in spine and parent[k]:
                top = given[parent[k]]
                for x, v in ((0, members[k]), (2, 1), (3, leaves[k]), (4, saved[k])):
                    top[x] += int(v)
                top[1] = min(top[1], least[k])
        return out, self._spines(given) if spine else []

    def _spines(self, given: list[list[int]]) -> list[dict]:
        """The paths of the first and the last row; what hangs at a node goes with the first that has it."""
        out, told = [], set()
        first, last = sorted(self.first_spine)[1:], self.last_spine[1:]
        for nodes in [first] if first == last else [first, last]:
            row: dict = {k: [] for k in _LISTS}
            for k in nodes:
                depth0, a, b, chars, d = self.info[k]
                row |= {"depth0": depth0} if d else {"depth0": depth0, "root_a": a, "root_b": b}
                if d:
                    row["a"].append(a)
                    row["b"].append(b)
                row["chars"].append(chars)
                values = [0, _NONE, 0, 0, 0] if k in told else given[k]
                told.add(k)
                for name, v in zip(_LISTS[3:], values, strict=True):
                    row[name].append(v)
            out.append(row)
        return out


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_NODE_ARROW = pa.schema([(n, pa.bool_() if n == "final" else pa.int64()) for n in _names(_NODE)])
_PATH_ARROW = pa.schema([(n, pa.list_(pa.int64()) if n in _LISTS else pa.int64()) for n in _names(_PATH)])
_ROUND = pa.schema([*_NODE_ARROW, pa.field("spine", pa.struct(list(_PATH_ARROW)))])


def _solver(alone: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(row for batch in batches for row in batch.to_pylist())
        if not shard.rows:
            return
        nodes, spines = shard.solve(alone)
        for k in range(0, len(nodes), 50_000):
            part = nodes[k:k + 50_000]
            columns = [pa.array([r[i] for r in part], f.type) for i, f in enumerate(_NODE_ARROW)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(part), _ROUND.field("spine").type)], schema=_ROUND)
        if spines:
            columns = [pa.array([False] * len(spines), f.type) if f.name == "final" else pa.nulls(len(spines), f.type) for f in _NODE_ARROW]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spines, _ROUND.field("spine").type)], schema=_ROUND)
    return run


def _solved(paths: DataFrame, shard_nodes: int) -> DataFrame:
    """Every node of the tries of ``paths`` (``_PATH``), round by round."""
    done = None
    while True:
        paths = reliable_checkpoint(paths)
        nodes = paths.agg(F.sum(F.size("a") + 1)).first()[0] or 0
        shards = -(-nodes // shard_nodes)
        if shards > 1:
            # a shard's spines are shorter than a shard, so each round has fewer rows
            order = ["depth0", "root_a", "root_b", F.arrays_zip("a", "b")]
            dealt = paths.repartitionByRange(shards, *order).sortWithinPartitions(*order)
        else:
            dealt = paths.coalesce(1).sortWithinPartitions("depth0", "root_a", "root_b", F.arrays_zip("a", "b"))
        made = reliable_checkpoint(dealt.mapInArrow(_solver(shards <= 1), f"{_NODE}, spine struct<{_PATH.replace(' ', ': ').replace(',:', ',')}>"))
        known = made.where("final").drop("final", "spine")
        done = known if done is None else done.unionByName(known)
        if shards <= 1:
            return done
        paths = made.where("NOT final").select("spine.*")


# ------------------------------------------------------------------ from turns to nodes

def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each conversation within sorted rows."""
    conversation, count = None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        starts = np.concatenate([[True], ids[1:] != ids[:-1]])
        at = np.arange(len(ids)) - np.flatnonzero(starts)[np.cumsum(starts) - 1] + 1
        if ids[0] == conversation:
            at[:(np.flatnonzero(starts)[1:2].tolist() or [len(ids)])[0]] += count
        conversation, count = ids[-1], int(at[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "place"])


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), x, y, chars of every turn: its place in its conversation, what its role and text hash to, and the code points of its text.

    Ranges of turns are numbered where they are; a conversation that goes on in the next range takes its count along.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    dealt = rows.repartitionByRange(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", F.xxhash64("digest").alias("x"), F.xxhash64(F.lit("y"), "digest").alias("y"), "chars", F.spark_partition_id().alias("range"))
    placed = reliable_checkpoint(dealt.mapInArrow(_placed, "conv_id long, x long, y long, chars long, range int, place long"))
    counts = placed.groupBy("conv_id", "range").agg(F.max("place").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # only the first conversation of a range can have turns before it: one row a range at most
    carried = F.broadcast(counts.withColumn("carried", F.sum("n").over(before)).where("carried > 0").drop("n"))
    return placed.join(carried, ["conv_id", "range"], "left").select("conv_id", (F.col("place") + F.coalesce("carried", F.lit(0))).alias("place"), "x", "y", "chars")


def with_shared_openings(turns: DataFrame, every: int = 100, choices: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): the first h turns of each conversation (``numbered``) replaced by those of the conversation at the last multiple of ``every``.

    h is the checksum of the id modulo ``choices``; where that conversation has fewer turns, all of them, where there is none, none.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % choices
    base = F.col("conv_id") - F.col("conv_id") % every
    turn = F.struct("place", "x", "y", "chars")
    opening = turns.where((F.col("conv_id") % every == 0) & (F.col("place") < choices)).groupBy(F.col("conv_id").alias("base"))
    openings = reliable_checkpoint(opening.agg(F.sort_array(F.collect_list(turn)).alias("opening")))
    ids = turns.select("conv_id").distinct()
    given = ids.withColumn("base", base).join(openings, "base").select("conv_id", F.explode(F.slice("opening", F.lit(1), h.cast("int"))).alias("t")).select("conv_id", "t.*")
    own = turns.where(F.col("place") > h).withColumn("base", base).join(openings.select("base", F.size("opening").alias("size")), "base", "left")
    place = F.least(h, F.coalesce("size", F.lit(0))) + F.col("place") - h
    return given.unionByName(own.select("conv_id", place.alias("place"), "x", "y", "chars")), ids


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums of the hashes of each segment's turns, each mixed with its place."""
    for batch in batches:
        turns = batch.column("turns")
        lengths = np.diff(turns.offsets.to_numpy())
        rows = turns.flatten()
        place = rows.field("place").to_numpy().astype(_U)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        out = []
        for name in ("x", "y"):
            value = rows.field(name).to_numpy().view(_U)
            total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(value + mix(place * _PLACE)), dtype=_U)])
            out.append((total[1:] - np.repeat(total[bounds[:-1]], lengths)).view(np.int64))
        arrays = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v, pa.int64())) for v in (*out, rows.field("chars").to_numpy())]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), *arrays], names=["conv_id", "segment", "a", "b", "chars"])


def _wrapped(total: Column) -> Column:
    """A sum of longs, modulo 2^64, as a long."""
    whole = F.lit(str(2**64)).cast("decimal(20,0)")
    low = F.pmod(total, whole)
    return F.when(low >= F.lit(str(2**63)).cast("decimal(20,0)"), low - whole).otherwise(low).cast("long")


def paths(turns: DataFrame, ids: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, segment, root_a, root_b, a, b, chars, ends: each conversation's nodes, a row for each ``segment`` turns; ``ends`` on its last row."""
    parts = turns.groupBy("conv_id", F.floor((F.col("place") - 1) / segment).alias("segment")).agg(
        F.sort_array(F.collect_list(F.struct("place", "x", "y", "chars"))).alias("turns"))
    sums = reliable_checkpoint(parts.mapInArrow(_sums, "conv_id long, segment long, a array<long>, b array<long>, chars array<long>"))
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(c: str) -> Column:
        return _wrapped(F.coalesce(F.sum(F.element_at(c, -1).cast("decimal(20,0)")).over(before), F.lit(0).cast("decimal(30,0)")))

    last = F.lead("segment").over(Window.partitionBy("conv_id").orderBy("segment")).isNull()
    rooted = sums.select("conv_id", "segment", earlier("a").alias("root_a"), earlier("b").alias("root_b"), "a", "b", "chars", last.alias("ends"))

    def moved(c: str) -> Column:
        return F.when(F.col("segment") == 0, F.col(c)).otherwise(F.transform(c, lambda v: _wrapped(v.cast("decimal(20,0)") + F.col(f"root_{c}"))))

    none = F.array().cast("array<bigint>")
    empty = ids.join(sums.select("conv_id").distinct(), "conv_id", "left_anti").select(
        "conv_id", *(F.lit(0).cast("long").alias(c) for c in ("segment", "root_a", "root_b")), none.alias("a"), none.alias("b"), none.alias("chars"), F.lit(True).alias("ends"))
    return rooted.select("conv_id", "segment", "root_a", "root_b", moved("a").alias("a"), moved("b").alias("b"), "chars", "ends").unionByName(empty)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, conv_id) as texts of comma-joined ids, with the least id of each."""
    for batch in batches:
        a, b, ids = (batch.column(c).to_numpy() for c in ("a", "b", "conv_id"))
        if not len(ids):
            continue
        cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        starts = np.unique(np.concatenate([[0], cuts, np.arange(0, len(ids), CHUNK_IDS)]))
        texts = [",".join(map(str, part.tolist())) for part in np.split(ids, starts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(ids[starts]), pa.array(texts)], names=["a", "b", "first", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts in a row, joined by commas; only one digest is open at a time."""
    node, digest = None, None
    for batch in batches:
        out = []
        for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
            if (a, b) == node:
                digest.update(b"," + text.encode())
                continue
            if digest:
                out.append((*node, digest.hexdigest()))
            node, digest = (a, b), hashlib.sha256(text.encode())
        yield _digested(out)
    if digest:
        yield _digested([(*node, digest.hexdigest())])


def _digested(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of the nodes that conversations (``paths``) end at: ids joined in ranges, so one digest reads few rows whatever their number."""
    here = rows.where("ends").select(F.coalesce(F.try_element_at("a", F.lit(-1)), F.lit(0)).alias("a"), F.coalesce(F.try_element_at("b", F.lit(-1)), F.lit(0)).alias("b"), "conv_id")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = here.repartitionByRange(n, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    chunks = dealt.mapInArrow(_chunks, "a long, b long, first long, text string")
    return chunks.repartition(n, "a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_digests, "a long, b long, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame, segment: int = SEGMENT, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """a, b (the node), depth, conv_id (least member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every node.

    ``turns``: conv_id, place, x, y, chars, as ``numbered`` gives them; ``ids``: every conversation, those without turns too.
    """
    rows = reliable_checkpoint(paths(turns, ids, segment))
    path = F.struct("a", "b", "chars")
    last_a, last_b = (F.coalesce(F.try_element_at(c, F.lit(-1)), F.col(f"root_{c}")) for c in "ab")
    distinct = reliable_checkpoint(rows.groupBy("segment", last_a.alias("last_a"), last_b.alias("last_b")).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("root_a").alias("root_a"), F.first("root_b").alias("root_b"), F.first(path).alias("path")))
    below, found = None, None
    deepest = distinct.agg(F.max("segment")).first()[0] or 0
    for level in range(deepest, -1, -1):  # a trie's totals are known before those of the one above
        part = distinct.where(F.col("segment") == level)
        hung = [F.lit(0).cast("long")] * 3
        if below is not None:
            part = part.join(below, ["last_a", "last_b"], "left")
            hung = [F.coalesce(c, F.lit(0)) for c in ("n_children", "n_leaves", "saved")]

        def at_end(value: Column, other: int = 0) -> Column:
            return F.concat(F.array_repeat(F.lit(other).cast("long"), F.size("path.a")), F.array(value))

        named = [at_end(v).alias(c) for v, c in zip([F.col("n"), F.col("least"), *hung], _LISTS[3:], strict=True)]
        named[1] = at_end(F.col("least"), _NONE).alias("least")
        solved = _solved(part.select(
            (F.lit(level) * segment).cast("long").alias("depth0"), "root_a", "root_b", F.col("path.a").alias("a"), F.col("path.b").alias("b"),
            F.concat(F.array(F.lit(0).cast("long")), "path.chars").alias("chars"), *named), max(shard_nodes, 8 * (segment + 1)))
        own = solved if level == 0 else solved.where("depth > depth0")
        found = own if found is None else found.unionByName(own)
        below = solved.where("depth = depth0").select(F.col("a").alias("last_a"), F.col("b").alias("last_b"), "n_children", "n_leaves", "saved")
    up = found.select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("depth").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    out = found.withColumn("up", F.col("depth") - 1).join(up, ["parent_a", "parent_b", "up"], "left").join(ends(rows), ["a", "b"], "left")
    nothing = hashlib.sha256().hexdigest()
    return out.select("a", "b", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
