import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from salesengine.llm import prefix_trie, queries
from tests.llm.helpers import SF001, read

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(sequences: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += not children[k]
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(k))
        out.append((len(k), min(m), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(rows) -> dict[int, list[tuple[str, str]]]:
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            held[c].append((turn is not None, turn or 0, digest, role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in held.items()}


def rebuilt(held) -> dict[int, list[tuple[str, str]]]:
    out = {}
    for c, turns in held.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = held.get(c - c % 100, [])[:h] + turns[h:]
    return out


def solved(spark, rows, share=False, **sizes) -> list[tuple]:
    df = spark.createDataFrame(rows, SCHEMA).repartition(4) if rows else spark.createDataFrame([], SCHEMA)
    turns = prefix_trie.numbered(df.selectExpr("*", "1 AS place", "2 AS range"))
    turns, ids = prefix_trie.with_shared_openings(turns) if share else (turns, turns.select("conv_id").distinct())
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(turns, ids, **sizes).collect()), key=str)


def some(seed: int, n: int, longest: int) -> list[tuple]:
    r = random.Random(seed)
    return [(c, t, r.choice("ua"), r.choice(["", "x", "yyé", "long text"])) for c in range(n) for t in range(r.randrange(1, longest))]


def test_parentheses_equal_a_stack():
    r = random.Random(1)
    for size in (1, 2, 5, 63, 64, 65, 1000, 5000):
        for deep in (0.2, 0.5, 0.95):
            depths = [0]
            while len(depths) < size:
                depths.append(depths[-1] + 1 if r.random() < deep else r.randrange(1, depths[-1] + 2))
            tree = prefix_trie.Parentheses(np.array(depths))
            stack, close = [], {}
            for k, bit in enumerate(tree.bits.tolist()):
                if bit:
                    stack.append(k)
                else:
                    close[stack.pop()] = k
            assert not stack
            closes = tree.findclose(tree.opens)
            assert closes.tolist() == [close[k] for k in tree.opens.tolist()]
            ends = [next((j for j in range(k + 1, size) if depths[j] <= depths[k]), size) for k in range(size)]
            assert tree.subtree(np.ones(size, np.int64), closes).tolist() == [e - k for k, e in enumerate(ends)]


@pytest.mark.parametrize("segment, shard_nodes", [(1024, 20_000), (2, 0)])
def test_any_segments_and_shards(spark, segment, shard_nodes):
    rows = some(segment, 150, 6)
    assert solved(spark, rows, segment=segment, shard_nodes=shard_nodes) == brute(conversations(rows))


def test_shared_openings(spark):
    r = random.Random(3)
    rows = [(c, t, "u", r.choice("abc")) for c in [0, 7, 13, 99, 101, 150, 200, 205, 250, 299, 1000] for t in range(r.randrange(1, 9))]
    assert solved(spark, rows, share=True) == brute(rebuilt(conversations(rows)))


def test_hot_conversation_and_hot_first_turn(spark):
    long = [(5, t, "u", f"turn {t % 7}") for t in range(900)]
    same = [(c, t, "u", "hello") for c in range(100, 600) for t in range(2)]
    got = solved(spark, long + same, segment=256, shard_nodes=0)
    assert got == brute(conversations(long + same))


def test_copies_are_digested_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    rows = [(c, 0, "u", "hello") for c in range(-40, 60)]
    assert solved(spark, rows) == brute(conversations(rows))


def test_edges(spark):
    rows = [
        (None, 0, "u", "no conversation"), (1, None, "u", "first"), (1, 0, None, None), (1, 0, "a", "tie"), (1, 0, "a", "tie"), (1, 0, "b", "tie"),
        (2, 5, "u", "first"), (3, 0, "", ""), (4, 0, "au", "b"), (5, 0, "a", "ub"), (6, 0, "u", "x" * 200_000),
    ]
    assert solved(spark, rows) == brute(conversations(rows))
    assert solved(spark, []) == []


def test_registered_query(spark):
    out = queries.op13_prefix_trie(spark, SF001)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=str)
    assert got == brute(rebuilt(conversations(read("conversations")[["conv_id", "turn", "role", "text"]].itertuples(index=False))))
