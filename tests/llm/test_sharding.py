import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from salesengine.llm import sharding
from tests.llm.helpers import docs, read


def brute_table(names, weights, size):
    """Shards take turns, each walking its own permutation of all slots."""
    walks = {}
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        walks[n] = iter([(offset + k * skip) % size for k in range(size)])
    owner = {}
    while len(owner) < size:
        for n in sorted(names):
            for _ in range(weights.get(n, 1)):
                slot = next((s for s in walks[n] if s not in owner), None)
                if slot is not None:
                    owner[slot] = n
    return [owner[s] for s in range(size)]


@pytest.mark.parametrize("weights", [{}, {"b": 3}])
def test_table_equals_turn_by_turn_walk(weights):
    names = ["a", "b", "c", "d"]
    table = sharding.fill_table({n: weights.get(n, 1) for n in names}, 251)
    assert [names[i] for i in table] == brute_table(names, weights, 251)


def test_balance_and_small_moves():
    names = [f"s{i}" for i in range(20)]
    before = np.array(names)[sharding.fill_table(names, 10007)]
    counts = np.unique(before, return_counts=True)[1]
    assert counts.max() - counts.min() <= 1
    after = np.array(names[:-1])[sharding.fill_table(names[:-1], 10007)]
    moved = (before != after) & (before != "s19")
    assert moved.mean() < 0.05


def test_order_of_names_does_not_matter():
    a, b = ["x", "y", "z"], ["z", "x", "y"]
    assert [a[i] for i in sharding.fill_table(a, 101)] == [b[i] for i in sharding.fill_table(b, 101)]


@pytest.mark.parametrize(("shards", "size"), [([], 101), (["a"], 100), ({"a": 0}, 101), (["a"], 1 << 23)])
def test_bad_arguments(shards, size):
    with pytest.raises(ValueError):
        sharding.fill_table(shards, size)


def test_registered_query_against_brute_force(spark):
    from salesengine.llm import queries

    got = {r["doc_id"]: (r["slot"], r["shard"]) for r in queries.op1_sharding(spark, "/root/testdata/sf0.001").collect()}
    table = brute_table(queries.SHARDS, {}, sharding.TABLE_SIZE)
    want = {}
    for i in read("documents")["doc_id"]:
        h = xxhash.xxh64_intdigest(str(i).encode(), 42)
        slot = (h - (1 << 64) if h >> 63 else h) % sharding.TABLE_SIZE
        want[i] = (slot, table[slot])
    assert got == want


def test_edges(spark):
    df = docs(spark, [(None, "a"), (1, None), (1, None), (2, "")], extra="kept one")
    out = sharding.place(df, F.col("doc_id"), ["a", "b"], 101)
    assert out.columns == [*df.columns, "slot", "shard"] and out.count() == 4
    assert len({r["shard"] for r in out.where("doc_id = 1").collect()}) == 1
    assert sharding.place(docs(spark, []), F.col("doc_id"), ["a"], 101).count() == 0
    with pytest.raises(ValueError):
        sharding.place(docs(spark, [(1, "a")], extra="Slot"), F.col("doc_id"), ["a"], 101)
