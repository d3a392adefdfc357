import hashlib
import random

import numpy as np
import pytest

from salesengine.llm import queries, substring
from tests.llm.helpers import SF001, docs, prose, read


def brute(pairs, width=13):
    first = {}
    for i, t in pairs:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in pairs:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < i:
                gone |= set(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def test_registered_query_against_brute_force(spark):
    d = read("documents")
    assert got(queries.op9_substring(spark, SF001)) == brute(list(zip(d["doc_id"].tolist(), d["text"], strict=True)))


def corpus(seed, n=60):
    r = random.Random(seed)
    passages = [prose(k, r.randint(10, 40)) for k in range(5)]
    out = []
    for i in range(n):
        parts = [prose(1000 + seed * 100 + i, r.randint(0, 30))]
        for _ in range(r.randrange(4)):
            parts += [r.choice(passages), prose(5000 + seed * 100 + r.randrange(50), r.randint(0, 20))]
        out.append((i * 3 - 20, " ".join(parts)))
    return out


@pytest.mark.parametrize("shape", [None, substring.Shape(1, 64), substring.Shape(3, 1 << 10), substring.Shape(1, flush=50)])
def test_shared_passages(spark, shape):
    """Nothing is lost where everything passes a small sketch, nor between a task's flushes."""
    pairs = corpus(1)
    assert got(substring.deduplicated(docs(spark, pairs, extra="places"), shape=shape)) == brute(pairs)


def test_one_hot_passage(spark):
    passage = prose(7, 50)
    pairs = [(i, f"{prose(100 + i, 20)} {passage} {passage} {prose(300 + i, 5)}") for i in range(200)]
    assert got(substring.deduplicated(docs(spark, pairs).repartition(16))) == brute(pairs)


def test_edges(spark):
    pairs = [(1, None), (2, ""), (3, prose(1, 12)), (4, prose(1, 12)), (5, prose(1, 13)), (6, prose(1, 13)), (7, "é\xa0文 " * 40), (8, "é\xa0文\n" * 40), (9, prose(3, 60_000)), (10, "x" + prose(3, 60_000)), (11, "a " * 100)]
    assert got(substring.deduplicated(docs(spark, pairs))) == brute(pairs)
    twice = [(5, prose(1, 30)), (5, prose(1, 30)), (5, prose(2, 10) + " " + prose(1, 30)), (6, prose(1, 30))]
    assert got(substring.deduplicated(docs(spark, twice))) == brute(twice)
    nulls = substring.deduplicated(docs(spark, [(None, prose(1, 20)), (-5, prose(1, 20))])).collect()
    assert {(r["doc_id"], r["n_removed"]) for r in nulls} == {(None, 0), (-5, 20)}
    assert substring.deduplicated(docs(spark, [])).count() == 0


def test_packed_windows_come_back():
    r = np.random.default_rng(1)
    n = 500
    low = np.sort(r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
    high, row, place = r.integers(0, 1 << 32, n, np.uint32), r.integers(0, 40, n).astype(np.uint32), r.integers(0, 100_000, n)
    ids, keys = r.integers(-(1 << 62), 1 << 62, 40), r.integers(-(1 << 31), 1 << 31, 40).astype(np.int32)
    ids[3] = substring.NULL_ID
    out = substring._unpack_windows(substring._pack_windows(low, high, row, place, ids, keys))
    for a, b in zip(out, (low, high, ids[row], keys[row], place), strict=True):
        assert np.array_equal(a, b)
    gaps = np.sort(r.integers(0, 1 << 20, n))
    assert np.array_equal(substring._unpacked(substring._packed(gaps)), gaps)
