import random

import numpy as np
import pytest
import xxhash

from salesengine.llm import queries, simhash
from salesengine.llm.graph import components
from tests.llm.helpers import SF001, docs, prose, read, rows


def slow_fingerprint(text):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in raw + " ":
        if c in " \t\n\v\f\r":
            words += [now] if now else []
            now = ""
        else:
            now += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps: dict, distance=4):
    label = {i: i for i in fps}
    ids = sorted(fps)
    for _ in ids:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= distance and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
        if not changed:
            return label
    return label


def test_registered_query_against_brute_force(spark):
    d = read("documents")
    fps = {i: slow_fingerprint(t) for i, t in zip(d["doc_id"], d["text"], strict=True)}
    want = slow_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash(spark, SF001).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def clusters(seed, n, spread):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        centre = r.getrandbits(64)
        for _ in range(spread):
            x = centre
            for _ in range(r.randrange(6)):
                x ^= 1 << r.randrange(64)
            out.add(x)
            centre = x if r.random() < 0.5 else centre
    return sorted(out)


def joined(pairs, nodes):
    label = {x: x for x in nodes}
    for a, b in pairs:
        x, y = label[a], label[b]
        if x != y:
            for k in label:
                if label[k] == y:
                    label[k] = x
    groups = {}
    for k, v in label.items():
        groups.setdefault(v, set()).add(k)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("seed", range(4))
def test_trie_finds_the_links_of_its_half(seed):
    x = clusters(seed, 150, 12)
    links = [(a, b) for a in x for b in x if a < b and (a ^ b).bit_count() <= 4 and ((a ^ b) >> 32).bit_count() <= 2]
    got = simhash.trie_links(np.array(x, np.uint64), None, 4, 2, step=64)
    assert all((a ^ b).bit_count() <= 64 for a, b in got) and len(got) < len(x)
    assert joined(got, x) == joined(links, x)
    a, b = x[::2], x[1::2]
    between = [(p, q) for p in a for q in b if (p ^ q).bit_count() <= 4 and ((p ^ q) >> 32).bit_count() <= 2]
    assert joined(simhash.trie_links(np.array(a, np.uint64), np.array(b, np.uint64), 4, 2), x) == joined(between, x)


@pytest.mark.parametrize("block", [8, 40, 10_000])
def test_blocks_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    x = clusters(9, 160, 20)
    # a hot prefix: a third of all within one neighbourhood
    x = sorted({*x, *(x[0] ^ (1 << b) for b in range(40)), *(x[0] ^ (3 << b) for b in range(40))})
    signed = [int(np.uint64(v).view(np.int64)) for v in x]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash._half_links(fps, len(x), 4, 0).unionByName(simhash._half_links(fps, len(x), 4, 32))
    back = {s: v for s, v in zip(signed, x, strict=True)}
    got = [(back[r["a"]], back[r["b"]]) for r in links.collect()]
    want = [(a, b) for a in x for b in x if a < b and (a ^ b).bit_count() <= 4]
    assert joined(got, x) == joined(want, x)


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(30)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e if None not in e}
    groups = joined([e for e in edges if None not in e], nodes)
    assert got == {n: g[0] for g in groups for n in g if n != g[0]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    long = prose(8, 40_000)
    data = [(5, None), (4, ""), (9, " \t\n"), (7, "One TWO"), (8, "one two"), (3, long), (6, long), (6, "é É"), (6, "é É")]
    df = docs(spark, data, extra="fp")
    got = rows(simhash.near_duplicates(df).select("doc_id", "fp", "component_id"))
    fps = {(i, t): slow_fingerprint(t) for i, t in data}
    assert sorted(np.int64(g[1]).view(np.uint64) for g in got) == sorted(fps[i, t] for i, t in data)
    by = {g[0]: g[2] for g in got if g[0] in (5, 4, 9, 7, 8, 3)}
    assert by == {5: 4, 4: 4, 9: 4, 7: 7, 8: 7, 3: 3}
    kept = rows(simhash.distinct_documents(df).select("doc_id", "text"))
    assert kept == rows(spark.createDataFrame([(4, ""), (7, "One TWO"), (3, long), (6, "é É")], "doc_id long, text string"))
    assert simhash.distinct_documents(df).columns == df.columns
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.distinct_documents(docs(spark, [(None, "a"), (None, "a"), (None, "b")])).count() == 2
