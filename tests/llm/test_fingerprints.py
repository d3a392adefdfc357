import hashlib

from salesengine.llm import fingerprints, queries
from tests.llm.helpers import SF001, docs, prose, read


def exact(a: str, b: str) -> float:
    def shingles(t):
        w = t.encode().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def check(out: dict, pairs: list):
    order = sorted(pairs)
    errors = []
    assert len(out) == len(order)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = out[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r["near_edited"] - exact(text, edited), r["near_next"] - exact(text, after)]
    assert max(map(abs, errors)) < 0.2
    assert abs(sum(errors) / len(errors)) < 0.02


def test_registered_query_against_brute_force(spark):
    out = {r["doc_id"]: r for r in queries.op2_fingerprints(spark, SF001).collect()}
    d = read("documents")
    check(out, list(zip(d["doc_id"], d["text"], strict=True)))
    by_text = {}
    for i, t in zip(d["doc_id"], d["text"], strict=True):
        assert by_text.setdefault(t, out[i]["fingerprint"]) == out[i]["fingerprint"]


def test_edges(spark):
    pairs = [(5, "a b c d e f g"), (9, ""), (-3, "Ünïcödé 文字 x"), (10**15, prose(1, 3000)), (7, "a b c d e f g")]
    out = {r["doc_id"]: r for r in fingerprints.with_edited_and_next(docs(spark, pairs, extra="bucket")).collect()}
    check(out, pairs)
    assert out[5]["fingerprint"] == out[7]["fingerprint"] and out[5]["near_next"] == 1.0
    assert fingerprints.with_edited_and_next(docs(spark, [])).count() == 0
    one = fingerprints.with_edited_and_next(docs(spark, [(4, None)])).collect()
    assert [(r["n_chars"], r["near_next"]) for r in one] == [(0, 1.0)]
    odd = fingerprints.with_edited_and_next(docs(spark, [(None, "x y"), (1, "a"), (1, "b"), (1, "b")]))
    assert odd.count() == 4


def test_near_duplicates_against_brute_force(spark):
    base = [prose(k, 120) for k in range(6)]
    pairs = []
    for k, t in enumerate(base):
        w = t.split()
        pairs += [(10 * k, t), (10 * k + 1, t), (10 * k + 2, " ".join([*w[:60], "zz", *w[61:]])), (10 * k + 3, " ".join(w[:30] + [f"q{j}" for j in range(60)] + w[90:]))]
    pairs += [(100, None), (101, ""), (102, "one two"), (103, "one two")]
    want = {i: i for i, _ in pairs}
    texts = {i: t or "" for i, t in pairs}
    for _ in pairs:
        for i in want:
            for j in want:
                if exact(texts[i], texts[j]) >= 0.8:
                    want[i] = want[j] = min(want[i], want[j])
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_duplicates(docs(spark, pairs, extra="signature")).collect()}
    assert got == want
    assert fingerprints.near_duplicates(docs(spark, [])).count() == 0
