import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from salesengine.llm import packing, queries
from tests.llm.helpers import SF001, docs, read

PATH = queries.tokenizer_path()


def check(out, texts):
    """Pieces, checksums and places of every document (a list of (doc_id, text))."""
    t = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(i, []).extend((k, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_sequence)


def test_registered_query(spark):
    out = queries.op5_packing(spark, SF001).collect()
    d = read("documents")
    n = check(out, list(zip(d["doc_id"], d["text"], strict=True)))
    bound = packing.lower_bound(np.array([r["length"] for r in out]), 2048)
    assert bound <= n <= bound + 1


def test_words_are_split_as_the_tokenizer_does():
    with open(PATH, encoding="utf-8") as f:
        text = f.read()
    cache, t = packing.WordCache(text, limit=40), Tokenizer.from_str(text)
    letters = [*"abcXYZ '’sStE09-_.!\"İıßẞΣσςéÉñ́̀\x1c\x85\xa0​　中ﬁªº²½ǅ\n\t<|>", "<|endoftext|>", "'ll", "a" * 70, "😀", "\x00"]
    r = random.Random(1)
    for _ in range(4000):
        s = "".join(r.choice(letters) for _ in range(r.randrange(14)))
        assert cache.encode(s) == np.array(t.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), repr(s)


def exhaustive(lengths, capacity):
    """Least number of bins, by trying all."""
    best = len(lengths)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                put(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1:]])
        put(k + 1, [*bins, lengths[k]])
    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_bounds(seed):
    r = random.Random(seed)
    lengths = np.array([r.randint(1, 20) for _ in range(r.randint(1, 9))])
    bins, offsets, room = packing.best_fit_decreasing(lengths, 20)
    best = exhaustive(sorted(lengths.tolist(), reverse=True), 20)
    assert packing.lower_bound(lengths, 20) <= best <= len(room)
    assert all(20 - room[b] == lengths[bins == b].sum() for b in range(len(room)))


def test_dual_feasible_functions_beat_the_sum():
    assert packing.lower_bound(np.array([11] * 6), 20) == 6
    assert packing.lower_bound(np.array([7] * 9), 20) == 5


def test_exchange_between_groups(spark):
    r = random.Random(5)
    rows = [(i, 0, 0, 0, r.choice([3, 5, 9, 11, 14, 20]), i) for i in range(1500)]
    sized = spark.createDataFrame(rows, packing.PIECES.format(id="long"))
    out = packing.pack(sized, 20, group_rows=100).collect()
    assert sorted(x["doc_id"] for x in out) == list(range(1500))
    used = {}
    for x in out:
        used.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in used.values():
        assert sum(n for _, n in places) <= 20
        assert sorted(o for o, _ in places) == np.cumsum([0, *(n for _, n in sorted(places))])[:-1].tolist()
    alone, _, room = packing.best_fit_decreasing(np.array([x[4] for x in rows]), 20)
    assert len(used) <= len(room) + 4


def test_equal_rows_are_spread_over_groups(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    kept = packing.best_fit_decreasing

    def counted(lengths, capacity):
        if len(lengths) > 700:
            seen.add(1)
        return kept(lengths, capacity)

    monkeypatch.setattr(packing, "best_fit_decreasing", counted)
    sized = spark.createDataFrame([(7, 0, 0, 0, 3, 1)] * 4000, packing.PIECES.format(id="long"))
    out = packing.pack(sized, 20, group_rows=400).collect()
    assert len(out) == 4000 and seen.value == 0
    assert len({x["sequence_id"] for x in out}) <= 4000 // 6 + 1 + 10


def test_edges(spark):
    texts = [(1, None), (2, ""), (3, "word " * 5000), (3, "word " * 5000), (3, "other"), (4, "x" * 3000), (None, "a b")]
    out = packing.pack(packing.pieces(docs(spark, texts, extra="piece"), PATH))
    check(out.collect(), texts)
    assert packing.pack(packing.pieces(docs(spark, []), PATH)).count() == 0
