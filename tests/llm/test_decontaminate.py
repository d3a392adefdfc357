import re

import pytest

from salesengine.llm import decontaminate, queries
from tests.llm.helpers import SF001, docs, prose, read, rows


def words(text):
    return [x for x in re.split(r"[^\w]+|_+", (text or "").lower()) if x]


def windows(w, width):
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute(documents, items, threshold=0.8):
    out = set()
    held = []
    for j, t in items:
        w = words(t)
        width = min(len(w), 5)
        held.append((j, width, windows(w, width) if w else set()))
    for i, t in documents:
        mine = {width: windows(words(t), width) for width in {width for _, width, s in held if s}}
        for j, width, s in held:
            if s and len(s & mine[width]) >= threshold * len(s) - 1e-9:
                out.add((i, j, len(s & mine[width]), len(s)))
    return out


def found(spark, documents, items, **k):
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contained_items(docs(spark, documents, extra="top"), table, **k)
    return {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in out.collect()}


def test_registered_query_against_brute_force(spark):
    d, b = read("documents"), read("benchmark")
    want = brute(zip(d["doc_id"], d["text"], strict=True), zip(b["item_id"], b["text"], strict=True))
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in queries.op8_decontaminate(spark, SF001).collect()}
    assert got == want


@pytest.mark.parametrize("block", [400_000, 7])
def test_partial_containment_in_long_documents(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "SKETCH_BLOCK", block)
    items = [(j, prose(j, n)) for j, n in enumerate([5, 6, 9, 14, 30, 31, 64, 120])]
    documents = []
    for j, t in items:
        w = t.split()
        for cut in range(0, 8):
            k = max(0, round((len(w) - 4) * cut * 0.05))
            documents.append((100 * j + cut, prose(1000 + j, 3000) + " " + " ".join(w[k:]) + " " + prose(2000 + j, 50)))
    assert found(spark, documents, items) == brute(documents, items)


@pytest.mark.parametrize("block", [400_000, 3])
def test_items_of_few_words(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "SKETCH_BLOCK", block)
    items = [(1, "Seven times nine equals"), (2, "w1 w2"), (3, "sixty-three"), (4, "zebra"), (5, "zebra zebra zebra"), (6, prose(4, 30)), (7, "seven times")]
    documents = [(1, prose(1, 50) + " seven, TIMES nine equals " + prose(2, 50)), (2, "w1 w2"), (3, "w2 w1"), (4, "zebra"), (5, "a zebra zebra, zebra z"),
                 (6, prose(3, 400)), (7, prose(4, 30)), (8, None), (9, "sixty three"), (10, "sixty")]
    got = found(spark, documents, items)
    assert got == brute(documents, items)
    assert {(1, 1), (1, 7), (5, 5), (9, 3), (4, 4), (7, 6)} <= {g[:2] for g in got}
    only = [i for i in items if i[0] < 6]
    assert found(spark, documents, only) == brute(documents, only)


def test_search_loses_nothing_at_other_thresholds(spark):
    items = [(j, prose(j, 40, 60)) for j in range(20)]
    documents = [(j, prose(j % 20, 40, 60)[k:] + " " + prose(99 + j, 30, 60)) for j in range(60) for k in (0, 33)][:100]
    documents = [(i, t) for i, (_, t) in enumerate(documents)]
    for threshold in (0.3, 0.8, 1.0):
        assert found(spark, documents, items, threshold=threshold) == brute(documents, items, threshold)


def test_edges(spark):
    item = prose(1, 20)
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "only four words here"), (None, prose(2, 10))]
    documents = [(1, item.upper().replace(" ", ", ")), (1, "other"), (2, None), (3, ""), (None, item), (5, item * 2), (5, item * 2), (6, prose(2, 10)), (7, prose(3, 30_000) + " " + item)]
    got = found(spark, documents, items)
    assert got == brute(documents, items)
    table = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, documents, extra="_id")
    kept = decontaminate.clean(df, table)
    assert kept.columns == df.columns
    assert rows(kept.select("doc_id", "text")) == rows(docs(spark, [(1, "other"), (2, None), (3, "")]).select("doc_id", "text"))
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(df, none).count() == 0 and decontaminate.clean(df, none).count() == len(documents)
    assert decontaminate.contained_items(docs(spark, []), table).count() == 0


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    plan = decontaminate.contained_items(docs(spark, [(1, prose(1, 20))]), table)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
