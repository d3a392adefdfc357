"""The whole chain against its stages' brute-force versions in a row."""

import random

import numpy as np
import pytest

import corpus_pipeline
from salesengine.llm import packing, pii, quality
from salesengine.llm.queries import PII_KEY
from tests.llm.helpers import SF001, docs, prose, read
from tests.llm.test_decontaminate import brute as contained
from tests.llm.test_packing import check
from tests.llm.test_quality import slow_score
from tests.llm.test_simhash import slow_components, slow_fingerprint


def test_stages_are_the_five_in_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["good_quality", "without_near_duplicates", "without_benchmark", "without_personal_data", "packed"]


@pytest.fixture(scope="module")
def net(spark):
    """The network of the small tables, fitted once in fewer steps."""
    steps, quality.STEPS = quality.STEPS, 250
    yield quality.fit(spark.read.parquet(f"{SF001}/documents.parquet"), spark.read.parquet(f"{SF001}/labels.parquet"))
    quality.STEPS = steps


@pytest.fixture()
def fitted(net, monkeypatch):
    monkeypatch.setattr(quality, "fit", lambda docs, labels, target="quality": net)
    return net


def test_chain_equals_brute_force(spark, fitted):
    d, labels, net = read("documents"), read("labels"), fitted
    assert len(labels) and net.weights
    texts = dict(zip(d["doc_id"], d["text"], strict=True))
    good = {i: t for i, t in texts.items() if round(slow_score((t or "").encode(), net), 6) >= quality.THRESHOLD}
    assert 0 < len(good) < len(texts)
    groups = slow_components({i: slow_fingerprint(t) for i, t in good.items()})
    single = {i: t for i, t in good.items() if groups[i] == i}
    b = read("benchmark")
    found = {x[0] for x in contained(single.items(), zip(b["item_id"], b["text"], strict=True))}
    clean = {i: t for i, t in single.items() if i not in found}
    assert len(clean) < len(single) < len(good)
    rows = [(int(i), t) for i, t in clean.items()]
    masked = [(r["doc_id"], r["text"]) for r in pii.pseudonymise(docs(spark, rows), PII_KEY).collect()]
    assert sum(t != clean[i] for i, t in masked)
    out = corpus_pipeline.run(spark, SF001).collect()
    used = check(out, masked)
    assert used <= packing.lower_bound(np.array([r["length"] for r in out]), 2048) + 1


def test_stages_keep_columns_and_odd_rows(spark, fitted):
    extra = "row"
    r = random.Random(1)
    copy = prose(5, 60)
    given = [(1, None), (2, ""), (3, copy), (3, copy), (4, copy), (5, prose(6, 3000)), (None, prose(7, 40)), (6, "mail a@b.example.com"), (7, copy + " w1")]
    r.shuffle(given)
    df = docs(spark, given, extra=extra)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF001)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == df.columns, name
        df = out if name != corpus_pipeline.STAGES[-1][0] else df


def test_empty_table(spark, fitted):
    df = docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF001)
        assert out.count() == 0
        df = out if name != corpus_pipeline.STAGES[-1][0] else df
