import zlib

import numpy as np

from salesengine.llm import quality, queries
from tests.llm.helpers import SF01, docs, prose, read


def slow_score(text: bytes, net: quality.Network) -> float:
    """The network straight from its description, one chunk at a time."""
    w = net.weights
    codes = list(text) + [quality.PAD] * (2 * quality.BLOCK + quality.WIDTH)
    blocks = max(1, -(-(len(text) + quality.WIDTH - 1) // quality.BLOCK))
    starts = range(0, blocks * quality.BLOCK - quality.BLOCK, quality.BLOCK) if blocks > 1 else [0]
    chunks = []
    for s in starts:
        size = quality.CHUNK if blocks > 1 else quality.BLOCK
        window = np.stack([w["embed"][codes[p:p + quality.WIDTH]].ravel() for p in range(s, min(s + size, blocks * quality.BLOCK - quality.WIDTH + 1))])
        chunks.append(np.maximum((window @ w["filter"]).max(0) + w["bias"], 0))
    if blocks > 1:
        chunks.append(chunks[-1])
    x = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0), [np.log1p(len(text)) / 10]])
    hidden = np.maximum(x @ w["hidden"] + w["hidden_bias"], 0)
    return float(1 / (1 + np.exp(-(hidden @ w["out"] + w["out_bias"])[0])))


def random_net() -> quality.Network:
    r = np.random.default_rng(0)
    shapes = {"embed": (257, quality.EMBED), "filter": (quality.WIDTH * quality.EMBED, quality.FILTERS), "bias": (quality.FILTERS,), "hidden": (2 * quality.FILTERS + 1, quality.HIDDEN), "hidden_bias": (quality.HIDDEN,), "out": (quality.HIDDEN,), "out_bias": (1,)}
    net = quality.Network(0.5, {k: r.normal(0, 0.3, s).astype(np.float32) for k, s in shapes.items()})
    net.weights["embed"][quality.PAD] = 0
    return net


def test_scores_equal_the_plain_network():
    net = random_net()
    texts = [b"", b"x", prose(1, 30).encode(), prose(2, 700).encode(), b"a" * 128, b"b" * 123, b"c" * 124, "é文".encode() * 200]
    got = quality.predict(texts, net)
    assert np.allclose(got, [slow_score(t, net) for t in texts], atol=1e-5)
    # neither neighbours nor slices show
    assert [quality.predict([t], net)[0] for t in texts] == got.tolist()


def test_gradients():
    net = random_net()
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    texts, y = [prose(3, 40).encode(), b"short", prose(4, 90).encode()], np.array([1.0, 0.0, 1.0], np.float32)

    def loss(v):
        codes, blocks = quality._padded(texts)
        x = quality._combine(quality._pooled(codes, blocks, v), blocks, np.array([len(t) for t in texts], float), v)[0]
        p = quality._head(x, v)[1]
        return -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    grads = quality._gradients(texts, y, {k: v.astype(np.float32) for k, v in w.items()})
    r = np.random.default_rng(1)
    for name in w:
        for _ in range(6):
            at = tuple(r.integers(s) for s in w[name].shape)
            if name == "embed" and at[0] == quality.PAD:
                continue
            e = 1e-3
            up, down = ({**w, name: w[name].copy()} for _ in range(2))
            up[name][at] += e
            down[name][at] -= e
            slope = (loss({k: v.astype(np.float32) for k, v in up.items()}) - loss({k: v.astype(np.float32) for k, v in down.items()})) / (2 * e)
            assert abs(slope - grads[name][at]) < 5e-3 + 0.1 * abs(slope), name


def test_registered_query_learns(spark):
    out = queries.op4_quality(spark, SF01).toPandas().set_index("doc_id")
    assert len(out) == len(read("documents", SF01))
    assert all(out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.index])
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.3)).all()
    labels = read("labels", SF01).set_index("doc_id")["quality"]
    held = out[out["held_out"]].join(labels, how="inner")
    assert (held["predicted"] == held["quality"]).mean() >= 0.93
    assert held[held["quality"] == 1]["score"].mean() - held[held["quality"] == 0]["score"].mean() > 0.5


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    df = docs(spark, [(1, "a b"), (2, None), (2, ""), (3, "x" * 300_000), (None, "a b")], extra="score")
    net = quality.fit(df, labels)
    assert not net.weights and net.prior in (0.5, 1.0)  # one class, or none
    net = random_net()
    out = quality.accepted(df, net, 0.0)
    assert out.columns == df.columns and out.count() == 5
    scores = {r["text"]: r["score"] for r in quality.score(df.drop("score"), net, "doc_id").join(df.select("doc_id", "text"), "doc_id").collect()}
    assert len(scores) >= 3
    assert quality.fit(docs(spark, []), labels).prior == 0.5
    assert quality.score(docs(spark, []), net, "doc_id").count() == 0
    two = [r["score"] for r in quality.score(docs(spark, [(1, None), (2, ""), (3, None)]), net, "doc_id").collect()]
    assert len(set(two)) == 1
