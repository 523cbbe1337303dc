"""op5: the choice of training rows, and the network against a plain convolution and numeric gradients."""

import numpy as np

from tidemill.llm.language_id import ByteCnn, fit, predict


def test_repeats_crowd_out_no_language(spark):
    rows = [(i, f"le chat numero {i} dort", "fr") for i in range(10)] + [(50 + i, f"the cat number {i} sleeps", "en") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for one in rows[::4]:
        crowd = docs.unionByName(spark.createDataFrame([one] * 60, docs.schema))
        assert fit(crowd, sample_docs=10).classes == ["en", "fr"]


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the cat number {i} sleeps", "en") for i in range(200)] + [(1000, "kissa nukkuu", "fi")]
    assert fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=5).classes == ["en", "fi"]


def plain(net, window):
    """Probabilities of one window, filter by filter, place by place."""
    pooled = []
    for w, t in zip(net.widths, net.tables):
        for f in range(net.filters):
            pooled.append(max(sum(float(t[j][window[p + j]][f]) for j in range(w)) for p in range(net.window - w + 1)))
    logits = [sum(max(p, 0) * float(net.dense[i][c]) for i, p in enumerate(pooled)) + float(net.bias[c]) for c in range(len(net.classes))]
    e = np.exp(np.array(logits) - max(logits))
    return e / e.sum()


def test_network_is_a_plain_convolution(spark):
    r = np.random.default_rng(3)
    net = ByteCnn(["a", "b", "c"], window=20, widths=(2, 3, 4), filters=4)
    net.start(1)
    net.train(r.integers(97, 123, (60, 20)).astype(np.uint8), r.integers(0, 3, 60), epochs=1)
    x = r.integers(0, 256, (7, 20)).astype(np.uint8)
    assert np.allclose(net.probabilities(x, net.pairs()), [plain(net, w) for w in x], atol=1e-5)


def test_a_step_follows_the_numeric_gradient():
    """The first step of Adam moves each weight by the rate against its gradient's sign."""
    r = np.random.default_rng(5)
    x, y = r.integers(97, 105, (6, 12)).astype(np.uint8), r.integers(0, 2, 6)
    make = lambda: ByteCnn(["a", "b"], window=12, widths=(2, 3), filters=3)
    net = make()
    net.start(2)
    loss = lambda n: -np.mean(np.log([plain(n, w)[k] for w, k in zip(x, y)]))
    before = [p.copy() for p in (*net.tables, net.dense, net.bias)]
    net.train(x, y, epochs=1, batch=6, rate=1e-3)
    moved = [p - q for p, q in zip((*net.tables, net.dense, net.bias), before)]
    probe = make()
    probe.start(2)
    seen = 0
    for array, step in zip((*probe.tables, probe.dense, probe.bias), moved):
        for at in [tuple(z) for z in np.argwhere(np.abs(step) > 5e-4)][:12]:
            old, size = array[at], 1e-2
            array[at] = old + size
            up = loss(probe)
            array[at] = old - size
            down = loss(probe)
            array[at] = old
            if abs(up - down) > 1e-5:
                seen += 1
                assert np.sign(up - down) == -np.sign(step[at])
    assert seen > 20


def test_rejects_without_classes(spark):
    docs = spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in predict(docs.select("doc_id", "text"), fit(docs)).collect()] == ["und"]
