import numpy as np

from lexspan.llm import toxicity
from lexspan.llm.toxicity import Network, fit, toxicity_scores, train, windows_of


def texts(rng, count, bad_share=0.3):
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(800)]
    rows = []
    for _ in range(count):
        words = list(rng.choice(vocab, rng.integers(5, 200)))
        toxic = rng.random() < bad_share
        for _ in range(2 * toxic):
            words.insert(rng.integers(len(words)), str(rng.choice(["zqx", "wvut"])) + "".join(rng.choice(list("klm"), 3)))
        rows.append((" ".join(words) + ".", int(toxic)))
    return rows


def test_windows_cover_every_word():
    counts = np.array([0, 1, 24, 25, 36, 37, 500])
    index, text = windows_of(counts)
    assert index.max() == counts.sum() - 1
    for t, n in enumerate(counts):
        own = index[text == t]
        assert set(own[own >= 0].tolist()) == set(range(int(counts[:t].sum()), int(counts[: t + 1].sum())))
    assert (index[text == 0] == -1).all() and (text == 0).sum() == 1


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((7, 2 * toxicity.DIM))
    index = rng.integers(-1, 7, (5, toxicity.WINDOW))
    target, weight = np.array([0, 1, 0, 1, 1.0]), np.ones(5)

    def loss():
        logit = net.forward({k: v.astype(np.float64) for k, v in net.gates(x).items()}, index).astype(np.float64)
        return float(np.mean(np.logaddexp(0, logit) - target * logit))

    g, d_x = net.gradients(x, net.gates(x), index, target, weight)
    for name, value in [*((k, net.p[k]) for k in g), ("x", x)]:
        got = d_x if name == "x" else g[name]
        at = np.unravel_index(np.argmax(np.abs(got)), got.shape)
        before = value[at]
        value[at] = before + 1e-2
        up = loss()
        value[at] = before - 1e-2
        down = loss()
        value[at] = before
        assert abs((up - down) / 2e-2 - got[at]) < 0.05 * abs(got[at]) + 1e-4, name


def test_held_out_accuracy_and_odd_rows(spark):
    rows = texts(np.random.default_rng(5), 700)
    odd = [(9001, None), (9002, ""), (9003, " \n"), (9004, "clean " * 30000), (None, "abc")]
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(rows)] + [(i, t, "x") for i, t in odd], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)] + [(None, 1, 1), (9002, 1, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in toxicity_scores(docs, fit(docs, labels)).collect()}
    assert len(out) == len(rows) + len(odd) and all(0 <= s <= 1 for s in out.values())
    import zlib

    held = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((out[i] >= 0.3) == bool(rows[i][1]) for i in held)
    assert right / len(held) > 0.9


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity_scores(docs, fit(docs, labels)).collect()[0].score < 0.3
    assert toxicity_scores(docs.limit(0), train([], np.array([]))).count() == 0


def test_caps_leave_the_calibrated_share():
    rng = np.random.default_rng(3)
    logit = np.concatenate([rng.normal(1, 1.5, 2000), rng.normal(-1, 1.5, 16000)])
    toxic = np.arange(len(logit)) < 2000
    drawn = toxic | (np.arange(len(logit)) % 8 == 0)  # the clean cap leaves one in eight
    line = lambda keep, share: toxicity._fit_line(logit[keep], toxic[keep], toxicity._importance(toxic[keep], share))
    whole, capped = line(toxic | True, None), line(drawn, toxic.mean())
    assert np.allclose(whole, capped, atol=0.15)
    assert not np.allclose(whole, line(drawn, None), atol=1)


def test_share_is_that_of_all_usable_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(500)], "doc_id long, quality int, toxic int")
    import zlib

    use = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    share = sum(i % 10 == 0 for i in use) / len(use)
    seen = {}
    monkeypatch.setattr(toxicity, "fitted", lambda sample, run: run(sample.toArrow()))
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, **rest: seen.update(rest, bad=toxic.mean()) or Network())
    fit(docs, labels, most_toxic=20, most_clean=20)
    assert abs(seen["share"] - share) < 1e-9 and seen["bad"] > 2 * share
