import numpy as np

from lexspan.llm.quality_grades import fit, graded, train


def test_grades_on_held_out_rows(spark):
    rng = np.random.default_rng(6)
    vocab = ["".join(rng.choice(list("abcdefghijklm"), rng.integers(2, 8))) for _ in range(500)]
    rows = []
    for i in range(600):
        words = list(rng.choice(vocab, rng.integers(20, 120)))
        kind = i % 3
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), int(kind > 0), int(kind == 1)))
    odd = [(9000, None), (9001, ""), (9002, "word " * 30000), (None, "x")]
    docs = spark.createDataFrame([(r[0], r[1], 1) for r in rows] + [(*o, 1) for o in odd], "doc_id long, text string, n_words int").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")
    model = fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    out = {r.doc_id: r for r in graded(docs, model).collect()}
    assert len(out) == len(rows) + len(odd)
    held = [r for r in rows if r[0] % 2 == 0]
    poor = np.mean([out[r[0]].expected_grade for r in held if not r[2]])
    fine = np.mean([out[r[0]].expected_grade for r in held if r[2]])
    assert poor < 0.4 and fine > 1.2
    assert out[9001].n_words == 0 and all(0 <= r.tail_probability <= 1 for r in out.values())


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert graded(docs, fit(docs, labels)).count() == 1
    assert graded(docs.limit(0), train([], np.array([]))).count() == 0
