import numpy as np
import pytest

import corpus_pipeline
from lexspan.llm.toxicity import fit, toxicity_scores

pytest.importorskip("public_tokenizers")


def test_stages_take_effect(spark, tmp_path):
    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(800)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    rows = [(i, text(40) + (" zqxk vile zqxk" if i % 4 == 0 else ""), "en", f"s{i % 3}") for i in range(480)]
    rows = [(i, t + f" mail u{i}@mail.example.org" if i % 10 == 1 else t, x, s) for i, t, x, s in rows]
    copy = rows[1][1]
    rows += [(500, copy, "en", "s0"), (501, copy, "en", "s1"), (502, copy + " tail", "en", "s0"), (503, None, "en", None), (504, "", "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(480)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r.score for r in toxicity_scores(docs, fit(docs, labels)).collect()}

    state, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = state
        state = corpus_pipeline.staged(stage(spark, state, str(tmp_path)))
        assert state.columns == docs.columns, name
        kept[name] = {r.doc_id: r for r in state.collect()}
        assert len(kept[name]) == state.count() <= before.count()
    assert set(kept["toxicity"]) == {d for d, s in score.items() if s < 0.3}
    assert sum(i % 4 == 0 for i in kept["toxicity"] if i < 480) <= 8
    assert {1, 500, 501, 503, 504} & set(kept["exact dedup"]) == {501, 504}
    assert {1, 501, 502} & set(kept["n-gram Jaccard join"]) == {501}
    assert 504 in kept["n-gram Jaccard join"]
    for d, r in kept["PII"].items():
        assert "@" not in (r.text or "") and r.n_chars == len(r.text or "")
    assert "[EMAIL]" in kept["PII"][501].text

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(kept["PII"])
    lengths = {}
    for p in pieces:
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
        assert lengths[p.doc_id] <= p.doc_tokens
