import hashlib

import numpy as np
import pandas as pd

from lexspan.functions import helpers
from lexspan.operators import ingest


def _pages(spark):
    rows = [(1, 1, "First clause stands here.\n\nSecond clause follows it."), (1, 2, "Third clause on another page."), (2, 1, "Gardens and rivers."), (3, 1, "   ")]
    return spark.createDataFrame(rows, "document_id long, page_number int, text string")


def _embedders():
    """Defined inside a function, so that tasks get them by value."""

    def never(texts):
        raise AssertionError("nothing is left to embed")

    def short(texts):
        return pd.Series(list(helpers.hash_vectors(8)(texts))[:-1])

    def odd(texts):
        return pd.Series([None if "Gardens" in x else np.array([np.nan, np.inf, 1.0, 0, 0, 0, 0, 0]) for x in texts])

    return never, short, odd


_never, _short, _odd = _embedders()


def _by_id(rows):
    return {r.document_id: r for r in rows.collect()}


def test_vectors_status_and_resume(spark):
    documents, chunks = ingest.ingest(_pages(spark), embedder=helpers.hash_vectors(8), dim=8, batch=1)
    first = _by_id(documents)
    assert {k: v.status for k, v in first.items()} == {1: "ready", 2: "ready", 3: "failed"}
    assert all(r.n_vectors == r.n_chunks > 0 for k, r in first.items() if k != 3)
    stored = spark.createDataFrame(chunks.collect(), chunks.schema)
    again, same = ingest.ingest(_pages(spark), embedder=_never, dim=8, stored=stored)
    assert {k: v.status for k, v in _by_id(again).items()} == {1: "ready", 2: "ready", 3: "failed"}
    key = lambda r: (r.document_id, r.ordinal)
    assert sorted(map(key, same.collect())) == sorted(map(key, chunks.collect()))
    # A chunk without a vector, and one whose text has changed, are embedded again.
    lost, _ = ingest.ingest(_pages(spark), embedder=_never, dim=8, stored=stored.where("document_id = 1"))
    assert _by_id(lost)[2].status == "failed" and "nothing is left" in _by_id(lost)[2].error and _by_id(lost)[1].status == "ready"


def test_wrong_vectors_fail_their_documents(spark):
    short = _by_id(ingest.ingest(_pages(spark), embedder=_short, dim=8)[0])
    assert short[1].status == "failed" and "vectors for" in short[1].error
    odd_documents, odd_chunks = ingest.ingest(_pages(spark), embedder=_odd, dim=8)
    odd = _by_id(odd_documents)
    assert odd[1].status == "ready" and odd[2].error == "vector of size 0 instead of 8"
    assert all(r.embedding == [0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0] for r in odd_chunks.collect() if r.document_id == 1)
    plain = _by_id(ingest.ingest(_pages(spark))[0])
    assert plain[1].status == "ready"


def test_hash_vectors():
    v = helpers.hash_vectors(64)(pd.Series(["some text", None]))
    block, numbers = hashlib.sha256(b"some text").digest(), []
    while len(numbers) < 64:
        numbers += [int.from_bytes(block[i : i + 4], "little") / 2**31 - 1 for i in range(0, 32, 4)]
        block = hashlib.sha256(block).digest()
    want = np.array(numbers) / np.linalg.norm(numbers)
    assert np.allclose(v[0], want, atol=1e-6) and abs(np.linalg.norm(v[1]) - 1) < 1e-5 and len(v[1]) == 64
