import hashlib
from collections import Counter

import numpy as np

from lexspan.llm.repeats import RunIndex, mark_windows, remove_repeats, suffix_order


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    piece = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    shared = [piece(n) for n in (15, 25, 40, 90)]
    base = piece(120)
    texts = []
    for _ in range(80):
        kind = rng.integers(5)
        if kind == 0:
            texts.append(piece(rng.integers(0, 150)))
        elif kind == 1:
            texts.append(piece(rng.integers(0, 30)) + str(rng.choice(shared)) + piece(rng.integers(0, 30)))
        elif kind == 2:
            at = rng.integers(0, 120)
            texts.append(base[:at] + "X" + base[at:])
        elif kind == 3:
            texts.append(base)
        else:
            texts.append(str(rng.choice(["ab", "a", "abc"])) * rng.integers(1, 40))
    return [*texts, None, "", "z" * 5000, piece(30) * 3]


def test_suffix_order_and_statistics():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 200):
        text = rng.integers(97, 99, n).astype(np.uint8)
        data = text.tobytes()
        assert suffix_order(text).tolist() == sorted(range(n), key=lambda i: data[i:])
        want = [max((next((k for k in range(n) if i + k >= n or j + k >= n or data[i + k] != data[j + k]), n) for j in range(n) if j != i), default=0) for i in range(n)]
        assert RunIndex(text, n).matching_statistics().tolist() == want


def test_windows_of_segments():
    marks = mark_windows([b"abcdefgh", b"xxcdefyy", b"cdef"], 4)
    assert [m.tolist() for m in marks] == [[False, False, True, False, False], [False, False, True, False, False], [True]]


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(3)
        got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(docs, length=20, gram=6).collect()}
        assert got == dict(enumerate(brute(texts, 20)))


def test_frequent_passages(spark, monkeypatch):
    from lexspan.llm import repeats

    monkeypatch.setattr(repeats, "INDEX_BYTES", 500)
    rng = np.random.default_rng(5)
    piece = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage = piece(60)
    texts = [piece(30) + passage + piece(30) for _ in range(300)] + ["q" * 100] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(docs, length=20, gram=6).collect()}
    assert got == dict(enumerate(brute(texts, 20)))


def test_repeated_rows_and_empty_table(spark):
    long = "the same text " * 20
    docs = spark.createDataFrame([(1, long), (1, long), (2, "short")], "doc_id long, text string")
    got = sorted(tuple(r) for r in remove_repeats(docs).collect())
    none = hashlib.sha256(b"").hexdigest()
    assert got == [(1, 280, 280, 1, none), (1, 280, 280, 1, none), (2, 5, 0, 0, hashlib.sha256(b"short").hexdigest())]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_equal_keys_of_different_documents(spark, monkeypatch):
    """The hash of a row alone does not decide whose cuts are whose."""
    import lexspan.llm.repeats as repeats

    monkeypatch.setattr(repeats.F, "xxhash64", lambda *columns: repeats.F.lit(7).cast("long"))
    texts = ["once " + "shared words " * 3, "shared words " * 3 + "twice", "alone", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:3])] + [(None, texts[3])], "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, length=12, gram=4).collect()}
    assert [got[i] for i in (0, 1, 2, None)] == brute(texts, 12)
