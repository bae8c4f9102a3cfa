import numpy as np

from lexspan.llm.quality_rules import chunk_statistics
from lexspan.llm.textbytes import PrimeSums, eights, equal_spans, span_hash, span_ids


def thue_morse(turns):
    """Two strings that collide under every polynomial hash modulo a power of two."""
    a, b = "a", "b"
    for _ in range(turns):
        a, b = a + b, b + a
    return a, b


def chunk(*texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    return raw, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])


def test_equal_hashes_are_equal_bytes():
    a, b = thue_morse(11)
    raw, edges = chunk(a, b, a)
    starts, ends = edges[:-1], edges[1:]
    hashes = span_hash(raw, starts, ends)
    assert hashes[0] == hashes[2] != hashes[1]
    sums = PrimeSums(raw).hash(starts, ends)
    assert sums[0] == sums[2] != sums[1]
    assert span_ids(raw, starts, ends)[0].tolist() == [0, 1, 0]
    assert equal_spans(eights(raw), starts, eights(raw), starts[[0, 0, 0]], ends - starts).tolist() == [True, False, True]


def test_span_hash_depends_on_the_bytes_alone():
    rng = np.random.default_rng(1)
    words = ["x" * n for n in range(1, 40)] + ["".join(rng.choice(list("abÜ"), n)) for n in range(1, 60)] + ["a", "a\0"]
    raw, edges = chunk(*words)
    alone = [int(span_hash(*(lambda r, e: (r, e[:1], e[1:]))(*chunk(w)))[0]) for w in words]
    assert span_hash(raw, edges[:-1], edges[1:]).tolist() == alone
    assert len(set(alone)) == len(set(words))


def test_lines_that_collide_are_no_copies():
    a, b = thue_morse(11)
    raw, edges = chunk(f"{a}\n{b}\n{a}\n")
    assert chunk_statistics(raw, edges)["n_dup_lines"].tolist() == [1]
