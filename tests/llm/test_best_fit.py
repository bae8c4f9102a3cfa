import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspan.llm.best_fit import ByteEncoder, best_fit_decreasing, lower_bound, pack, place

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
_STATE = {}


def _tools():
    if not _STATE:
        from tokenizers import Tokenizer

        _STATE.update(tok=Tokenizer.from_file(PATH), own=ByteEncoder(PATH))
    return _STATE["tok"], _STATE["own"]


ALPHABET = st.sampled_from([" ", " ", "\n", "\t", "\x0b", "a", "b", "the", "'s", "'", "9", "!?", ".", ",", "ü", "日", " ", "　", "\x1c", "<|endoftext|>", "<|", "🙂"])


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=14).map("".join), min_size=1, max_size=6))
def test_ids_are_the_tokenizers(texts):
    tok, own = _tools()
    data = [t.encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    assert [x.tolist() for x in own.encode(raw, offsets)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def _least(sizes, window):
    """The smallest number of windows, by trying all ways."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= sizes[i]}:
            k = rooms.index(r)
            go(i + 1, [*rooms[:k], r - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, window - sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=200, deadline=None)
@given(st.integers(4, 24).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(1, w), min_size=1, max_size=9))))
def test_bound_and_packing_enclose_the_best(case):
    window, sizes = case[0], np.array(sorted(case[1], reverse=True))
    bins, offsets, free = best_fit_decreasing(sizes, window)
    assert lower_bound(sizes, window) <= _least(sizes.tolist(), window) <= len(free)
    assert (np.bincount(bins, weights=sizes) + free == window).all() and (free >= 0).all()
    for b in range(len(free)):
        assert offsets[bins == b].tolist() == (np.cumsum(sizes[bins == b]) - sizes[bins == b]).tolist()


def test_bound_beats_the_sum():
    assert lower_bound(np.array([60] * 10), 100) == 10
    assert lower_bound(np.array([51] * 6 + [27] * 6 + [26] * 6 + [23] * 12), 100) >= 9
    assert lower_bound(np.array([35] * 9), 100) == 5


def _checked(rows, out, window):
    tok, _ = _tools()
    want = sorted((r[0], [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in out:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert sorted(by_doc) == sorted({d for d, _ in want})
    for d, ids in want:
        copies = sum(x == d for x, _ in want)
        pieces = sorted(by_doc[d], key=lambda p: (p.start, p.sequence_id, p.offset))
        short = (len(ids) - 1) % window + 1
        starts = [0, *range(short, len(ids), window)]
        assert [(p.piece, p.start) for p in pieces] == [(k, a) for k, a in enumerate(starts) for _ in range(copies)]
        for p in pieces:
            part = ids[p.start : p.start + p.length]
            assert len(part) == p.length == (short if p.piece == 0 else window) and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return by_seq


def _docs(n, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(rng.choice(["alpha", "Übung", "it's", "x-1", "naïvé\n"], int(rng.integers(0, 60))))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "word " * 3000), (n + 4, "same"), (n + 4, "same")]


def test_pieces_and_sequences(spark):
    rows = _docs(150)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, part string, free int").repartition(3)
    one = _checked(rows, pack(df, PATH, window=64).collect(), 64)
    many = _checked(rows, pack(df, PATH, window=64, group_rows=10, exchanged=20, with_ids=True).collect(), 64)
    assert all(p.ids and len(p.ids) == 4 * p.length for ps in many.values() for p in ps)
    assert len(many) <= 1.05 * len(one)  # groups of ten pieces leave more room than large ones


def test_exchange_closes_gaps(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(20, 95, 1200).tolist()
    rows = [(i, 0, 0, n, 0, i) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, key long").repartition(3)
    count = lambda out: out.select("sequence_id").distinct().count()
    alone, swapped = place(df, window=128, group_rows=100, rounds=1), place(df, window=128, group_rows=100, exchanged=100)
    assert swapped.count() == len(rows) and swapped.groupBy("sequence_id").sum("length").where("`sum(length)` > 128").count() == 0
    whole = np.array(sorted(sizes, reverse=True))
    best = len(best_fit_decreasing(whole, 128)[2])  # in one group
    assert lower_bound(whole, 128) <= count(swapped) < count(alone)
    assert count(swapped) <= 1.02 * best


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
