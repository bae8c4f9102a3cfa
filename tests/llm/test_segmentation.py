import math

import numpy as np
import pytest

from lexspan.llm.segmentation import MARK, Decoder, Sampler, Vocabulary, decode_segmentations, sample_segmentations
from lexspan.llm.textbytes import chunks

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(PATH)


def enumerate_all(vocab, text):
    """{ids: log-probability} of all segmentations of a text of known characters."""
    marked = MARK + text.replace(" ", MARK)
    pieces = {s.decode(): i for i, s in enumerate(vocab.surface) if s and i not in set(vocab.byte_ids.tolist())}
    units = [MARK + u for u in marked.split(MARK)[1:]]
    total = {(): 0.0}
    for unit in units:
        ways = {0: {(): 0.0}}
        for end in range(1, len(unit) + 1):
            ways[end] = {}
            for start in range(end):
                piece = pieces.get(unit[start:end])
                if piece is not None:
                    for ids, score in ways[start].items():
                        ways[end][(*ids, piece)] = score + vocab.score[piece]
        norm = math.log(sum(math.exp(s) for s in ways[len(unit)].values()))
        total = {(*a, *b): x + y - norm for a, x in total.items() for b, y in ways[len(unit)].items()}
    return total


def draw(vocab, text, k, key):
    import pyarrow as pa

    (_, _, raw, offsets), = chunks(pa.array([MARK + text.replace(" ", MARK)], pa.large_string()))
    sampler = Sampler(vocab, raw, offsets, np.array([key]), k)
    return [(tuple(sampler.ids(vocab, e).tolist()), p, v) for _, _, p, v, e in sampler.run()]


def test_all_segmentations_of_a_small_text(vocab):
    want = enumerate_all(vocab, "the cat")
    got = draw(vocab, "the cat", 10_000, 5)
    assert {g[0] for g in got} == set(want) and len(got) == len(want)
    for ids, p, _ in got:
        assert abs(p - want[ids]) < 1e-9
    values = [g[2] for g in got]
    assert values == sorted(values, reverse=True)


def test_draws_follow_the_distribution(vocab):
    want = enumerate_all(vocab, "under it")
    first, second = {}, {}
    rounds = 4000
    for key in range(rounds):
        a, b = draw(vocab, "under it", 2, key)
        assert a[0] != b[0]
        first[a[0]] = first.get(a[0], 0) + 1
        second[b[0]] = second.get(b[0], 0) + 1
    p = {i: math.exp(s) for i, s in want.items()}
    for ids, share in p.items():
        assert abs(first.get(ids, 0) / rounds - share) < 0.03
        later = sum(q * share / (1 - q) for other, q in p.items() if other != ids)
        assert abs(second.get(ids, 0) / rounds - later) < 0.03


def test_table(spark, vocab):
    rows = [(i, "some words of text  with spaces\n" * (i % 3) + f"row {i} 漢\U0001f600 naïve", "x") for i in range(60)]
    rows += [(100, None, ""), (101, "", ""), (102, " ", ""), (103, "a" * 3000, ""), (104, "word " * 8000, ""), (None, "null key", ""), (105, "▁ mark", "")]
    df = spark.createDataFrame(rows, "key long, text string, sample string")
    out = sample_segmentations(df.repartition(3), PATH, with_ids=True).collect()
    again = sample_segmentations(df.repartition(2), PATH, with_ids=True).collect()
    assert sorted((r.key or -1, r["sample"], r.ids_crc32) for r in out) == sorted((r.key or -1, r["sample"], r.ids_crc32) for r in again)
    by = {}
    for r in out:
        by.setdefault(r.key, []).append(r)
        assert r.round_trip or r.key == 105
        assert 0 <= r.inclusion <= 1
    assert len(by) == len(rows) and len(by[100]) == 1 and by[101][0].n_pieces == 0
    assert all(len({bytes(r.ids) for r in rs}) == len(rs) for rs in by.values())
    assert len(by[104]) == 3
    frame = spark.createDataFrame([(r.key, bytes(r.ids)) for r in out if r.key == 5], "key long, ids binary")
    assert {r.text for r in decode_segmentations(frame, PATH).collect()} == {rows[5][1]}
    assert Decoder(vocab)(np.array([], np.int64)) == b""
    assert sample_segmentations(df.limit(0), PATH).count() == 0


def test_results_do_not_depend_on_the_bytes_worked_on_at_once(spark, monkeypatch):
    from lexspan.llm import segmentation

    rows = spark.createDataFrame([(i, f"some words of row {i} " * (i % 4) + "漢字 é") for i in range(40)], "key long, text string").coalesce(1).toArrow()
    batch = rows.combine_chunks().to_batches()[0]

    def ids(limit):
        monkeypatch.setattr(segmentation, "CHUNK_BYTES", limit)
        found = list(segmentation._sample(PATH, 3, 0, 1.0, True)(iter([batch])))
        return len(found), sorted((k, s, i) for b in found for k, s, i in zip(*(b.column(c).to_pylist() for c in ("key", "sample", "ids")), strict=True))

    (few, want), (many, got) = ids(1 << 20), ids(64)
    assert few == 1 and many > 10 and got == want
