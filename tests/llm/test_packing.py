import zlib

import numpy as np
import pytest

from lexspan.llm.packing import RoundRobin, WordEncoder, pack

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def _check(spark, rows, window=64):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, start string").repartition(3)
    out = pack(df, PATH, window=window).collect()
    want = {r[0]: [*tok.encode(r[2] or "", add_special_tokens=False).ids, 2] for r in rows}
    by_doc, by_seq = {}, {}
    for p in out:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(want)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(want[d])
            assert p.ids_crc32 == zlib.crc32(np.array(want[d][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want[d])
    sizes = []
    for s in sorted(by_seq):
        at = 0
        for p in sorted(by_seq[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert all(n == window for n in sizes[:-1]) and 0 < sizes[-1] <= window
    return by_seq


def test_mixed_sources_fill_every_window(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"s{min(i % 7, 3)}" if i % 11 else None, " ".join(rng.choice(["alpha", "Übung", "it's", "x-1", "<|endoftext|>", "42", "naïvé"], rng.integers(0, 90))), "clash") for i in range(120)]
    rows += [(200, "s0", None, ""), (201, "s0", "", ""), (202, "s1", " \n\t ", ""), (203, "s2", "word " * 3000, "")]
    by_seq = _check(spark, rows)
    assert len(by_seq) > 50


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert pack(empty, PATH).count() == 0
    _check(spark, [(1, None, None, None)])


@pytest.mark.parametrize("kind", ["equal", "lognormal", "ones", "giant"])
@pytest.mark.parametrize("queues", [1, 2, 33, 150, 5000])
def test_deficits_are_carried(kind, queues):
    rng = np.random.default_rng(queues)
    totals = {"equal": [251] * queues, "lognormal": (1 + rng.lognormal(3, 2, queues)).astype(int).tolist(), "ones": [1] * queues, "giant": [10**6, *[7] * (queues - 1)]}[kind]
    plan = RoundRobin(totals, 64)
    w = np.unique(np.linspace(0, plan.windows, 400).astype(int)) if plan.windows > 400 else np.arange(plan.windows + 1)
    for part in (w, np.arange(min(plan.windows, 50) + 1)):
        at = plan.delivered(part)
        assert (np.diff(at, axis=1) >= 0).all() and (at >= 0).all() and (at <= plan.totals[:, None]).all()
        assert (at.sum(axis=0) == np.minimum(part * 64, plan.total)).all()
        share = plan.totals[:, None] * (at.sum(axis=0) / plan.total)[None, :]
        assert np.abs(at - share).max() <= 1 + queues / plan.total * plan.totals.max()
    assert (plan.delivered(np.array([plan.windows]))[:, 0] == totals).all()


def test_many_equal_sources(spark):
    rows = [(i, f"s{i % 150}", f"word {i} " * 10, "x") for i in range(900)] + [(900, "s3", "word 3 " * 10, ""), (900, "s3", "word 3 " * 10, "")][:1]
    by_seq = _check(spark, rows, window=256)
    sources = {i: r[1] for i, r in enumerate(rows)}
    assert min(len({sources[p.doc_id] for p in ps}) for s, ps in by_seq.items() if s < max(by_seq)) == 150


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="fold case"):
        WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
