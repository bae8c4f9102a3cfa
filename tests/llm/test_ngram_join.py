import re

import numpy as np
import pyarrow as pa

from lexspan.llm import ngram_join
from lexspan.llm.ngram_join import ngram_components, one_of_each_group

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = {}
    for d, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def _compare(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_shingles string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(df, **options).collect()}
    assert got == brute(rows)
    return got


def corpus(seed, count, near):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(300)]
    common = list(rng.choice(vocab, 30))
    rows = []
    base = list(rng.choice(vocab, 60))
    for d in range(count):
        kind = rng.integers(4)
        if kind == 0:
            w = list(rng.choice(vocab, rng.integers(1, 80)))
        elif kind == 1 or d < near:
            w = list(base)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(len(w))] = str(rng.choice(vocab))
        elif kind == 2:
            w = common + list(rng.choice(vocab, rng.integers(0, 25)))
        else:
            w = list(rng.choice(vocab[:2], rng.integers(3, 12)))
        text = " ".join(w)
        rows.append((d, text.upper() if rng.random() < 0.1 else text))
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = corpus(1, 150, 60) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "one two"), (1004, "ONE\ttwo"), (1005, "two one"), (1006, "é\xa0a b c d e"), (1007, "long " * 5000)]
    _compare(spark, rows)


def test_long_lists(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FULL", 5)
    monkeypatch.setattr(ngram_join, "NEAR", 1)
    _compare(spark, corpus(2, 90, 40))


def test_hot_list_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FULL", 4)
    monkeypatch.setattr(ngram_join, "NEAR", 1)
    _compare(spark, corpus(3, 160, 110), hot=6)


def test_sets_with_one_key_are_told_apart(spark):
    _compare(spark, corpus(4, 60, 20), key_bits=3)


def test_repeated_rows_and_empty_table(spark):
    got = [tuple(r) for r in ngram_components(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")).collect()]
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1)] or sorted(got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_components(empty).count() == 0
    kept = one_of_each_group(spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None), (4, None)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_outlines_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for size in (1, 2, 5, 9, 40, 700, 3000):
        pool = np.unique(rng.integers(0, 2**63, 3 * size + 9, dtype=np.uint64) * np.uint64(2))
        rng.shuffle(pool)
        if size == 700:
            pool[:400] >>= np.uint64(30)  # more than 255 in one range
        for kept in (0.5, 0.74, 0.8, 0.86, 1.0):
            x, y = np.sort(pool[:size]), np.sort(np.concatenate([pool[: int(kept * size)], pool[size : size + int((1 - kept) * size) + 1]]))
            sizes = np.array([len(x), len(y)])
            counts = [np.frombuffer(o, np.uint8).astype(np.int64) for o in ngram_join.outlines(np.concatenate([x, y]), sizes).to_pylist()]
            counts = [np.where(c == 255, n, c) for c, n in zip(counts, sizes, strict=True)]
            shared = len(np.intersect1d(x, y))
            if 100 * shared >= 75 * (len(x) + len(y) - shared):
                assert ngram_join.may_link(*counts, len(x) + len(y))
            elif kept == 0.5 and size == 3000:
                assert not ngram_join.may_link(*counts, len(x) + len(y))


def test_a_long_list_gives_a_few_pairs_a_node():
    """Three hundred near copies: each meets an unchanged one and BEST others, not all of the next NEAR."""
    rng, size = np.random.default_rng(6), 300
    shared = [[m for m in range(40) if m == 0 or rng.random() < 0.95] for i in range(size)]
    columns = {"shingle": np.zeros(size, np.int64), "part": np.zeros(size, np.int32), "node": np.arange(1, size + 1), "n": np.full(size, 40), "asked": np.ones(size, np.int8), "rest": np.zeros(size, np.int32)}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()} | {"longs": pa.array(shared, pa.list_(pa.int64())), "shorts": pa.array([[]] * size, pa.list_(pa.int64()))})
    pairs = {p for out in ngram_join._long_pairs(ngram_join.NEAR, ngram_join.BEST)(iter([batch])) for p in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)}
    assert len(pairs) <= (ngram_join.BEST + 1) * size
    assert np.bincount(np.array(sorted(pairs)).ravel()).max() >= 0.8 * size  # the first of those without a change


def test_long_lists_carry_long_lists_only(spark, monkeypatch):
    """The disk of a long list follows its own members: what they have in short lists stays there and is counted there."""
    seen, by_list = [], ngram_join._by_list
    monkeypatch.setattr(ngram_join, "FULL", 8)
    monkeypatch.setattr(ngram_join, "_by_list", lambda df: seen.append(df) or by_list(df))
    _compare(spark, corpus(7, 120, 60))
    rows = [df for df in seen if "longs" in df.columns]
    assert rows and all("shorts" not in df.columns for df in rows)
    long = {r.shingle for r in rows[0].select("shingle").distinct().collect()}
    assert {m for r in rows[0].select("longs").collect() for m in r.longs} <= long
