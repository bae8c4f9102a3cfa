import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lexspan.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, at string, t string"


def _h(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def _expected(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, _h(role, text), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members[p]) - 1) * words
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def _got(spark, tmp_path, rows, chunk=prefix_trie.CHUNK):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    turns = prefix_trie.rebuilt(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    return sorted(tuple(-1 if x is None else x for x in r) for r in prefix_trie.trie(turns, chunk).collect())


def _random(seed, longest=14, convs=70):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(140), convs):
        words = ["a", "b c", "", None, "d\x0b e\x1cf ü", " "] if c % 3 else ["a", "b c"]
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]) if c % 4 else "user", rng.choice(words), "x", "y", "z"))
    same = [(r[1:]) for r in rows if r[0] == rows[0][0]]
    rows += [(200 + i, *r) for i in range(30) for r in same]  # copies of one conversation
    rows += [rows[3], rows[3], (None, 1, "user", "nobody's", "", "", ""), (5000, 0, "user", "word " * 20000, "", "", "")]
    return rows


@pytest.mark.parametrize("chunk", [prefix_trie.CHUNK, 2])
def test_against_all_prefixes(spark, tmp_path, chunk):
    rows = _random(chunk)
    assert _got(spark, tmp_path, rows, chunk) == _expected(rows)


def test_one_turn_none_and_long(spark, tmp_path):
    assert _got(spark, tmp_path / "none", []) == []
    one = [(40, 3, "user", "only one", "", "", "")]
    assert _got(spark, tmp_path / "one", one) == _expected(one)
    long = [(60, i, "user", f"turn {i % 3}", "", "", "") for i in range(37)] + [(61, i, "user", f"turn {i % 3}", "", "", "") for i in range(33)]
    assert _got(spark, tmp_path / "long", long, 8) == _expected(long)


def test_sql_agrees(spark, tmp_path):
    import duckdb

    rows = _random(3)
    got = _got(spark, tmp_path, rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = sorted(tuple(-1 if x is None else x for x in r) for r in db.execute(prefix_trie.OP11_SQL).fetchall())
    assert got == want
