import hashlib
import zlib
from collections import defaultdict

import pytest

from lexspan.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _val(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _levels(digests):
    """All levels of a tree, leaves first."""
    out = [digests]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def _path(levels, at):
    path = []
    for level in levels[:-1]:
        low = at // 8 * 8
        path.append(("".join(level[low:at]), "".join(level[at + 1 : low + 8])))
        at //= 8
    return path


def _expected(rows):
    trees = defaultdict(list)
    for r in rows:
        leaf = H(*[_val(r[c]) for c in merkle.COLUMNS])
        text = r["text"]
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        trees[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, H(*[_val({**r, "text": text}[c]) for c in merkle.COLUMNS]), r["doc_id"]))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    built = {n: _levels([x[2] for x in sorted(trees[n], key=lambda x: x[:3])]) for n in names}
    top = _levels([built[n][-1][0] for n in names])
    out = []
    for i, n in enumerate(names):
        for at, (_, _, leaf, odd, doc) in enumerate(sorted(trees[n], key=lambda x: x[:3])):
            path = _path(built[n], at) + _path(top, i)
            folded = odd
            for left, right in path:
                folded = H(left, folded, right)
            out.append((doc, leaf, built[n][-1][0], top[-1][0], H(*[a + b for a, b in path]), folded, folded == top[-1][0]))
    return out


def _rows(sizes):
    rows, doc = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            doc += 7
            rows.append({"doc_id": doc, "source": f"s{doc % 3}" if doc % 5 else None, "lang": lang, "n_chars": doc * 3 if doc % 4 else None, "text": [f"Ünder {doc} ABC", "", None, "lower", "É up"][doc % 5]})
    return rows


def _run(spark, tmp_path, rows, extra=""):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame([[r[c] for c in merkle.COLUMNS] for r in rows], schema).repartition(3)
    if extra:
        df = df.selectExpr("*", *[f"'x' AS {c}" for c in extra.split()])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = merkle.op13_merkle_manifest(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in out.collect()]


def _key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("digits", [4, 1])
def test_trees_of_many_shapes(spark, tmp_path, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(merkle, "BLOCK", 8**digits)
    rows = _rows({"en": 300, None: 1, "de": 8, "fr": 9, "é": 65, "Z": 2, "": 1, **{f"x{i}": 1 for i in range(6)}})
    rows += [rows[0], rows[0], {**rows[5], "text": "the same id"}, {**rows[6], "doc_id": None}, {**rows[7], "text": "Long WORDS " * 50000}]
    got = _run(spark, tmp_path, rows, "tree rank size digest path above block d0 kids")
    assert sorted(got, key=_key) == sorted(_expected(rows), key=_key)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_one_row_and_none(spark, tmp_path):
    rows = _rows({"en": 1})
    assert _run(spark, tmp_path / "one", rows) == _expected(rows)
    assert _run(spark, tmp_path / "none", []) == []


def test_sql_agrees(spark, tmp_path):
    import duckdb

    rows = _rows({"en": 700, None: 3, "de": 64, "fr": 1})
    got = _run(spark, tmp_path, rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle.OP13_SQL})").fetchall()
    assert sorted(got) == sorted(want)
