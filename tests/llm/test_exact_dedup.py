import hashlib

from pyspark.sql import functions as F

from lexspan.llm.exact_dedup import drop_exact_copies, exact_groups


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        ids = groups[t or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def corpus():
    start = "the same beginning of forty characters or more, "
    rows = [(i, start + str(i % 7)) for i in range(60)] + [(100 + i, "hot") for i in range(400)]
    rows += [(600, None), (601, ""), (602, " "), (603, "long " * 100_000), (604, "long " * 100_000), (605, "long " * 100_000 + "x"), (606, "É"), (607, "E\u0301")]
    return rows


def test_against_brute_force(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(5)
    assert rows_of(exact_groups(docs, ranges=3)) == brute(corpus())


def test_smallest_stays(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    kept = {r.doc_id for r in exact_groups(docs, largest=False).where("kept").collect()}
    assert {0, 100, 600, 602, 603, 605, 606, 607} <= kept and not {601, 604, 101} & kept


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = exact_groups(docs).collect()
    assert sum(r.kept for r in got if r.text_sha256 == hashlib.sha256(b"a").hexdigest()) == 1
    assert {r.group_size for r in got if r.text_sha256 == hashlib.sha256(b"a").hexdigest()} == {3}
    assert drop_exact_copies(docs).count() == 2
    assert exact_groups(docs.limit(0)).count() == 0 and drop_exact_copies(docs.limit(0)).count() == 0


def test_columns_with_clashing_names_stay(spark):
    docs = spark.createDataFrame([(i, "t", "mine") for i in range(5)], "doc_id long, text string, kept string")
    docs = docs.withColumns({"_mark": F.lit(1), "_content": F.lit(2), "_salt": F.lit(3), "_first": F.lit(4), "keep_id": F.lit(5), "group_size": F.lit(6)})
    out = drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert [tuple(r) for r in out.collect()] == [(4, "t", "mine", 1, 2, 3, 4, 5, 6)]
