"""Quotes in their places: registered queries over small tables, and what they send from task to task."""

import duckdb
from pyspark.sql import functions as F

from lexspan.operators import verify
from lexspan.plans import adapters
from lexspan.plans import queries as library
from lexspan.plans import review_queries  # noqa: F401  (it registers its queries)

WORDS = "supplier customer indemnify losses notice renewal escrow deposit payment invoice liability insurance audit delivery".split()


def _tables(spark, tmp_path, texts, items):
    """A folder of the tables that grid queries read."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")}).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def _both(spark, d, name):
    """(rows of the query, rows of its SQL)."""
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    got = library.QUERIES[name](spark, d)
    return sorted(map(tuple, got.collect())), sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({library.SQL[name]})").fetchall())


def test_long_quotes_are_located(spark, tmp_path):
    """A best sentence counts however long it is."""
    long = " ".join(f"{w} of the {w}{i}" for i in range(3) for w in WORDS)
    texts = [f"Short one here.\n{long}.\nAnother line about nothing at all.", f"{long}; {long}\n\n\n\n\n\nThe supplier sends a notice of renewal."]
    assert len(long) > 600
    got, want = _both(spark, _tables(spark, tmp_path, texts, ["supplier?", "supplier and notice", "escrow deposit"]), "g8_v4_located")
    assert got == want and {(r[0], r[1]) for r in got} == {(0, 1), (0, 2), (1, 1), (1, 2)}
    assert max(r[4] - r[3] for r in got) > 600


def _sent(df):
    """What each shuffle of a run sent: the columns of its input; one that is used again counts once."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            found.append([node.output().apply(i).name() for i in range(node.output().size())])
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_texts_meet_their_quotes_once(spark, tmp_path):
    """A text is dealt for the answers (both reads are the same rows) and sent to its quotes; passages, pages and words are cut where it lies."""
    texts = [f"The {w} one.\nThe notice of the {w} is due – “now” and ﬁnally.\n\nNothing." for w in WORDS]
    d = _tables(spark, tmp_path, texts, [f"notice of {w}" for w in WORDS])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got, want = _both(spark, d, "g8_v4_located")
        sent = _sent(library.QUERIES["g8_v4_located"](spark, d))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and got
    assert not any(c in ("words", "n", "line") or c.startswith("pythonUDF") for columns in sent for c in columns), sent
    assert len(_whole(sent)) == 2, sent


def _whole(sent):
    """The shuffles of texts of documents or pages."""
    return [columns for columns in sent if {"doc_id", "document_id"} & set(columns) and {"text", "_text", "_whole"} & set(columns)]


def test_a_batch_reads_its_answers_once(spark, tmp_path):
    """Lines of results are written where the answers lie and met by their cells once: texts are shuffled for the answers and for the quotes."""
    texts = [f"The {w} one.\nThe notice of the {w} is due – “now” and ﬁnally.\n\nNothing." for w in WORDS * 2]
    d = _tables(spark, tmp_path, texts, [f"notice of {w}" for w in WORDS])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got, want = _both(spark, d, "st6_batch_cells")
        sent = _sent(library.QUERIES["st6_batch_cells"](spark, d))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and {r[2] for r in got} == {"done", "failed"} and len({r[3] for r in got}) > 4
    assert len(_whole(sent)) == 2, sent


def test_quotes_are_proved_from_offsets(spark):
    """Passages without their text; the owner of a quote found elsewhere is the first passage that holds its beginning."""
    text = "One two three. Four five six. Seven eight nine."
    documents = spark.createDataFrame([(1, text), (2, None)], "document_id long, text string")
    chunks = spark.createDataFrame([(1, 0, 0, 14), (1, 2, 15, 29), (1, 1, 10, 29), (2, 0, 0, None)], "document_id long, ordinal int, char_start int, char_end int")
    quotes = [("named", 1, 2, "Four  five"), ("other", 1, 0, "five six."), ("none", 1, 7, "Seven eight"), ("owned", 1, 1, "Seven eight nine"), ("close", 1, 0, "One two thrae."), ("empty", 2, 0, "One two"), ("lost", 3, 0, "One two"), ("unnamed", 1, 7, "Fuor five six now")]
    rows = spark.createDataFrame(quotes, "quote_id string, document_id long, ordinal int, quote string")
    got = {r.quote_id: (r.match_kind, r.ordinal, text[r.char_start : r.char_end]) for r in verify.verify_quotes(rows, chunks, documents).collect()}
    assert got == {"named": ("exact", 2, "Four five"), "other": ("relocated", 1, "five six."), "none": ("relocated", None, "Seven eight"), "owned": ("relocated", None, "Seven eight nine"), "close": ("fuzzy", 0, "One two three.")}


def test_boxes_of_quotes_over_pages(spark):
    """Stored words and words that follow from the text give the same pages and boxes."""
    pages = spark.createDataFrame([(1, 1, 0, "ab cd"), (1, 2, 6, "ef  gh"), (1, 3, 13, "")], "document_id long, page_number int, char_offset int, text string")
    documents = spark.createDataFrame([(1, "ab cd\nef  gh\n"), (2, "x y")], "document_id long, text string")
    found = spark.createDataFrame([("a", 1, 0, 3, 8, "exact", 1.0), ("b", 1, 0, 8, 10, "exact", 1.0), ("c", 2, None, 0, 3, "relocated", 1.0)], "quote_id string, document_id long, ordinal int, char_start int, char_end int, match_kind string, similarity double")
    stored = verify.located(found, documents, pages.withColumn("words", adapters.page_words(F.col("text"))))
    derived = verify.located(found, documents, pages, adapters.page_words)
    for rows in (stored, derived):
        got = {r.quote_id: (r.page, r.quoted_text, r.bboxes) for r in rows.collect()}
        assert got == {"a": (1, "cd\nef", {1: [[3.0, 0.0, 5.0, 1.0]], 2: [[0.0, 0.0, 2.0, 1.0]]}), "b": (2, "  ", None), "c": (None, "x y", None)}
