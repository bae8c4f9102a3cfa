from pyspark.sql import functions as F

from lexspan.operators import assistant, evaluate, grid, listing, playbook, retrieve, verify
from lexspan.sources import files
from lexspan.streaming import jobs

TEXT = "The Supplier shall indemnify the Customer against all losses. Either party may terminate on thirty days notice. Nothing else is said here at all."


def documents(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "Entirely different words about gardens and rivers, nothing more.")], "document_id long, text string")
    chunks = docs.select("document_id", F.lit(0).alias("ordinal"), F.lit(0).alias("char_start"), F.char_length("text").alias("char_end"), "text", F.lit("").alias("section_path"))
    return docs, chunks


def test_quotes(spark):
    docs, chunks = documents(spark)
    rows = [
        ("exact", 1, 0, "The Supplier shall  indemnify\nthe Customer"), ("moved", 1, 9, "terminate on thirty days"), ("close", 1, 0, "Either party may terminate on thirty deys notise."),
        ("invented", 1, 0, "The Customer shall pay a penalty of ten per cent."), ("wrong", 2, 0, "Either party may terminate on thirty deys notice."), ("short", 1, 0, "a"),
    ]
    found = {r.quote_id: r for r in verify.with_source(verify.verify_quotes(spark.createDataFrame(rows, "quote_id string, document_id long, ordinal int, quote string"), chunks, docs), docs).collect()}
    assert {k: v.match_kind for k, v in found.items()} == {"exact": "exact", "moved": "relocated", "close": "fuzzy"}
    assert found["exact"].quoted_text == "The Supplier shall indemnify the Customer" and found["moved"].quoted_text == "terminate on thirty days"


def test_grid(spark):
    docs, chunks = documents(spark)
    columns = spark.createDataFrame([(1, k, q, "text", [], k) for k, q in ((1, "Must the supplier indemnify the customer?"), (2, "What is the governing law?"))], "review_id int, column_id long, question string, output_type string, enum_options array<string>, ordinal_no long")
    answers = grid.extractive_answers(chunks.withColumn("review_id", F.lit(1)), columns, "review_id").collect()
    assert [(a.document_id, a.column_id, a.confidence) for a in answers] == [(1, 1, "high")]
    seven = spark.createDataFrame([(1, i, i) for i in range(7)], "review_id int, column_id long, ordinal long")
    targets = grid.group_columns(grid.grid_targets(docs.withColumn("review_id", F.lit(1)), seven), 6)
    assert targets.count() == 14 and sorted({(r.group_no, r.label) for r in targets.collect()})[-1] == (1, "q1")
    one, all_ = grid.cache_split(targets.withColumn("cache_key", F.lit("k")), spark.createDataFrame([("k", 1)], "cache_key string, answer int"))
    assert one.count() == 14 and all_.count() == 0


def test_retrieval(spark):
    _, chunks = documents(spark)
    asked = spark.createDataFrame([(1, "terminate notice"), (2, "zebra")], "question_id long, question string")
    hits = retrieve.lexical_topk(chunks, asked, 3)
    assert [(r.question_id, r.document_id, r.positions) for r in hits.collect()] == [(1, 1, 2)]
    assert [r.question_id for r in retrieve.unanswerable(asked, hits).collect()] == [2]
    ctx = {(r.document_id, r.mode) for r in retrieve.build_context(chunks, asked, limit=20, k=1).collect()}
    assert ctx == {(1, "retrieval"), (2, "full")}


def test_playbook_and_threads(spark):
    _, chunks = documents(spark)
    rules = spark.createDataFrame([(1, 1, 0, "Indemnity", "The Supplier shall indemnify the Customer", "mutual indemnity", "no indemnity"), (1, 2, 1, "Escrow", "Source code escrow deposit", "", "")], "playbook_id int, rule_id long, ordinal_no int, topic string, preferred_position string, fallback_position string, unacceptable_position string")
    found = playbook.playbook_findings(chunks.where("document_id = 1").withColumn("playbook_id", F.lit(1)), rules, "playbook_id")
    assert {r.rule_id: (r.matched_position, r.severity) for r in found.collect()} == {1: ("preferred", "none"), 2: ("not_addressed", "medium")}
    said = spark.createDataFrame([("m", "A [1]. B [2].", False)], "message_id string, content string, insufficient boolean")
    cited = spark.createDataFrame([("m", 1, "x"), ("m", 2, "y")], "message_id string, marker int, quote_id string")
    out = assistant.verify_messages(said, cited, spark.createDataFrame([("x",)], "quote_id string")).first()
    assert out.content == "A [1]. B." and not out.verified


def test_evaluation(spark):
    rows = [("a", "text", "done", False, "the laws of Englnd and Wales", "England and Wales"), ("b", "text", "done", False, "125% of the Fees", "125"), ("c", "text", "done", False, "something", "not present"), ("d", "text", "done", True, "", "not present"), ("e", "text", "failed", False, "x", "x"), ("f", "text", "done", True, "", "yes"), ("g", "text", "done", False, "Englnd and Wales", "England and Wales")]
    cells = spark.createDataFrame([(1, r[0], *r[1:5], True) for r in rows], "document_id int, key string, output_type string, status string, not_found boolean, value_text string, verified boolean")
    cells = cells.withColumn("value_json", F.expr("CAST(NULL AS struct<bool_value:boolean,date_value:date,amount:double,currency:string,text_value:string>)"))
    golden = spark.createDataFrame([(1, r[0], r[5]) for r in rows], "document_id int, key string, expected string")
    judged = {r.key: (r.correct, r.hallucinated) for r in evaluate.judge(cells, golden).collect()}
    assert judged == {"a": (False, False), "b": (True, False), "c": (False, True), "d": (True, False), "e": (False, False), "f": (False, False), "g": (True, False)}
    values = spark.createDataFrame([(float(v),) for v in (10, 20, 30, 40, 50)], "v double")
    assert tuple(evaluate.nearest_rank(values, "v", [50, 95]).first()) == (30.0, 50.0)


def test_listing_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "m", "h"), (2, "m", "h"), (3, "n", "h")], "document_id long, matter_id string, sha256 string")
    assert [(r.document_id, r.duplicate) for r in listing.dedupe_documents(docs, ["matter_id"], ["document_id"]).orderBy("document_id").collect()] == [(1, False), (2, True), (3, False)]
    path = f"file://{tmp_path}/t"
    files.replace_documents(docs.select("document_id", "matter_id"), path)
    files.replace_documents(spark.createDataFrame([(2, "z"), (9, "y")], "document_id long, matter_id string"), path)
    assert sorted((r.document_id, r.matter_id) for r in files.read_documents(spark, path).collect()) == [(1, "m"), (2, "z"), (3, "n"), (9, "y")]
    files.export_grid_csv(docs.select("document_id", "matter_id").coalesce(1), f"file://{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("part-*.csv")).read_text(encoding="utf-8")
    assert text.startswith("﻿document_id,matter_id\n1,m\n")


def test_streams(spark, tmp_path):
    source = f"{tmp_path}/events"
    schema = "user long, event_time timestamp, status string, demo boolean"
    spark.sql("SELECT 1L AS user, timestamp'2024-01-01 00:00:05' AS event_time, 'new' AS status, true AS demo UNION ALL SELECT 1L, timestamp'2024-01-01 00:00:01', 'old', false").write.mode("append").parquet(source)
    table = f"file://{tmp_path}/state"
    jobs.cell_state_stream(spark.readStream.schema(schema).parquet(source), table, f"{tmp_path}/c", "user")
    spark.sql("SELECT 1L AS user, timestamp'2024-01-01 00:00:03' AS event_time, 'late' AS status, false AS demo UNION ALL SELECT 2L, timestamp'2024-01-01 00:00:03', 'x', false").write.mode("append").parquet(source)
    jobs.cell_state_stream(spark.readStream.schema(schema).parquet(source), table, f"{tmp_path}/c", "user")
    assert sorted((r.user, r.status, r.demo) for r in files.read_documents(spark, table, "_key").collect()) == [(1, "new", True), (2, "x", False)]


def test_written_dates_in_cells(spark):
    from lexspan.operators import grid

    answers = spark.createDataFrame([(7, 1, 1, "date", "1 March 2025", False), (7, 1, 2, "date", "2024-05-06", False), (7, 1, 3, "text", "1 March", False)], "review_id int, document_id int, column_id int, output_type string, value string, not_found boolean")
    answers = answers.withColumn("enum_options", F.array().cast("array<string>"))
    none = spark.createDataFrame([], "review_id int, document_id int, column_id int")
    got = {r.column_id: str(r.value_json.date_value) for r in grid.apply_answers(answers, none, default_date="2000-01-01").collect()}
    assert got == {1: "2025-03-01", 2: "2024-05-06", 3: "None"}
    assert {r.column_id: str(r.value_json.date_value) for r in grid.apply_answers(answers, none).collect()}[1] == "None"


def test_pages_without_words_are_scanned(spark):
    from lexspan.operators import ingest

    words = spark.createDataFrame([(1, 1, "x" * 200)], "document_id int, page_number int, token string")
    pages = spark.createDataFrame([(1, 1), (1, 2)], "document_id int, page_number int")
    assert {r.page_number: (r.is_ocr, r.document_is_ocr) for r in ingest.flag_scanned(words, pages).collect()} == {1: (False, True), 2: (True, True)}
