import json

from pyspark.sql import functions as F

from lexspan.operators import assistant, grid, ingest, listing
from lexspan.sources import files
from lexspan.streaming import jobs

CELLS = "review_id long, document_id long, column_id long"


def _line(custom, status=200, text=None):
    body = {"model": "m", "output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": p} for p in (text or "")]}]}
    return json.dumps({"custom_id": custom, "response": {"status_code": status, "body": body}})


def test_batch_results_become_cells(spark):
    answer = lambda label, value: {"column_id": label, "value": value, "quotes": [{"chunk_id": "c0", "text": value}], "confidence": "high", "not_found": False}
    whole = json.dumps({"answers": [answer("q1", "first"), answer("q1", "last"), answer("q9", "stray")]})
    lines = [_line("a", text=[whole[:9], whole[9:]]), _line("b", 500), _line("c", text=["no JSON"]), "", "  ", "broken {", _line("e", text=[whole])]
    results = files.parse_answers(files.read_batch_output(spark.createDataFrame([(x,) for x in lines], "value string"), spark.createDataFrame([('{"custom_id":"e","error":{"code":"boom"}}',)], "value string")))
    plan = spark.createDataFrame([(1, "a", 10, [7, 8]), (1, "b", 11, [7]), (1, "c", 12, [7]), (1, "d", 13, [7, 8]), (1, "e", 14, [7]), (2, "x", 10, [9])], "run_id long, custom_id string, document_id long, column_ids array<long>")
    failed = spark.createDataFrame([(2, "expired")], "run_id long, detail string")
    rows = jobs.batch_answers(plan, results, failed)
    got = {(r.run_id, r.document_id, r.column_id): (r.status, r.error, r.value) for r in rows.collect()}
    assert got == {
        (1, 10, 7): ("done", None, "last"), (1, 10, 8): ("failed", jobs.NO_ANSWER, None), (1, 11, 7): ("failed", "status 500", None), (1, 12, 7): ("failed", "unparseable output", None),
        (1, 13, 7): ("failed", jobs.MISSING, None), (1, 13, 8): ("failed", jobs.MISSING, None), (1, 14, 7): ("failed", '{"code":"boom"}', None), (2, 10, 9): ("failed", "batch expired", None),
    }
    runs = {r.run_id: (r.total_cells, r.done_cells, r.status, r.error) for r in jobs.batch_runs(rows, failed).collect()}
    assert runs == {1: (7, 2, "done", None), 2: (1, 0, "failed", "expired")}


def test_cells_fail_and_come_from_the_cache(spark):
    rows = spark.createDataFrame([(1, 1, 1, "yes it is", False, "done", None, True), (1, 2, 1, "lost", False, "done", None, None), (1, 3, 1, None, True, "done", None, None), (1, 4, 1, "x", False, "failed", "why", None)], f"{CELLS}, value string, not_found boolean, status string, error string, from_cache boolean")
    rows = rows.withColumns({"output_type": F.lit("text"), "enum_options": F.array().cast("array<string>")})
    documents = spark.createDataFrame([(1, "ready"), (2, "parsing"), (3, "ready"), (4, "ready")], "document_id long, status string")
    held = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 4, 1)], CELLS)
    cells = {r.document_id: r for r in grid.apply_answers(grid.fail_unready(rows, documents), held).collect()}
    assert [(cells[i].status, cells[i].error, cells[i].verified, cells[i].value_text, cells[i].from_cache) for i in (1, 2, 3, 4)] == [
        ("done", None, True, "yes it is", True), ("failed", "document is parsing, not ready", False, "", False), ("done", None, True, "", False), ("failed", "why", False, "", False),
    ]


def test_a_run_resets_its_cells(spark):
    old = spark.createDataFrame([(1, 1, 1, "done", None, "v"), (1, 1, 2, "failed", "why", "w"), (1, 2, 1, "done", None, "x")], f"{CELLS}, status string, error string, value_text string")
    targets = spark.createDataFrame([(1, 1, 2), (1, 3, 1)], CELLS)
    got = {(r.document_id, r.column_id): (r.status, r.error, r.value_text) for r in grid.reset_cells(old, targets).collect()}
    assert got == {(1, 1): ("done", None, "v"), (1, 2): ("pending", None, "w"), (2, 1): ("done", None, "x"), (3, 1): ("pending", None, None)}


def test_review_detail(spark):
    rows = spark.createDataFrame([(1, 20, 1), (1, 10, 2), (1, 99, 3), (2, 10, 1)], "review_id long, document_id long, row_order int")
    documents = spark.createDataFrame([(10, "ready", 3), (20, "failed", 0)], "document_id long, status string, page_count int")
    columns = spark.createDataFrame([(1, 5, 1, "b?"), (1, 4, 2, "a?")], "review_id long, column_id long, ordinal int, question string")
    cells = spark.createDataFrame([(1, 10, 4, "done", "real"), (1, 20, 5, "failed", None)], f"{CELLS}, status string, model string")
    cited = spark.createDataFrame([(1, 10, 4, 1, "two"), (1, 10, 4, 0, "one")], f"{CELLS}, quote_pos int, quoted_text string")
    runs = spark.createDataFrame([(1, k, k, "done") for k in range(7)], "review_id long, run_id long, created_at int, status string")
    got = {(r.review_id, r.document_id): r for r in grid.review_detail(rows, documents, columns, cells, cited, runs).collect()}
    assert set(got) == {(1, 20), (1, 10), (2, 10)}
    one = got[(1, 10)]
    assert [c.column_id for c in one.cells] == [5, 4] and one.cells[0].cell is None and [q.quoted_text for q in one.cells[1].cell.citations] == ["one", "two"]
    assert [r.run_id for r in one.runs] == [6, 5, 4, 3, 2] and not one.demo and one.page_count == 3 and got[(1, 20)].document_status == "failed"
    assert got[(2, 10)].cells is None and got[(2, 10)].runs is None


def test_messages_are_proved(spark):
    text = "The Supplier shall indemnify the Customer against all losses."
    docs = spark.createDataFrame([(1, text)], "document_id long, text string")
    chunks = docs.select("document_id", F.lit(0).alias("ordinal"), F.lit(0).alias("char_start"), F.char_length("text").alias("char_end"), "text")
    said = spark.createDataFrame([(7, "A [1]. B [2]. C [3].", False), (8, "A [1].", False), (9, "Nothing.", True)], "message_id long, content string, insufficient boolean")
    cited = spark.createDataFrame([(7, 1, "d1c0", "indemnify the Customer"), (7, 2, "d1c0", "pay a penalty of ten per cent"), (7, 3, "d9c9", "indemnify"), (8, 1, "d1c0", "against all  losses")], "message_id long, marker int, label string, quote string")
    hits = spark.createDataFrame([(7, "d1c0", 1, 0), (8, "d1c0", 1, 0)], "message_id long, label string, document_id long, ordinal int")
    done, held = assistant.prove_messages(said, cited, hits, chunks, docs)
    assert {r.message_id: (r.content, r.verified) for r in done.collect()} == {7: ("A [1]. B. C.", False), 8: ("A [1].", True), 9: ("Nothing.", True)}
    assert sorted((r.message_id, r.marker, text[r.char_start : r.char_end]) for r in held.collect()) == [(7, 1, "indemnify the Customer"), (8, 1, "against all losses")]


def test_documents_of_another_matter_are_refused(spark):
    old = spark.createDataFrame([("r", 1, 1, "m"), ("r", 2, 2, "m")], "review_id string, document_id long, row_order int, matter_id string")
    new = spark.createDataFrame([("r", 2, "m"), ("r", 3, "m"), ("r", 4, "n"), ("s", 5, "n")], "review_id string, document_id long, matter_id string")
    added, refused = listing.append_rows(old, new, matter="matter_id")
    assert sorted((r.review_id, r.document_id, r.row_order) for r in added.collect()) == [("r", 3, 3), ("s", 5, 1)]
    assert [r.document_id for r in refused.collect()] == [4]


def test_words_of_paragraphs_slice_back(spark):
    rows = spark.createDataFrame([(1, 0, "p", "  One  two ", None), (1, 1, "tr", None, ["a", " ", "b c"]), (1, 2, "p", " \t", None), (1, 3, "p", "three\n\nfour", None), (2, 0, "tr", None, ["", " "])], "document_id long, position int, kind string, text string, cells array<string>")
    (page,) = ingest.page_from_paragraphs(rows).collect()
    assert page.text == "One  two\n\na | b c\n\nthree\nfour"
    assert [page.text[w.start : w.end] for w in page.words] == ["One", "two", "a", "|", "b", "c", "three\nfour"] and all(w.x1 == w.y1 == 0 for w in page.words)


def test_raw_files(spark, tmp_path):
    for name in ("a.pdf", "B.DOCX", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    got = {r.filename: (r.accepted, r.size_bytes, r.mime_type) for r in files.scan_files(spark, f"file://{tmp_path}/*").collect()}
    assert got == {"a.pdf": (True, 5, files.MIME[".pdf"]), "B.DOCX": (True, 6, files.MIME[".docx"]), "c.txt": (False, 5, None)}


def test_evaluation_files(spark, tmp_path):
    files.write_eval(spark.createDataFrame([(5, 0.8)], "total long, accuracy double"), spark.createDataFrame([("k", 5)], "key string, total long"), f"file://{tmp_path}/e")
    assert spark.read.json(f"file://{tmp_path}/e/summary").first().accuracy == 0.8 and spark.read.json(f"file://{tmp_path}/e/questions").first().key == "k"
