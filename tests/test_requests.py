import json

from lexspan.operators import grid, playbook
from lexspan.sources import requests

PASSAGE = "document_id long, ordinal int, label string, section_path string, text string"


def _lines(rows):
    return {r.custom_id: (json.loads(r.line), r.request_tokens) for r in rows.collect()}


def test_review_requests(spark):
    documents = spark.createDataFrame([(1, "Lease"), (2, None), (3, "Empty")], "document_id long, title string")
    passages = spark.createDataFrame([(1, 1, "c1", "", "second"), (1, 0, "c0", "A > 1", "first"), (2, 0, "c0", None, None)], PASSAGE)
    outlines = spark.createDataFrame([(1, ["One", "Two"]), (2, [])], "document_id long, lines array<string>")
    asked = "review_id long, document_id long, group_no int, questions array<struct<label:string,output_type:string,enum_options:array<string>,question:string>>"
    plan = spark.createDataFrame([(9, d, g, [("q1", "enum", ["yes", "no"], "Who?"), ("q2", "text", None, None)]) for d in (1, 2, 3) for g in (0, 1)], asked)
    got = _lines(requests.review_requests(plan, requests.document_parts(documents, passages, outlines), "0a1b2c3d-4e5f-6071", "Sys", model="m", playbook="Firm"))
    assert sorted(got) == [f"0a1b2c3d4e5f-{i:05d}" for i in range(4)]  # the third document has no passages
    by_document = {}
    for body, tokens in ((x["body"], t) for x, t in got.values()):
        by_document.setdefault(body["metadata"]["document_id"], []).append((body, tokens))
    assert {d: len(x) for d, x in by_document.items()} == {"1": 2, "2": 2}
    body, tokens = by_document["1"][0]
    assert body["model"] == "m" and body["metadata"] == {"review_id": "9", "document_id": "1"}
    assert [m["role"] for m in body["input"]] == ["system", "user", "user"]
    assert body["input"][0]["content"] == "Sys\n\n# Firm playbook\nFirm"
    assert body["input"][1]["content"] == "# Document: Lease\n\n## Outline\n\n- One\n\n- Two\n\n## Passages\n\n[c0] (A > 1)\nfirst\n\n[c1]\nsecond"
    assert body["input"][2]["content"].split("\n")[:3] == ["## Questions", "q1 | type: enum | options: yes, no | Who?", "q2 | type: text | "]
    assert tokens == (3 + 4 + 11 + 4) // 4 + 500
    body, tokens = by_document["2"][0]
    assert body["input"][1]["content"] == "# Document: \n\n## Passages\n\n[c0]\n" and tokens == (3 + 4 + 0 + 4) // 4 + 500


def test_playbook_requests(spark):
    parts = requests.document_parts(spark.createDataFrame([(1, "Lease")], "document_id long, title string"), spark.createDataFrame([(1, 0, "c0", "", "seven l")], PASSAGE))
    books = spark.createDataFrame([(5, "House"), (6, "Bare")], "playbook_id long, playbook_name string")
    rules = spark.createDataFrame([(5, 2, "r2", "Law", "own law", None, "none"), (5, 1, "r1", "Term", "short", "long", "")], "playbook_id long, ordinal int, label string, topic string, preferred_position string, fallback_position string, unacceptable_position string")
    plan = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "document_id long, playbook_id long")
    ((_, (line, tokens)),) = _lines(requests.playbook_requests(plan, parts, books, rules, "run", "System", model="m")).items()
    system, part, ask = (m["content"] for m in line["body"]["input"])
    assert system == "System\n\n# Playbook: House\n## r1 — Term\nPreferred: short\nFallback: long\n## r2 — Law\nPreferred: own law\nUnacceptable: none"
    assert part == "# Document: Lease\n\n## Passages\n\n[c0]\nseven l" and "(r1, r2)" in ask
    assert tokens == 6 // 4 + 7 // 4 + 12 // 4 + 800


def test_chat_requests(spark):
    asked = spark.createDataFrame([(1, "m1", "Why?"), (1, "m2", None), (1, "m3", "lost")], "thread_id long, message_id string, question string")
    passages = spark.createDataFrame([("m1", 1, "d2c0", "b.pdf", None, "bb"), ("m1", 0, "d1c3", "a.pdf", "S", "aaaa"), ("m2", 0, "d1c0", "a.pdf", "", "x")], "message_id string, ordinal int, label string, filename string, section_path string, text string")
    history = spark.createDataFrame([("m1", [(0, "user", "hello"), (1, "assistant", None)])], "message_id string, messages array<struct<position:int,role:string,content:string>>")
    got = _lines(requests.chat_requests(asked, passages, history, "run", "Sys", model="m"))
    by_size = sorted(got.values(), key=lambda x: len(x[0]["body"]["input"]))
    assert len(by_size) == 2 and [m["role"] for m in by_size[1][0]["body"]["input"]] == ["system", "user", "user", "assistant", "user"]
    said = [m["content"] for m in by_size[1][0]["body"]["input"]]
    assert said[1] == "# Passages from the selected documents\n\n[d1c3] (document: a.pdf > S)\naaaa\n\n[d2c0] (document: b.pdf)\nbb"
    assert said[2:4] == ["hello", ""] and said[4].startswith("Question: Why?\n\n") and by_size[1][1] == 0 + 6 // 4 + 5 // 4 + 400
    assert len(by_size[0][0]["body"]["input"]) == 3 and by_size[0][1] == 400


def test_numbers_have_no_gap_and_empty_plans(spark):
    plan = spark.range(5000).selectExpr("id AS document_id", "id % 3 AS group_no").repartition(7)
    ids = [r.custom_id for r in requests.numbered(plan, "r", "document_id", "group_no").collect()]
    assert sorted(ids) == [f"r-{i:05d}" for i in range(5000)]
    assert requests.numbered(plan.limit(0), "r", "document_id").count() == 0


def test_single_cells_and_runs_of_a_document(spark):
    documents = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "review_id long, document_id long")
    columns = spark.createDataFrame([(1, 7), (1, 8), (2, 9)], "review_id long, column_id long")
    cells = spark.createDataFrame([(1, 10, 8), (1, 10, 8), (1, 12, 7), (2, 10, 7)], "review_id long, document_id long, column_id long")
    assert [tuple(r) for r in grid.grid_targets(documents, columns, cells=cells).select("review_id", "document_id", "column_id", "total_cells").collect()] == [(1, 10, 8, 1)]
    runs = spark.createDataFrame([(1, 10, 5), (2, 10, 6), (3, 99, 1)], "run_id long, document_id long, created_at int")
    known = spark.createDataFrame([(10, 4)], "document_id long, matter_id long")
    assert sorted((r.run_id, r.place) for r in playbook.list_runs(runs, known, "document_id").collect()) == [(1, 2), (2, 1), (3, 1)]
    assert sorted(r.run_id for r in playbook.list_runs(runs, known).collect()) == [1, 2]


def test_sql_numbers_past_five_digits():
    import duckdb

    from lexspan.plans.stream_queries import _number

    made = duckdb.connect().execute(f"SELECT {_number('k', 'k')} FROM range(100002) r(k) ORDER BY 1").fetchall()
    assert len(set(made)) == 100002 and ("run0001abcde-100001",) in made and ("run0001abcde-00000",) in made
