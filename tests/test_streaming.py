import json
import random

import pytest
from pyspark.sql import functions as F

from lexspan.functions import helpers
from lexspan.operators import ingest
from lexspan.sources import files, versions
from lexspan.streaming import jobs
from lexspan.streaming.jobs import AnswerDecoder

SIZES = (1, 2, 3, 5, 7, 11, 1000)


def _decoded(text, size):
    decoder = AnswerDecoder()
    return "".join(decoder.feed(text[i : i + size]) for i in range(0, len(text), size)), decoder


def test_decoder_gives_what_json_gives():
    rng = random.Random(1)
    for _ in range(800):
        answer = "".join(rng.choice(["a", '"', "\\", "\n", "é", "🙂", "—", "answer", " ", ":", "{", "b"]) for _ in range(rng.randrange(12)))
        whole = {"kind": rng.choice(["answer", 'x"y\\', ":"]), "n": rng.choice([1, None, ["answer"]]), "answer": answer, "z": "tail"}
        if rng.random() < 0.3:
            whole = {'ans"wer': "no", "answer\n": "no", **whole}
        text = json.dumps(whole, ensure_ascii=rng.random() < 0.5)
        for size in SIZES:
            got, decoder = _decoded(text, size)
            assert got == answer and decoder.mode == decoder.DONE and len(decoder.held) <= 12


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"answer": "a\\ud83dx"}', "a�x"), ('{"answer": "a\\ud83d\\n"}', "a�\n"), ('{"answer": "a\\ud83d\\u0041"}', "a�A"), ('{"answer": null, "b": "c"}', ""), ('{"answer": "open', "open"), ('{"answer": "cut \\u00', "cut "), ("", "")],
)
def test_decoder_on_odd_texts(text, want):
    assert {_decoded(text, size)[0] for size in SIZES} == {want}


def _append(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _source(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_answers_come_over_many_batches(spark, tmp_path):
    schema, source = "message_id string, seq long, delta string, event_time timestamp", f"{tmp_path}/in"
    texts = {"m1": '{"answer": "line\\none \\u2014 \\ud83d\\ude42 end", "x": 1}', "m2": '{"a": "answer", "answer": "two"}', "m3": '{"answer": "not yet'}
    run = lambda: jobs.run_available(jobs.answer_field_stream(_source(spark, schema, source)), lambda b, n: versions.write(b, f"{tmp_path}/out", n), f"{tmp_path}/c", "update")
    for k in range(4):
        rows = [(m, k * 100 + i, d, None) for m, t in texts.items() for i, d in enumerate(t[j : j + 3] for j in range(k * 15, min(k * 15 + 15, len(t)) if k < 3 else len(t), 3))]
        _append(spark, [(*r[:3], __import__("datetime").datetime(2024, 1, 1, 0, k)) for r in rows], schema, source)
        run()
    got = {r.message_id: (r.answer, r.done) for r in jobs.answers(spark.read.parquet(f"{tmp_path}/out/data").drop("version")).collect()}
    assert got == {"m1": ("line\none — 🙂 end", True), "m2": ("two", True), "m3": ("not yet", False)}


def _calls(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2, 3]), rng.randrange(0, 400), rng.choice([0, 7, 100])) for i in range(300)]
    df = spark.createDataFrame(rows, "call_id long, user_id long, s long, input_tokens long")
    return df.select("call_id", "user_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts"), "input_tokens")


def test_rates_of_late_calls_are_exact(spark, tmp_path):
    calls = _calls(spark)
    for k in range(3):  # calls arrive in no order of time, over three batches
        calls.where(F.col("call_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        jobs.rate_stream(_source(spark, calls.schema, f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c", 20, 500)
    key = lambda rows: sorted((r.call_id, r.requests, r.tokens, r.over) for r in rows.collect())
    assert key(files.read_documents(spark, f"{tmp_path}/t", "call_id")) == key(jobs.rate_windows(calls, 20, 500, "user_id"))


def test_progress_counts_an_update_once(spark, tmp_path):
    rows = [(r, u, f"2024-01-01 00:00:{u:02d}", 1, 4) for r, count in ((1, 5), (2, 3), (3, 4)) for u in range(count)]
    updates = spark.createDataFrame(rows, "run_id long, update_id long, t string, n long, total_cells long").select("run_id", "update_id", F.to_timestamp("t").alias("event_time"), "n", "total_cells")
    key = lambda rows: sorted((r.run_id, r.total_cells, r.done_cells, r.status, str(r.completed_at)) for r in rows.collect())
    want = key(jobs.run_progress(updates))
    assert [(w[2], w[3]) for w in want] == [(4, "done"), (3, "running"), (4, "done")]
    for part in (updates.where("update_id < 2"), updates.where("update_id BETWEEN 1 AND 3"), updates):  # most are sent twice or more
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.run_progress_stream(_source(spark, updates.schema, f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c")
    assert key(files.read_documents(spark, f"{tmp_path}/t", "run_id")) == want


def test_racing_registrations_keep_one(spark, tmp_path):
    schema = "matter_id string, sha256 string, document_id long, created_at timestamp"
    at = __import__("datetime").datetime
    batches = [[("m", "h", 2, at(2024, 1, 1)), ("m", "h", 1, at(2024, 1, 2)), ("n", "h", 3, at(2024, 1, 1))], [("m", "h", 4, at(2023, 1, 1)), ("m", "g", 5, at(2024, 1, 3)), ("m", "g", 6, at(2024, 1, 3))]]
    for rows in batches:
        _append(spark, rows, schema, f"{tmp_path}/in")
        jobs.dedupe_stream(_source(spark, schema, f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c")
    kept = versions.current(spark, f"{tmp_path}/t", "matter_id", "sha256").collect()
    assert sorted((r.matter_id, r.sha256, r.document_id) for r in kept) == [("m", "g", 5), ("m", "h", 2), ("n", "h", 3)]


def test_a_killed_ingestion_goes_on(spark, tmp_path):
    schema = "document_id long, page_number int, text string"
    rows = [(1, 1, "First clause stands here.\n\nSecond clause follows it."), (2, 1, "Gardens and rivers."), (3, 1, "  ")]
    _append(spark, rows, schema, f"{tmp_path}/in")
    ran = []

    def killed(stage, batch):
        ran.append((stage, batch))
        if stage == "chunk":
            raise RuntimeError("killed")

    args = {"embedder": helpers.hash_vectors(8), "dim": 8}
    path = f"{tmp_path}/t"
    with pytest.raises(Exception, match="killed"):
        jobs.ingest_stream(_source(spark, schema, f"{tmp_path}/in"), path, f"{tmp_path}/c", after=killed, **args)
    assert files.read_documents(spark, f"{path}/documents") is None
    jobs.ingest_stream(_source(spark, schema, f"{tmp_path}/in"), path, f"{tmp_path}/c", after=lambda *x: ran.append(x), **args)
    assert ran == [("chunk", 0), ("embed", 0), ("status", 0)]
    # A document that comes again replaces its chunks; the others stay.
    _append(spark, [(2, 1, "Only stones are left.")], schema, f"{tmp_path}/in")
    jobs.ingest_stream(_source(spark, schema, f"{tmp_path}/in"), path, f"{tmp_path}/c", **args)
    pages = spark.createDataFrame([*rows[:1], (2, 1, "Only stones are left."), rows[2]], schema)
    documents, chunks = ingest.ingest(pages, **args)
    key = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    assert key(files.read_documents(spark, f"{path}/documents")) == key(documents)
    assert key(files.read_documents(spark, f"{path}/chunks")) == key(chunks)


def test_versions(spark, tmp_path):
    path, table = f"{tmp_path}/t", lambda: sorted((r.document_id, r.v) for r in files.read_documents(spark, path).collect())
    make = lambda *rows: spark.createDataFrame(list(rows), "document_id long, v string")
    files.replace_documents(make((1, "a"), (2, "a"), (2, "b")), path)
    versions.write(make((1, "half")), path, 2)  # a write that broke off before its commit
    assert table() == [(1, "a"), (2, "a"), (2, "b")]
    files.replace_documents(make((2, "c")), path)
    files.replace_documents(make((2, "c")), path, version=2)  # the same version again
    assert table() == [(1, "a"), (2, "c")]
    for k in range(4):
        versions.replace(make((9, str(k))), path, "document_id", compact_after=3)
    assert table() == [(1, "a"), (2, "c"), (9, "3")] and any("full" in s for s in versions.committed(spark, path).values())


def test_pieces_of_a_batch_are_decoded_as_one_text():
    import pandas as pd

    text = json.dumps({"kind": "answer", "answer": 'one "two" \u00e9 three' * 5, "n": 1})
    rows = [(i // 7, text[i : i + 7]) for i in range(0, len(text), 7)]
    random.Random(2).shuffle(rows)
    frames = [pd.DataFrame(part, columns=["seq", "delta"]) for part in (rows[:9], rows[9:10], [], rows[10:])]
    assert jobs.in_order(frames) == text
    assert AnswerDecoder().feed(jobs.in_order(frames)) == _decoded(text, 7)[0]
