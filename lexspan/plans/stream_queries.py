"""Registered queries of sources, sinks and streaming jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexspan.functions import helpers
from lexspan.operators import grid, ingest
from lexspan.plans import adapters as a
from lexspan.plans.queries import LINES, PAGES, QUESTIONS, register
from lexspan.sources import files, requests, versions
from lexspan.streaming import jobs


@register("s1_scan_files")
def scanned(spark, d):
    return files.scan_files(spark, f"{d}/documents.parquet")


WORDS = "words AS (SELECT doc_id, ln, i AS word_no, l[i] AS token FROM (SELECT doc_id, ln, string_split(line, ' ') AS l FROM lines) x, unnest(range(1, len(l) + 1)) AS u(i) WHERE trim(l[i]) <> '')"


def _words(spark, d):
    rows = a.lines(spark, d).select(F.col("doc_id").alias("document_id"), F.floor(F.col("ln") / 5).cast("int").alias("page_number"), F.floor(F.col("ln") / 2).alias("block_no"), F.col("ln").alias("line_no"), F.posexplode(F.split("line", " ", -1)).alias("word_no", "token"))
    return rows.select("*", *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 1.0), ("y1", 1.0))])


@register("s2_pages_from_words", f"WITH {PAGES}, {WORDS}, li AS (SELECT doc_id, ln, string_agg(token, ' ' ORDER BY word_no) AS line FROM words GROUP BY 1, 2), bl AS (SELECT doc_id, ln // 5 AS page_number, ln // 2 AS b, string_agg(line, chr(10) ORDER BY ln) AS block FROM li GROUP BY 1, 2, 3) SELECT doc_id AS document_id, page_number::INT AS page_number, md5(string_agg(block, chr(10) || chr(10) ORDER BY b)) AS text FROM bl GROUP BY 1, 2")
def word_pages(spark, d):
    return ingest.pages_from_words(_words(spark, d)).select("document_id", "page_number", F.md5("text").alias("text"))


@register(
    "s3_page_from_paragraphs",
    f"""WITH {LINES}, t AS (SELECT doc_id, ln, CASE WHEN ln % 4 = 0 AND trim(line) <> '' THEN trim(line) || ' | ' || ln WHEN ln % 4 = 0 THEN ln::VARCHAR ELSE trim(line) END AS txt FROM lines WHERE trim(line) <> '' OR ln % 4 = 0),
    s AS (SELECT doc_id, sum(len(list_filter(string_split(txt, ' '), lambda x: x <> ''))) AS n FROM t GROUP BY 1), j AS (SELECT doc_id, string_agg(txt, chr(10) || chr(10) ORDER BY ln) AS txt FROM t GROUP BY 1)
    SELECT doc_id AS document_id, md5(txt) AS text, n::BIGINT AS n_words, md5(array_to_string(list_filter(string_split(replace(txt, chr(10) || chr(10), ' '), ' '), lambda x: x <> ''), '|')) AS words FROM j JOIN s USING (doc_id)""",
)
def paragraph_pages(spark, d):
    """The words are cut from the page at their offsets."""
    rows = a.lines(spark, d).select(F.col("doc_id").alias("document_id"), F.col("ln").alias("position"), F.when(F.col("ln") % 4 == 0, "tr").otherwise("p").alias("kind"), F.col("line").alias("text"), F.array("line", F.col("ln").cast("string")).alias("cells"))
    page = ingest.page_from_paragraphs(rows)
    page = page.withColumn("cut", helpers.cut_spans(F.col("text"), F.col("words")))  # before ``text`` gets another meaning
    return page.select("document_id", F.md5("text").alias("text"), F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("cut", "|")).alias("words"))


@register("s4_flag_scanned", f"WITH {PAGES}, {WORDS}, p AS (SELECT doc_id, (ln // 5)::INT AS page_number, sum(length(token)) < 100 AS is_ocr FROM words GROUP BY 1, 2) SELECT doc_id AS document_id, page_number, is_ocr, bool_or(is_ocr) OVER (PARTITION BY doc_id) AS document_is_ocr FROM p")
def scanned_pages(spark, d):
    return ingest.flag_scanned(_words(spark, d).where("trim(token) <> ''")).select("document_id", "page_number", "is_ocr", "document_is_ocr")


#: Every seventh line of a document serves as its outline, every other page has a section.
PASSAGE = "SELECT document_id, any_value(review_id) AS review_id, string_agg('[c' || ordinal || ']' || CASE WHEN ordinal % 2 = 1 THEN ' (Part ' || ordinal || ')' ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY ordinal) AS shown, sum(length(text)) AS letters FROM chunks GROUP BY 1"
PARTS = f"{PAGES}, {QUESTIONS}, sh AS ({PASSAGE}), ol AS (SELECT doc_id AS document_id, string_agg('- ' || line, chr(10) || chr(10) ORDER BY ln) AS outline FROM lines WHERE ln % 7 = 0 AND trim(line) <> '' GROUP BY 1), parts AS (SELECT document_id, review_id, letters, '# Document: Document ' || document_id || coalesce(chr(10) || chr(10) || '## Outline' || chr(10) || chr(10) || outline, '') || chr(10) || chr(10) || '## Passages' || chr(10) || chr(10) || shown AS part FROM sh LEFT JOIN ol USING (document_id))"


def _number(key, order):
    """Five digits at least; numbers from 100 000 on have more (``lpad`` would cut them)."""
    return f"printf('run0001abcde-%05d', row_number() OVER (ORDER BY md5({key}::VARCHAR)[1:3], {order}) - 1)"


def _passages(spark, d):
    section = F.when(F.col("ordinal") % 2 == 1, F.concat(F.lit("Part "), F.col("ordinal").cast("string"))).otherwise("")
    return a.page_chunks(spark, d).select("document_id", "review_id", "ordinal", F.format_string("c%d", "ordinal").alias("label"), section.alias("section_path"), "text")


def _document_parts(spark, d):
    titles = a.documents(spark, d).select("document_id", F.concat(F.lit("Document "), F.col("document_id").cast("string")).alias("title"))
    heads = a.lines(spark, d).where("ln % 7 = 0 AND trim(line) <> ''").groupBy(F.col("doc_id").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("ln", "line")))["line"].alias("lines"))
    return requests.document_parts(titles, _passages(spark, d), heads)


def _contents(line):
    """Roles and contents of a request's messages as one hash."""
    messages = F.from_json(line, "body struct<model:string,input:array<struct<role:string,content:string>>,metadata:map<string,string>>")["body"]
    said = F.array_join(F.transform(messages["input"], lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return F.md5(said).alias("content"), F.array_join(F.array_sort(F.map_values(messages["metadata"])), "|").alias("metadata")


@register(
    "s7_t1b_requests",
    f"""WITH {PARTS}, q AS (SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY question_id) - 1 AS k, question FROM questions),
    g AS (SELECT review_id, k // 2 AS group_no, string_agg('q' || (k % 2 + 1) || ' | type: ' || CASE k % 2 WHEN 0 THEN 'enum | options: yes, no' ELSE 'text' END || ' | ' || question, chr(10) ORDER BY k) AS asked, sum(length(question)) AS n FROM q GROUP BY 1, 2)
    SELECT document_id, group_no::BIGINT AS group_no, {_number('document_id', 'document_id, group_no')} AS custom_id, ((length('Be truthful.') + length('Prefer short terms') + letters + n) // 4 + 500)::BIGINT AS request_tokens,
    md5('system: Be truthful.' || chr(10) || chr(10) || '# Firm playbook' || chr(10) || 'Prefer short terms' || chr(10) || 'user: ' || part || chr(10) || 'user: ## Questions' || chr(10) || asked || chr(10) || 'Answer every question above by its label, with verbatim quotes and passage labels.') AS content,
    array_to_string(list_sort([review_id::VARCHAR, document_id::VARCHAR]), '|') AS metadata FROM parts JOIN g USING (review_id)""",
)
def review_requests(spark, d):
    columns = a.columns(spark, d).withColumnRenamed("ordinal_no", "ordinal")
    targets = grid.group_columns(grid.grid_targets(a.documents(spark, d).select("document_id", "review_id"), columns), 2)
    first = F.col("label") == "q1"
    question = F.struct("ordinal", "label", F.when(first, "enum").otherwise("text").alias("output_type"), F.when(first, F.array(F.lit("yes"), F.lit("no"))).otherwise(F.col("enum_options")).alias("enum_options"), "question")
    plan = targets.groupBy("review_id", "document_id", "group_no").agg(F.array_sort(F.collect_list(F.struct("ordinal", question.alias("q"))))["q"].alias("questions"))
    lines = requests.review_requests(plan, _document_parts(spark, d), "run0001-abcdef-1", "Be truthful.", model="m", playbook="Prefer short terms")
    return lines.select("document_id", "group_no", "custom_id", "request_tokens", *_contents("line"))


@register(
    "s7_playbook_requests",
    f"""WITH {PARTS}, r AS (SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY question_id) AS k, question FROM questions),
    b AS (SELECT review_id, string_agg('## r' || k || ' — Topic ' || k || chr(10) || 'Preferred: ' || question || CASE WHEN k % 2 = 0 THEN chr(10) || 'Fallback: ' || k ELSE '' END || CASE WHEN k % 3 = 0 THEN chr(10) || 'Unacceptable: ' || k ELSE '' END, chr(10) ORDER BY k) AS rules, string_agg('r' || k, ', ' ORDER BY k) AS labels, sum(length(question)) AS n FROM r GROUP BY 1)
    SELECT document_id, {_number('document_id', 'document_id')} AS custom_id, (length('Be truthful.') // 4 + 800 + letters // 4 + n // 4)::BIGINT AS request_tokens, 'run0001-abcdef-1' AS metadata,
    md5('system: Be truthful.' || chr(10) || chr(10) || '# Playbook: Book ' || review_id || chr(10) || rules || chr(10) || 'user: ' || part || chr(10) || 'user: Produce exactly one finding per playbook rule, by rule label (' || labels || '), following the rules above.') AS content FROM parts JOIN b USING (review_id)""",
)
def playbook_requests(spark, d):
    k = F.row_number().over(Window.partitionBy("review_id").orderBy("question_id"))
    text = F.col("k").cast("string")
    rules = a.questions(spark, d).withColumn("k", k).select(F.col("review_id").alias("playbook_id"), F.col("k").alias("ordinal"), F.concat(F.lit("r"), text).alias("label"), F.concat(F.lit("Topic "), text).alias("topic"), F.col("question").alias("preferred_position"), F.when(F.col("k") % 2 == 0, text).alias("fallback_position"), F.when(F.col("k") % 3 == 0, text).otherwise("").alias("unacceptable_position"))
    books = rules.select("playbook_id").distinct().withColumn("playbook_name", F.concat(F.lit("Book "), F.col("playbook_id").cast("string")))
    plan = a.documents(spark, d).select("document_id", F.col("review_id").alias("playbook_id"))
    lines = requests.playbook_requests(plan, _document_parts(spark, d), books, rules, "run0001-abcdef-1", "Be truthful.", model="m")
    return lines.select("document_id", "custom_id", "request_tokens", *_contents("line"))


@register(
    "s7_chat_requests",
    f"""WITH {PAGES}, m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, conv_id || ':' || turn AS message_id FROM conversations WHERE role <> 'system'), u AS (SELECT * FROM m WHERE role = 'user'),
    h AS (SELECT u.message_id, string_agg(m.role || ': ' || m.text || chr(10), '' ORDER BY m.turn) AS said, sum(length(m.text)) AS n FROM u JOIN m ON m.conv_id = u.conv_id AND m.turn < u.turn GROUP BY 1),
    p AS (SELECT document_id, string_agg('[d1c' || ordinal || '] (document: File ' || document_id || CASE WHEN ordinal % 2 = 1 THEN ' > Part ' || ordinal ELSE '' END || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY ordinal) AS shown, sum(length(text)) AS letters FROM chunks GROUP BY 1)
    SELECT message_id, {_number('message_id', 'message_id')} AS custom_id, (length('Be truthful.') // 4 + 400 + letters // 4 + coalesce(n, 0) // 4)::BIGINT AS request_tokens, conv_id::VARCHAR AS metadata,
    md5('system: Be truthful.' || chr(10) || 'user: # Passages from the selected documents' || chr(10) || chr(10) || shown || chr(10) || coalesce(said, '') || 'user: Question: ' || text || chr(10) || chr(10) || 'Answer from the passages above only, with numbered markers and verbatim quotes.') AS content
    FROM u JOIN p ON document_id = conv_id LEFT JOIN h USING (message_id)""",
)
def chat_requests(spark, d):
    """Every turn of a user asks the document that has the thread's number, after all earlier turns."""
    said = a.messages(spark, d)
    earlier = Window.partitionBy("thread_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    turns = said.withColumn("messages", F.collect_list(F.struct("position", "role", F.coalesce("content", F.lit("")).alias("content"))).over(earlier)).where("role = 'user'")
    turns = turns.withColumn("message_id", F.concat_ws(":", F.col("thread_id").cast("string"), F.col("position").cast("string")))
    named = _passages(spark, d).withColumns({"label": F.format_string("d1c%d", "ordinal"), "filename": F.concat(F.lit("File "), F.col("document_id").cast("string"))})
    passages = turns.select("message_id", F.col("thread_id").alias("document_id")).join(named, "document_id")
    lines = requests.chat_requests(turns.select("thread_id", "message_id", F.col("content").alias("question")), passages, turns.select("message_id", "messages"), "run0001-abcdef-1", "Be truthful.", model="m")
    return lines.select("message_id", "custom_id", "request_tokens", *_contents("line"))


@register("s8_st6_batch_output", "SELECT event_id::VARCHAR AS custom_id, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'failed' WHEN 2 THEN 'failed' ELSE 'done' END AS status, CASE event_id % 5 WHEN 0 THEN 'no result for this request' WHEN 1 THEN 'status 500' WHEN 2 THEN 'boom' END AS error FROM events")
def outputs(spark, d):
    e = a.table(spark, d, "events").select(F.col("event_id").cast("string").alias("custom_id"), "event_id", "event_type")
    part = F.struct(F.lit("output_text").alias("type"), F.col("event_type").alias("text"))
    body = F.struct(F.array(F.struct(F.lit("message").alias("type"), F.array(part).alias("content"))).alias("output"))
    response = F.struct(F.when(F.col("event_id") % 5 == 1, 500).otherwise(200).alias("status_code"), body.alias("body"))
    lines = e.where("event_id % 5 <> 0").select(F.to_json(F.struct("custom_id", response.alias("response"), F.struct(F.when(F.col("event_id") % 5 == 2, "boom").alias("message")).alias("error"))).alias("value"))
    plan = e.select("custom_id", F.col("event_id").alias("document_id"), F.lit(0).alias("column_id"))
    return jobs.batch_poll(plan, files.read_batch_output(lines)).select("custom_id", "status", "error")


@register("st2_cell_state", "SELECT user_id, event_type, max(struct_pack(t := ts, v := event_id)).v AS status, bool_or(event_id % 50 = 0) AS demo FROM events GROUP BY 1, 2")
def cell_state(spark, d):
    e = a.table(spark, d, "events").select("user_id", "event_type", F.col("ts").alias("event_time"), F.col("event_id").alias("status"), (F.col("event_id") % 50 == 0).alias("demo"))
    return jobs.latest_cells(e, "user_id", "event_type").select("user_id", "event_type", "status", "demo")


def _stream(spark, d, name):
    """A given table as a file stream; the pattern lets the table be one file or a folder of files."""
    return spark.readStream.schema(a.table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


UPDATES = ("user_id AS run_id", "event_id AS update_id", "CAST(ts AS timestamp) AS event_time", "CAST(1 AS bigint) AS n", "CAST(20 AS bigint) AS total_cells")
PROGRESS = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT user_id AS run_id, 20::BIGINT AS total_cells, least(count(*), 20) AS done_cells, CASE WHEN count(*) >= 20 THEN 'done' ELSE 'running' END AS status,
    strftime(max(CASE WHEN k = 20 THEN ts END), '%Y-%m-%d %H:%M:%S') AS completed_at FROM o GROUP BY 1"""


def _shown(rows):
    return rows.select("run_id", "total_cells", "done_cells", "status", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))


@register("st3_run_progress", PROGRESS)
def progress(spark, d):
    return _shown(jobs.run_progress(a.table(spark, d, "events").selectExpr(*UPDATES)))


@register("st3_run_progress_stream", PROGRESS)
def progress_stream(spark, d):
    path = jobs.work_dir(spark)
    jobs.run_progress_stream(_stream(spark, d, "events").selectExpr(*UPDATES), f"{path}/t", f"{path}/c")
    return _shown(files.read_documents(spark, f"{path}/t", "run_id"))


RATES = "WITH c AS (SELECT event_id AS call_id, user_id, epoch_us(ts) AS t, coalesce((props->>'$.k')::BIGINT, 0) AS k FROM events) SELECT call_id, count(*) OVER w AS requests, sum(k) OVER w AS tokens FROM c WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)"


@register("st4_rate_windows", RATES)
def rates(spark, d):
    calls = a.calls(spark, d).withColumn("input_tokens", F.coalesce("input_tokens", F.lit(0)))
    return jobs.rate_windows(calls, 300, 400_000, "user_id").select("call_id", "requests", F.col("tokens").cast("double").alias("tokens"))


@register("st4_rate_stream", RATES)
def rates_of_stream(spark, d):
    path = jobs.work_dir(spark)
    calls = _stream(spark, d, "events").select(F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("input_tokens"))
    jobs.rate_stream(calls, f"{path}/t", f"{path}/c", 300, 400_000)
    return files.read_documents(spark, f"{path}/t", "call_id").select("call_id", "requests", F.col("tokens").cast("double").alias("tokens"))


@register("st5_answer_text", "SELECT conv_id || ':' || turn AS message_id, coalesce(text, '') AS answer, true AS done FROM conversations")
def answer_text(spark, d):
    """Every turn as a JSON text that comes in pieces of 7 letters through the stream."""
    path = jobs.work_dir(spark)
    text = F.to_json(F.struct(F.lit("answer").alias("kind"), F.coalesce("text", F.lit("")).alias("answer"), F.lit(1).alias("n")))
    turns = _stream(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("message_id"), text.alias("json"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("event_time"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.char_length("json") - 1) / 7)), lambda i: F.struct(i.alias("seq"), F.substring("json", i * 7 + 1, F.lit(7)).alias("delta")))
    deltas = turns.select("message_id", "event_time", F.explode(pieces).alias("p")).select("message_id", F.col("p.seq").alias("seq"), F.col("p.delta").alias("delta"), "event_time")
    jobs.run_available(jobs.answer_field_stream(deltas), lambda batch, n: versions.write(batch, f"{path}/t", n), f"{path}/c", "update")
    return jobs.answers(spark.read.parquet(f"{path}/t/data").drop("version"))


@register("st7_registrations", "SELECT lang AS matter_id, sha256(coalesce(text, '')) AS sha256, min(doc_id) AS document_id FROM documents GROUP BY 1, 2")
def registrations(spark, d):
    path = jobs.work_dir(spark)
    stamped = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("created_at")
    rows = _stream(spark, d, "documents").select(F.col("lang").alias("matter_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.col("doc_id").alias("document_id"), stamped)
    jobs.dedupe_stream(rows, f"{path}/t", f"{path}/c")
    return versions.current(spark, f"{path}/t", "matter_id", "sha256").select("matter_id", "sha256", "document_id")


@register("st1_ingest_stream", f"WITH {PAGES}, c AS (SELECT document_id, count(*) AS page_count, trim(string_agg(text, ''), ' ' || chr(10)) = '' AS blank FROM chunks GROUP BY 1) SELECT document_id, page_count, CASE WHEN blank THEN 'failed' ELSE 'ready' END AS status, CASE WHEN blank THEN 'no text' END AS error FROM c")
def ingested_stream(spark, d):
    """All documents as a stream of pages, through chunks, vectors and status."""
    path = jobs.work_dir(spark)
    pages = _stream(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(a.page_texts()).alias("n", "text")).select("document_id", (F.col("n") + 1).alias("page_number"), "text")
    jobs.ingest_stream(pages, path, f"{path}/c", target=200, most=400, embedder=helpers.hash_vectors(64), dim=64)
    done = files.read_documents(spark, f"{path}/documents")
    ready = (F.col("status") == "ready") & (F.col("n_vectors") == F.col("n_chunks")) & (F.col("n_chunks") > 0)
    return done.select("document_id", "page_count", F.when(ready, "ready").otherwise("failed").alias("status"), "error")
