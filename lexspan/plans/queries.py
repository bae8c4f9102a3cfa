"""Registered queries of the review library, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexspan.functions import helpers
from lexspan.functions import text as t
from lexspan.operators import assistant, evaluate, grid, ingest, listing, playbook, retrieve, verify
from lexspan.plans import adapters as a

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return wrap


#: Shared parts of the SQL: reviews, lines, pages with offsets, questions.
REVIEW = f"({{}} % (SELECT greatest(1, count(*) // {a.PER_REVIEW}) FROM benchmark))"
LINES = "lines AS (SELECT doc_id, i - 1 AS ln, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d, unnest(range(1, len(l) + 1)) AS u(i))"
PAGES = LINES + (
    ", raw_pages AS (SELECT doc_id AS document_id, (ln // 5 + 1)::INT AS page_number, string_agg(line, chr(10) || chr(10) ORDER BY ln) AS text FROM lines GROUP BY 1, 2)"
    ", pages AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS char_offset FROM raw_pages)"
    f", chunks AS (SELECT document_id, page_number - 1 AS ordinal, text, char_offset AS char_start, char_offset + length(text) AS char_end, {REVIEW.format('document_id')} AS review_id FROM pages)"
)
STOPS = "[" + ", ".join(f"'{w}'" for w in t.STOP_WORDS) + "]"
CHAT_STOPS = "[" + ", ".join(f"'{w}'" for w in t.ASSISTANT_STOP_WORDS) + "]"
FUNCTION_WORDS = "[" + ", ".join(f"'{w}'" for w in t.FUNCTION_WORDS) + "]"
QUESTIONS = f"questions AS (SELECT item_id AS question_id, text AS question, {REVIEW.format('item_id')} AS review_id FROM benchmark)"
STEM = "x"
for _suffix in reversed(t.SUFFIXES):
    STEM = f"CASE WHEN suffix(x, '{_suffix}') AND length(x) - {len(_suffix)} >= 4 THEN x[1:length(x) - {len(_suffix)}]{' || chr(121)' if _suffix == 'ies' else ''} ELSE {STEM} END"


def keys_sql(column: str, stemmed: bool = True) -> str:
    pattern = "[a-z0-9£$€%]+" if stemmed else "[a-z0-9]+"
    kept = f"list_filter(regexp_extract_all(lower({column}), '{pattern}'), lambda x: length(x) > 2 AND NOT list_contains({STOPS if stemmed else CHAT_STOPS}, x))"
    return f"list_sort(list_distinct({f'list_transform({kept}, lambda x: {STEM})' if stemmed else kept}))"


# --- text functions -----------------------------------------------------------------------


@register(
    "t1_t2_t12_text",
    "SELECT doc_id, greatest(1, (length(text) + 3) // 4)::INT AS tokens, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed, md5(source || chr(10) || text) AS embedding_input FROM documents",
)
def text_scalars(spark, d):
    text = F.col("text")
    return a.table(spark, d, "documents").select("doc_id", t.estimate_tokens(text).alias("tokens"), F.md5(t.collapse_ws(text)).alias("collapsed"), F.md5(t.embedding_input(F.col("source"), text)).alias("embedding_input"))


NUMBERED = "CASE ln % 4 WHEN 0 THEN (doc_id % 9 + 1) || '. ' || line WHEN 1 THEN '8.2 ' || line WHEN 2 THEN '(a) ' || line ELSE 'ARTICLE IV ' || line END"


@register(
    "t4_markers",
    f"WITH {LINES} SELECT doc_id, ln::INT AS ln, CASE ln % 4 WHEN 0 THEN CASE WHEN length(trim(line)) <= 120 THEN 1 END WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END::INT AS depth FROM lines WHERE trim(line) <> ''",
)
def markers(spark, d):
    rows = a.lines(spark, d).where("trim(line) <> ''")
    numbered = F.expr("CASE ln % 4 WHEN 0 THEN concat(doc_id % 9 + 1, '. ', line) WHEN 1 THEN concat('8.2 ', line) WHEN 2 THEN concat('(a) ', line) ELSE concat('ARTICLE IV ', line) END")
    return rows.select("doc_id", "ln", t.detect_marker(numbered)["depth"].alias("depth"))


@register("t5_keywords", f"SELECT doc_id, len(k) AS n_keywords, md5(array_to_string(k, ',')) AS keywords FROM (SELECT doc_id, {keys_sql('text')} AS k FROM documents)")
def keyword_sets(spark, d):
    k = a.table(spark, d, "documents").select("doc_id", t.keywords(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").alias("n_keywords"), F.md5(F.array_join("k", ",")).alias("keywords"))


@register("t5_assistant_keywords", f"SELECT doc_id, len(k) AS n_keywords, md5(array_to_string(k, ',')) AS keywords FROM (SELECT doc_id, {keys_sql('text', False)} AS k FROM documents)")
def assistant_keyword_sets(spark, d):
    k = a.table(spark, d, "documents").select("doc_id", t.keywords(F.col("text"), stemmed=False).alias("k"))
    return k.select("doc_id", F.size("k").alias("n_keywords"), F.md5(F.array_join("k", ",")).alias("keywords"))


@register(
    "t6_lexical_terms",
    "SELECT item_id, CASE WHEN len(k) > 0 THEN array_to_string(k, ' OR ') ELSE text END AS query FROM (SELECT item_id, text, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''-]+'), lambda x: length(x) > 2), lambda x: lower(x)))) AS k FROM benchmark)",
)
def lexical_queries(spark, d):
    return a.table(spark, d, "benchmark").select("item_id", t.lexical_query(F.col("text")).alias("query"))


@register(
    "t7_sentences",
    "SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences FROM (SELECT doc_id, string_split(regexp_replace(text, '([.;:!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents)",
)
def sentence_lists(spark, d):
    s = a.table(spark, d, "documents").select("doc_id", t.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences"))


EVENT_TEXT = "CASE event_id % 5 WHEN 0 THEN CASE user_id % 3 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'no' ELSE 'unclear' END WHEN 1 THEN '£' || user_id || ',500 per annum' WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN 'it is ' || upper(event_type) ELSE '  ' || event_type || '   text ' END"
EVENT_KIND = "CASE event_id % 5 WHEN 0 THEN 'boolean' WHEN 1 THEN 'money' WHEN 2 THEN 'date' WHEN 3 THEN 'enum' ELSE 'text' END"


@register(
    "t8_values",
    f"""WITH r AS (SELECT event_id, user_id, ts, event_type, trim(regexp_replace({EVENT_TEXT}, '\\s+', ' ', 'g')) AS v, {EVENT_KIND} AS k FROM events)
    SELECT event_id, CASE WHEN k = 'boolean' THEN CASE WHEN v = 'Yes.' THEN true WHEN v = 'no' THEN false END END AS bool_value,
    CASE WHEN k = 'money' THEN (user_id || '500')::DOUBLE END AS amount, CASE WHEN k = 'money' THEN 'GBP' END AS currency, CASE WHEN k = 'date' THEN v END AS date_value,
    CASE WHEN k = 'enum' THEN CASE WHEN event_type IN ('click', 'view') THEN event_type END WHEN k = 'text' THEN v END AS text_value,
    CASE WHEN k = 'boolean' AND v = 'Yes.' THEN 'Yes' WHEN k = 'boolean' AND v = 'no' THEN 'No' WHEN k = 'enum' AND event_type IN ('click', 'view') THEN event_type ELSE v END AS value_text FROM r""",
)
def values(spark, d):
    e = a.table(spark, d, "events")
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN CASE user_id % 3 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'no' ELSE 'unclear' END WHEN 1 THEN concat('£', user_id, ',500 per annum') WHEN 2 THEN date_format(ts, 'yyyy-MM-dd') WHEN 3 THEN concat('it is ', upper(event_type)) ELSE concat('  ', event_type, '   text ') END")
    kind = F.expr("CASE event_id % 5 WHEN 0 THEN 'boolean' WHEN 1 THEN 'money' WHEN 2 THEN 'date' WHEN 3 THEN 'enum' ELSE 'text' END")
    rows = e.select("event_id", t.collapse_ws(raw).alias("v"), kind.alias("k"))
    typed = t.typed_value(F.col("v"), F.col("k"), F.array(F.lit("click"), F.lit("view")))
    rows = rows.withColumn("x", typed)
    return rows.select("event_id", "x.bool_value", "x.amount", "x.currency", F.col("x.date_value").cast("string").alias("date_value"), "x.text_value", t.value_text(F.col("v"), F.col("k"), F.col("x")).alias("value_text"))


@register("t8d_written_dates", "SELECT event_id, strftime(ts::DATE, '%Y-%m-%d') AS day, strftime(ts::DATE, '%Y-%m-%d') AS \"right\" FROM events")
def written_dates(spark, d):
    e = a.table(spark, d, "events")
    return e.select("event_id", helpers.parse_written_date()(F.date_format("ts", "'signed on' d MMMM yyyy")).cast("string").alias("day"), F.to_date("ts").cast("string").alias("right"))


@register(
    "t9_cache_key",
    "SELECT doc_id, item_id, sha256(concat_ws(chr(31), sha256(coalesce(d.text, '')), trim(regexp_replace(b.text, '\\s+', ' ', 'g')), 'text', 'a' || chr(30) || 'b', 'fake', 'v2')) AS cache_key FROM documents d JOIN benchmark b ON " + REVIEW.format("d.doc_id") + " = " + REVIEW.format("b.item_id"),
)
def cache_keys(spark, d):
    targets = grid.grid_targets(a.documents(spark, d), a.columns(spark, d))
    key = t.cache_key(F.col("sha256"), F.col("question"), F.col("output_type"), F.array(F.lit("b"), F.lit("a")), F.lit("fake"), F.lit("v2"))
    return targets.select(F.col("document_id").alias("doc_id"), F.col("column_id").alias("item_id"), key.alias("cache_key"))


@register(
    "t10_t11_display",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[pending]' WHEN 1 THEN 'Not found' WHEN 2 THEN event_type || ' [UNVERIFIED]' ELSE event_type END AS shown,
    regexp_replace(event_type || ' [1]. More [2]. Last [3].', '\\s?\\[' || (event_id % 3 + 1) || '\\]', '', 'g') AS stripped FROM events""",
)
def display(spark, d):
    e = a.table(spark, d, "events")
    shown = t.display_value(F.when(F.col("event_id") % 4 == 0, "pending").otherwise("done"), F.col("event_type"), F.col("event_id") % 4 == 1, F.col("event_id") % 4 == 3)
    return e.select("event_id", shown.alias("shown"), t.strip_markers(F.concat("event_type", F.lit(" [1]. More [2]. Last [3].")), F.array((F.col("event_id") % 3 + 1).cast("int"))).alias("stripped"))


@register("t3_normalize")
def normalized(spark, d):
    n = a.table(spark, d, "documents").select("doc_id", helpers.normalize_text(F.col("text")).alias("n"))
    return n.select("doc_id", F.md5("n.text").alias("text"), F.size("n.places").alias("size"))


@register("t13_hash_embed", f"WITH {PAGES} SELECT document_id, ordinal::INT AS ordinal, 1536 AS dim, 1.0::DOUBLE AS norm, (('0x' || sha256(text)[7:8] || sha256(text)[5:6] || sha256(text)[3:4] || sha256(text)[1:2])::BIGINT >= 2147483648) AS first_positive FROM chunks")
def embedded(spark, d):
    """The vectors of all passages at full size; the first number's sign follows from the first digest."""
    e = a.page_chunks(spark, d).select("document_id", "ordinal", helpers.hash_embed()(F.col("text")).alias("v"))
    return e.select("document_id", "ordinal", F.size("v").alias("dim"), F.round(retrieve.dot(F.col("v"), F.col("v")), 4).alias("norm"), (F.get("v", F.lit(0)) >= 0).alias("first_positive"))


# --- structure ----------------------------------------------------------------------------


@register("x1_assemble", f"WITH {PAGES} SELECT document_id, md5(string_agg(text, chr(10) ORDER BY page_number)) AS text, max(char_offset)::INT AS last_offset, count(*) AS n_pages FROM pages GROUP BY 1")
def assembled(spark, d):
    p = a.pages(spark, d)
    return ingest.assemble_text(p).select("document_id", F.md5("text").alias("text")).join(p.groupBy("document_id").agg(F.max("char_offset").alias("last_offset"), F.count(F.lit(1)).alias("n_pages")), "document_id")


BLOCKS = PAGES + (
    ", placed AS (SELECT doc_id, ln, line, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id, ln // 5 ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM lines)"
    ", blocks AS (SELECT document_id, page_number, trim(line) AS text, (char_offset + pos + length(line) - length(ltrim(line)))::INT AS char_start FROM placed JOIN pages ON document_id = doc_id AND page_number = ln // 5 + 1 WHERE trim(line) <> '')"
)


@register("x2_blocks", f"WITH {BLOCKS} SELECT document_id, page_number, md5(text) AS text, char_start, (char_start + length(text))::INT AS char_end FROM blocks")
def block_rows(spark, d):
    return ingest.blocks_from_pages(a.pages(spark, d)).select("document_id", "page_number", F.md5("text").alias("text"), "char_start", "char_end")


HEADS = "CASE char_start % 7 WHEN 0 THEN 'ARTICLE IV' WHEN 1 THEN '5. Terms' WHEN 2 THEN '5.1' WHEN 3 THEN '(b)' END"


@register(
    "x3_section_paths",
    f"""WITH {BLOCKS}, m AS (SELECT document_id, char_start, CASE char_start % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS d, {HEADS} AS label FROM blocks),
    l AS (SELECT document_id, char_start, {', '.join(f"last_value(CASE WHEN d <= {k} THEN d || '|' || label END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY char_start ROWS UNBOUNDED PRECEDING) AS l{k}" for k in range(4))} FROM m)
    SELECT document_id, char_start, concat_ws(' > ', {', '.join(f"CASE WHEN l{k}[1:1] = '{k}' THEN l{k}[3:] END" for k in range(4))}) AS section_path FROM l""",
)
def paths(spark, d):
    blocks = ingest.blocks_from_pages(a.pages(spark, d))
    head = F.expr("CASE char_start % 7 WHEN 0 THEN 'ARTICLE IV' WHEN 1 THEN '5. Terms' WHEN 2 THEN '5.1' WHEN 3 THEN '(b) item' ELSE 'plain words.' END")
    return ingest.section_paths(blocks.withColumn("text", head)).select("document_id", "char_start", "section_path")


@register("x5_chunks")
def chunk_rows(spark, d):
    return ingest.chunk_documents(a.pages(spark, d), 200, 400).withColumn("text", F.md5("text"))


@register(
    "x6_page_for_offset",
    f"WITH {PAGES} SELECT p.document_id, p.page_number, max(q.page_number) AS found FROM pages p JOIN pages q ON p.document_id = q.document_id AND q.char_offset <= p.char_offset + length(p.text) // 2 GROUP BY 1, 2",
)
def pages_found(spark, d):
    p = a.pages(spark, d)
    rows = p.select("document_id", "page_number", (F.col("char_offset") + F.floor(F.char_length("text") / 2)).alias("at"))
    return ingest.page_for_offset(rows, p, "at").select("document_id", "page_number", F.col("at_page").alias("found"))


@register(
    "x7_bboxes",
    f"""WITH {PAGES}, w AS (SELECT document_id, page_number, char_offset + coalesce(sum(length(tok) + 1) OVER (PARTITION BY document_id, page_number ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(tok) AS n
      FROM (SELECT document_id, page_number, char_offset, i, string_split(text, ' ')[i] AS tok FROM pages, unnest(range(1, len(string_split(text, ' ')) + 1)) AS u(i)))
    SELECT p.document_id, p.page_number, count(*) AS n_words FROM pages p JOIN w ON p.document_id = w.document_id AND w.s + w.n > p.char_offset AND w.s < p.char_offset + 40 AND w.n > 0 GROUP BY 1, 2""",
)
def boxes(spark, d):
    p = a.pages_with_words(spark, d)
    spans = p.select("document_id", F.col("page_number").alias("span_id"), F.col("char_offset").alias("char_start"), (F.col("char_offset") + 40).alias("char_end"))
    total = F.aggregate(F.map_values("bboxes"), F.lit(0), lambda s, x: s + F.size(x))
    return ingest.bboxes_for_span(spans, p).select("document_id", F.col("span_id").alias("page_number"), total.cast("long").alias("n_words"))


@register("x8_check_offsets", f"WITH {PAGES} SELECT document_id, 'chunk slice' AS problem FROM chunks WHERE ordinal % 3 = 1 AND length(text) > 0 UNION ALL SELECT document_id, 'no text' FROM raw_pages GROUP BY 1 HAVING trim(string_agg(text, ''), ' ' || chr(10)) = ''")
def offset_check(spark, d):
    chunks = a.page_chunks(spark, d)
    broken = chunks.withColumn("text", F.when(F.col("ordinal") % 3 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).where("ordinal % 3 <> 1 OR char_end > char_start")
    return ingest.check_offsets(a.pages(spark, d), broken)


@register("x9_outline", f"WITH {LINES}, f AS (SELECT doc_id AS document_id, left(line, 12) AS section_path, min(ln)::INT AS first_ordinal FROM lines WHERE line <> '' GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY first_ordinal)::INT AS place FROM f) WHERE place <= 10")
def outlines(spark, d):
    chunks = a.lines(spark, d).select(F.col("doc_id").alias("document_id"), F.col("ln").alias("ordinal"), F.substring("line", 1, 12).alias("section_path"))
    return ingest.outline(chunks, 10)


def _some_fail(texts):
    """The hash embedder, with vectors of a wrong size for texts that begin with the letter T."""
    return pd.Series([v[:-1] if s.startswith("T") else v for s, v in zip(texts, helpers.hash_vectors(64)(texts), strict=True)])


# The packing of chunks has no SQL form, so the query takes pages as passages; chunks are tested in pytest.
@register(
    "x10_ingest",
    f"""WITH {PAGES}, c AS (SELECT document_id, count(*) AS n_chunks, count(*) FILTER (NOT starts_with(text, 'T')) AS n_vectors, max(CASE WHEN starts_with(text, 'T') THEN 'vector of size 63 instead of 64' END) AS bad, trim(string_agg(text, ''), ' ' || chr(10)) = '' AS blank FROM chunks GROUP BY 1),
    e AS (SELECT *, concat_ws('; ', CASE WHEN blank THEN 'no text' END, bad) AS error FROM c)
    SELECT document_id, n_chunks AS page_count, n_chunks, n_vectors, CASE WHEN error = '' THEN 'ready' ELSE 'failed' END AS status, nullif(error, '') AS error FROM e""",
)
def ingested(spark, d):
    chunks = ingest.embed_chunks(a.page_chunks(spark, d), _some_fail, dim=64)
    return ingest.document_status(a.pages(spark, d), chunks)


@register("x10_chunked")
def ingested_chunks(spark, d):
    return ingest.ingest(a.pages(spark, d), 200, 400, embedder=helpers.hash_vectors(64), dim=64)[0]


# --- retrieval ----------------------------------------------------------------------------

TERMS = QUESTIONS + f", terms AS (SELECT DISTINCT question_id, review_id, lower(w) AS term FROM (SELECT question_id, review_id, unnest(regexp_extract_all(question, '[A-Za-z0-9][A-Za-z0-9''-]+')) AS w FROM questions) WHERE length(w) > 2 AND NOT list_contains({FUNCTION_WORDS}, lower(w)))"
TOKENS = "tok AS (SELECT document_id, ordinal, review_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''-]+'))) AS term FROM chunks)"
HITS = f"WITH {PAGES}, {TERMS}, {TOKENS}, hits AS (SELECT question_id, document_id, ordinal, count(*) AS positions, count(DISTINCT term) AS terms FROM tok JOIN terms USING (term, review_id) GROUP BY 1, 2, 3)"
LEXICAL = HITS + ", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, document_id ORDER BY positions DESC, terms DESC, document_id, ordinal) - 1 AS rank FROM hits) WHERE rank < 3)"
REVIEWED = ("review_id",)


@register("r1_lexical_topk", LEXICAL + " SELECT question_id, document_id, ordinal::INT AS ordinal, positions, terms, rank::INT AS rank FROM top")
def lexical(spark, d):
    return retrieve.lexical_topk(a.page_chunks(spark, d), a.questions(spark, d), 3, on=REVIEWED)


def _vectors(spark, d):
    e = a.table(spark, d, "embeddings").select(F.col("label").alias("document_id"), F.col("vec_id").cast("int").alias("ordinal"), "embedding")
    return e, e.where("ordinal % 50 = 0").select(F.col("ordinal").alias("question_id"), "document_id", "embedding")


VECTORS = "WITH q AS (SELECT vec_id AS question_id, label, embedding FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT q.question_id, e.label AS document_id, e.vec_id AS ordinal, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS distance FROM embeddings e JOIN q ON e.label = q.label)"


@register("r2_vector_topk", VECTORS + " SELECT question_id::INT AS question_id, document_id, ordinal::INT AS ordinal, round(distance, 6) AS distance, (row_number() OVER (PARTITION BY question_id ORDER BY distance, document_id, ordinal) - 1)::INT AS rank FROM p QUALIFY rank < 5")
def vector(spark, d):
    passages, queries = _vectors(spark, d)
    return retrieve.vector_topk(passages, queries, 5).select("question_id", "document_id", "ordinal", F.round("distance", 6).alias("distance"), "rank")


@register("r2_vector_across", VECTORS.replace("ON e.label = q.label", "ON true") + " SELECT question_id::INT AS question_id, document_id, ordinal::INT AS ordinal, round(distance, 6) AS distance, (row_number() OVER (PARTITION BY question_id ORDER BY distance, document_id, ordinal) - 1)::INT AS rank FROM p WHERE distance <= 0.6 QUALIFY rank < 5")
def vector_across(spark, d):
    passages, queries = _vectors(spark, d)
    return retrieve.vector_topk(passages, queries, 5, max_distance=0.6, across=True).select("question_id", "document_id", "ordinal", F.round("distance", 6).alias("distance"), "rank")


#: Vectors of passages and questions, their distances inside a review, and both rankings fused.
VECTORED = (
    ", cv AS (SELECT c.document_id, c.ordinal, c.review_id, e.embedding FROM chunks c JOIN embeddings e ON e.vec_id = (c.document_id * 31 + c.ordinal * 7) % (SELECT count(*) FROM embeddings))"
    ", qv AS (SELECT q.question_id, q.review_id, e.embedding FROM questions q JOIN embeddings e ON e.vec_id = q.question_id * 13 % (SELECT count(*) FROM embeddings))"
    ", near AS (SELECT question_id, document_id, ordinal, round(1 - list_cosine_similarity(cv.embedding::DOUBLE[], qv.embedding::DOUBLE[]), 12) AS distance FROM cv JOIN qv USING (review_id))"
)
FUSED = (
    VECTORED
    + ", vtop AS (SELECT *, row_number() OVER (PARTITION BY question_id, document_id ORDER BY distance, document_id, ordinal) - 1 AS rank FROM near QUALIFY rank < 3)"
    + ", fused AS (SELECT question_id, document_id, ordinal, max(l) AS l, max(v) AS v, coalesce(1.0::DOUBLE / (61 + max(l)), 0.0) + coalesce(1.0::DOUBLE / (61 + max(v)), 0.0) AS score"
    " FROM (SELECT question_id, document_id, ordinal, rank AS l, NULL AS v FROM top UNION ALL SELECT question_id, document_id, ordinal, NULL, rank FROM vtop) GROUP BY 1, 2, 3)"
    ", best AS (SELECT *, row_number() OVER (PARTITION BY question_id, document_id ORDER BY score DESC, l NULLS LAST, v NULLS LAST, document_id, ordinal) AS place FROM fused QUALIFY place <= 3)"
)


def _vector_hits(spark, d, k=3):
    return retrieve.vector_topk(a.chunk_vectors(spark, d), a.question_vectors(spark, d), k, on=REVIEWED)


@register("r3_rrf", LEXICAL + FUSED + " SELECT question_id, document_id, ordinal::INT AS ordinal, round(score, 9) AS score, place::INT AS place FROM best")
def fused(spark, d):
    words = retrieve.lexical_topk(a.page_chunks(spark, d), a.questions(spark, d), 3, on=REVIEWED)
    best = retrieve.fused_topk(retrieve.rrf(words, _vector_hits(spark, d)), 3)
    return best.select("question_id", "document_id", "ordinal", F.round("score", 9).alias("score"), "place")


@register("r4_neighbours", LEXICAL + " SELECT DISTINCT question_id, c.document_id, c.ordinal::INT AS ordinal FROM top JOIN chunks c ON c.document_id = top.document_id AND c.ordinal BETWEEN top.ordinal - 1 AND top.ordinal + 1")
def neighbours(spark, d):
    chunks = a.page_chunks(spark, d)
    return retrieve.with_neighbours(retrieve.lexical_topk(chunks, a.questions(spark, d), 3, on=REVIEWED), chunks).select("question_id", "document_id", "ordinal")


@register(
    "r5_context",
    LEXICAL
    + FUSED
    + """, size AS (SELECT document_id, greatest(1, (max(char_end) + 3) // 4) AS tokens FROM chunks GROUP BY 1), long AS (SELECT c.* FROM chunks c JOIN size USING (document_id) WHERE tokens > 500), found AS (SELECT DISTINCT c.document_id, c.ordinal FROM best JOIN long c ON c.document_id = best.document_id AND c.ordinal BETWEEN best.ordinal - 1 AND best.ordinal + 1)
    SELECT document_id, ordinal::INT AS ordinal, 'full' AS mode, 'c' || ordinal AS label FROM chunks JOIN size USING (document_id) WHERE tokens <= 500 UNION ALL SELECT document_id, ordinal::INT, 'retrieval', 'c' || ordinal FROM found
    UNION ALL SELECT document_id, ordinal::INT, 'opening', 'c' || ordinal FROM long WHERE ordinal < 3 AND document_id NOT IN (SELECT document_id FROM found)""",
)
def contexts(spark, d):
    return retrieve.build_context(a.page_chunks(spark, d), a.questions(spark, d), limit=500, k=3, vector_hits=_vector_hits(spark, d), on=REVIEWED)


@register(
    "r5_context_words",
    LEXICAL
    + """, size AS (SELECT document_id, greatest(1, (max(char_end) + 3) // 4) AS tokens FROM chunks GROUP BY 1), long AS (SELECT c.* FROM chunks c JOIN size USING (document_id) WHERE tokens > 500), found AS (SELECT DISTINCT c.document_id, c.ordinal FROM top JOIN long c ON c.document_id = top.document_id AND c.ordinal BETWEEN top.ordinal - 1 AND top.ordinal + 1)
    SELECT document_id, ordinal::INT AS ordinal, 'full' AS mode, 'c' || ordinal AS label FROM chunks JOIN size USING (document_id) WHERE tokens <= 500 UNION ALL SELECT document_id, ordinal::INT, 'retrieval', 'c' || ordinal FROM found
    UNION ALL SELECT document_id, ordinal::INT, 'opening', 'c' || ordinal FROM long WHERE ordinal < 3 AND document_id NOT IN (SELECT document_id FROM found)""",
)
def word_contexts(spark, d):
    return retrieve.build_context(a.page_chunks(spark, d), a.questions(spark, d), limit=500, k=3, on=REVIEWED)


ACROSS_K = 16
ACROSS = (
    HITS
    + VECTORED
    + f""", lx AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY positions DESC, terms DESC, document_id, ordinal) - 1 AS rank FROM hits QUALIFY rank < {2 * ACROSS_K}),
    vx AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, document_id, ordinal) - 1 AS rank FROM near WHERE distance <= 0.6 QUALIFY rank < {2 * ACROSS_K}),
    fx AS (SELECT question_id, document_id, ordinal, max(l) AS l, max(v) AS v, coalesce(1.0::DOUBLE / (61 + max(l)), 0.0) + coalesce(1.0::DOUBLE / (61 + max(v)), 0.0) AS score
      FROM (SELECT question_id, document_id, ordinal, rank AS l, NULL AS v FROM lx UNION ALL SELECT question_id, document_id, ordinal, NULL, rank FROM vx) GROUP BY 1, 2, 3),
    qw AS (SELECT question_id, {keys_sql('question', False)} AS k FROM questions), cw AS (SELECT c.document_id, c.ordinal, {keys_sql('c.text', False)} AS w FROM chunks c SEMI JOIN fx ON fx.document_id = c.document_id AND fx.ordinal = c.ordinal),
    sx AS (SELECT fx.* REPLACE (score + 0.05::DOUBLE * (len(list_intersect(k, w))::DOUBLE / greatest(len(k), 1)) AS score) FROM fx JOIN qw USING (question_id) JOIN cw USING (document_id, ordinal)),
    best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, l NULLS LAST, v NULLS LAST, document_id, ordinal) AS place FROM sx QUALIFY place <= {ACROSS_K}),
    nb AS (SELECT b.question_id, b.document_id, c.ordinal, b.score / 2 AS score FROM best b JOIN chunks c ON c.document_id = b.document_id AND abs(c.ordinal - b.ordinal) = 1 WHERE place <= 4),
    every AS (SELECT question_id, document_id, ordinal, coalesce(max(score) FILTER (NOT near), max(score)) AS score, bool_and(near) AS neighbour FROM (SELECT question_id, document_id, ordinal, score, false AS near FROM best UNION ALL SELECT *, true FROM nb) GROUP BY 1, 2, 3),
    ix AS (SELECT doc_id AS document_id, row_number() OVER (PARTITION BY {REVIEW.format('doc_id')} ORDER BY doc_id) AS doc_index FROM documents)"""
)


@register("r6_retrieve_across", ACROSS + " SELECT question_id, document_id, ordinal::INT AS ordinal, round(score, 9) AS score, neighbour, 'd' || doc_index || 'c' || ordinal AS label, row_number() OVER (PARTITION BY question_id ORDER BY doc_index, ordinal)::INT AS place FROM every JOIN ix USING (document_id)")
def across(spark, d):
    near = retrieve.vector_topk(a.chunk_vectors(spark, d), a.question_vectors(spark, d), 2 * ACROSS_K, max_distance=0.6, on=REVIEWED, per=())
    rows = retrieve.retrieve_across(a.page_chunks(spark, d), a.questions(spark, d), ACROSS_K, documents=a.indexed_documents(spark, d), vector_hits=near, on=REVIEWED)
    return rows.withColumn("score", F.round("score", 9))


#: Every other turn of a user is asked by its first letters alone and has no vector.
ASKED = "SELECT conv_id * 1000 + turn AS question_id, CASE WHEN turn % 4 = 0 THEN left(text, 4) ELSE text END AS question, turn % 4 <> 0 AS has_vector, conv_id FROM conversations WHERE role = 'user'"


@register(
    "r7_unanswerable",
    f"WITH {PAGES}, asked AS ({ASKED}), {TOKENS}, words AS (SELECT DISTINCT term FROM tok), terms AS (SELECT question_id, lower(unnest(regexp_extract_all(question, '[A-Za-z0-9][A-Za-z0-9''-]+'))) AS term FROM asked),"
    f" hit AS (SELECT question_id FROM terms JOIN words USING (term) WHERE length(term) > 2 AND NOT list_contains({FUNCTION_WORDS}, term)),"
    " qv AS (SELECT question_id, embedding FROM asked JOIN embeddings ON vec_id = conv_id % (SELECT count(*) FROM embeddings) WHERE has_vector),"
    " near AS (SELECT question_id FROM qv JOIN embeddings e ON round(1 - list_cosine_similarity(e.embedding::DOUBLE[], qv.embedding::DOUBLE[]), 12) <= 0.6)"
    " SELECT question_id, question FROM asked WHERE question_id NOT IN (SELECT question_id FROM hit) AND question_id NOT IN (SELECT question_id FROM near)",
)
def refused(spark, d):
    turns = a.table(spark, d, "conversations").where("role = 'user'")
    asked = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.expr("CASE WHEN turn % 4 = 0 THEN left(text, 4) ELSE text END").alias("question"), "conv_id", "turn")
    passages, _ = _vectors(spark, d)
    vectors = a.table(spark, d, "embeddings").select(F.col("vec_id").alias("_vec"), "embedding")
    queries = asked.where("turn % 4 <> 0").withColumn("_vec", F.pmod("conv_id", F.lit(vectors.count()))).join(vectors, "_vec")
    words = retrieve.worded(a.table(spark, d, "documents").select("text"), asked)
    near = retrieve.near_any(passages, queries, 0.6)
    return retrieve.unanswerable(asked, words, near).select("question_id", "question")
