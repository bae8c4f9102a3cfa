"""Threads: documents, history, stand-in answers, proof of their citations, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions import text as t
from lexspan.operators.grid import sentence_overlap, with_sentence
from lexspan.operators.verify import verify_quotes
from lexspan.settings import DEFAULTS


def thread_documents(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Ready documents of each thread, numbered from 1 in the thread's order."""
    ready = links.join(documents.where("status = 'ready'").select("document_id"), "document_id")
    return ready.withColumn("doc_index", F.row_number().over(Window.partitionBy("thread_id").orderBy("position", "document_id")))


def history(messages: DataFrame, n: int = DEFAULTS.history) -> DataFrame:
    """The last n messages of each thread, oldest first."""
    back = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("position")))
    return messages.withColumn("_back", back).where(F.col("_back") <= n).groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("position", "role", "content"))).alias("messages"))


#: Fixed value: what is said where nothing answers.
NO_ANSWER = "The selected documents do not appear to address this question."


def chat_sentences(passages: DataFrame, questions: DataFrame, *on: str, most: int = 2) -> DataFrame:
    """Per question its best sentences over all passages of its scope, with the mark of each."""
    asked = questions.select(*on, "question_id", t.keywords(F.col("question")).alias("_keys"))
    order = Window.partitionBy("question_id").orderBy(F.desc("overlap"), "document_id", "ordinal", "sentence_no")
    picked = sentence_overlap(passages, asked, *on).withColumn("marker", F.row_number().over(order)).where(F.col("marker") <= most)
    return with_sentence(picked, passages)


def chat_answers(passages: DataFrame, questions: DataFrame, *on: str, picked: DataFrame | None = None) -> DataFrame:
    """Per question its two best sentences with marks (``picked``, if they are known); none: insufficient."""
    said = F.format_string("In %s: %s [%d]", F.col("document_id").cast("string"), F.col("sentence"), F.col("marker"))
    picked = chat_sentences(passages, questions, *on) if picked is None else picked
    joined = picked.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("marker", said.alias("said"))))["said"], " ").alias("answer"), F.count(F.lit(1)).alias("n_citations"))
    every = questions.select("question_id").join(joined, "question_id", "left")
    return every.withColumns({"insufficient": F.col("answer").isNull(), "answer": F.coalesce("answer", F.lit(NO_ANSWER)), "n_citations": F.coalesce("n_citations", F.lit(0))})


def verify_messages(messages: DataFrame, citations: DataFrame, held: DataFrame) -> DataFrame:
    """Messages without the marks of citations that did not hold.

    ``citations``: message_id, marker, quote_id; ``held``: the quote_ids that were verified.
    """
    marked = citations.join(held.select("quote_id", F.lit(True).alias("_ok")), "quote_id", "left")
    summed = marked.groupBy("message_id").agg(F.array_sort(F.collect_set(F.when(F.col("_ok").isNull(), F.col("marker")))).alias("dropped"), F.count("_ok").alias("kept"))
    rows = messages.join(summed, "message_id", "left").withColumns({"dropped": F.coalesce("dropped", F.array().cast("array<int>")), "kept": F.coalesce("kept", F.lit(0))})
    return rows.withColumns({"content": t.strip_markers(F.col("content"), F.col("dropped")), "verified": F.col("insufficient") | ((F.col("kept") > 0) & (F.size("dropped") == 0))})


def prove_messages(messages: DataFrame, citations: DataFrame, hits: DataFrame, chunks: DataFrame, documents: DataFrame, threshold: float = DEFAULTS.fuzzy_threshold) -> tuple[DataFrame, DataFrame]:
    """(messages without the marks of citations that did not hold, the citations that held).

    ``citations`` (message_id, marker, label, quote) name passages by the labels of ``hits``
    (message_id, label, document_id, ordinal); one with an unknown label does not hold. Quotes
    are looked for as those of cells are: in the named passage, then in its document.
    """
    named = citations.withColumn("quote_id", F.concat_ws(":", "message_id", "marker"))
    asked = named.join(hits, ["message_id", "label"]).select("quote_id", "document_id", F.col("ordinal").cast("int").alias("ordinal"), "quote")
    held = verify_quotes(asked, chunks, documents, threshold)
    shown = named.select("message_id", "marker", "quote_id").join(held, "quote_id")
    return verify_messages(messages, named.select("message_id", "marker", "quote_id"), held.select("quote_id")), shown


def thread_summary(threads: DataFrame, links: DataFrame, messages: DataFrame) -> DataFrame:
    """Counts per thread, newest thread first (``place``), and whether a stand-in answered in it.

    Sides are summed before the join; an untitled thread takes its first question, cut at 80.
    """
    documents = links.groupBy("thread_id").agg(F.count(F.lit(1)).alias("documents"))
    user = F.col("role") == "user"
    fake = F.col("model") == "fake" if "model" in messages.columns else F.lit(False)
    spoken = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("messages"), F.min_by(F.when(user, F.col("content")), F.when(user, F.col("position"))).alias("_first"), F.coalesce(F.bool_or(fake), F.lit(False)).alias("_demo"))
    rows = threads.join(documents, "thread_id", "left").join(spoken, "thread_id", "left")
    created = F.col("created_at") if "created_at" in threads.columns else F.lit(None)
    scope = [c for c in ("matter_id",) if c in threads.columns]
    place = F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc_nulls_last("created_at"), "thread_id")) if scope else F.lit(None).cast("int")
    title = F.coalesce("title", F.substring(t.strip(F.col("_first")), 1, 80))
    return rows.withColumn("created_at", created).select("thread_id", *scope, title.alias("title"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("_demo", F.lit(False)).alias("demo"), place.alias("place"))
