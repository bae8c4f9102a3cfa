"""The grid of documents and questions: targets, cache, answers, cells, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions import helpers
from lexspan.functions import text as t
from lexspan.settings import DEFAULTS

CELL = ["review_id", "document_id", "column_id"]


def grid_targets(documents: DataFrame, columns: DataFrame, *, document_ids=None, column_ids=None, cells: DataFrame | None = None, batch_from: int = DEFAULTS.batch_threshold_cells) -> DataFrame:
    """Every document of a review with each of its columns; ``mode`` is batch for large reviews.

    The join is on the review; a review has at most a few hundred columns. ``cells`` are
    single cells (review_id, document_id, column_id): only these are targets, each once.
    """
    rows = documents.join(columns, "review_id")
    if document_ids is not None:
        rows = rows.where(F.col("document_id").isin(*document_ids))
    if column_ids is not None:
        rows = rows.where(F.col("column_id").isin(*column_ids))
    if cells is not None:
        rows = rows.join(cells.select(*CELL), CELL, "left_semi")
    totals = rows.groupBy("review_id").agg(F.count(F.lit(1)).alias("total_cells"))
    return rows.join(totals, "review_id").withColumn("mode", F.when(F.col("total_cells") > batch_from, "batch").otherwise("interactive"))


def group_columns(targets: DataFrame, size: int = DEFAULTS.columns_per_call) -> DataFrame:
    """Consecutive groups of columns per document, and each column's label in its group."""
    place = F.row_number().over(Window.partitionBy("review_id", "document_id").orderBy("ordinal", "column_id")) - 1
    return targets.withColumn("_p", place).withColumns({"group_no": F.floor(F.col("_p") / size), "label": F.concat(F.lit("q"), (F.col("_p") % size + 1).cast("string"))}).drop("_p")


def cache_split(targets: DataFrame, cache: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(targets answered by the cache, the others)."""
    if force:
        return targets.limit(0), targets
    return targets.join(cache, "cache_key"), targets.join(cache.select("cache_key"), "cache_key", "left_anti")


def cache_upsert(cache: DataFrame, new: DataFrame, at: str = "updated_at") -> DataFrame:
    """One row per key, the newest."""
    return newest(cache.unionByName(new), ["cache_key"], at)


def newest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The latest row of each key; the maximum is combined before the shuffle."""
    whole = F.struct(at, *[c for c in rows.columns if c not in (*keys, at)])
    return rows.groupBy(*keys).agg(F.max(whole).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


#: How a date and an amount look in a sentence.
DATE = r"\b\d{1,2} \w+ \d{4}\b|\b\d{4}-\d{2}-\d{2}\b"
MONEY = r"[£$€]\s?[\d,]+(?:\.\d+)?(?: per \w+)?"
#: Shorter sentences answer nothing.
SHORTEST = 20


def sentence_overlap(passages: DataFrame, asked: DataFrame, *on: str) -> DataFrame:
    """For each sentence and each key of ``asked`` how many of its words they share: ids and ``overlap`` only.

    ``asked`` has the columns ``on``, an id and the array ``_keys``. Words meet words by
    equality, so sentences that share none with a question are never paired with it, and
    words that nobody asks for are dropped by the join before anything is shuffled.
    """
    ids = [c for c in asked.columns if c not in (*on, "_keys")]
    split = passages.select(*on, *[c for c in ("document_id", "ordinal") if c not in on], F.posexplode(t.sentences(F.col("text"))).alias("sentence_no", "_raw")).withColumn("_raw", t.strip(F.col("_raw")))
    words = split.where(F.char_length("_raw") > SHORTEST).withColumn("_word", F.explode(t.keywords(F.col("_raw")))).drop("_raw")
    keys = asked.withColumn("_word", F.explode("_keys")).drop("_keys")
    return words.join(keys, [*on, "_word"]).groupBy(*ids, "document_id", "ordinal", "sentence_no").agg(F.count(F.lit(1)).cast("int").alias("overlap"))


def _sentence(text: str) -> Column:
    return t.strip(F.get(t.sentences(F.col(text)), F.col("sentence_no")))


def with_sentence(rows: DataFrame, passages: DataFrame, *carry: str) -> DataFrame:
    """``rows`` (document_id, ordinal, sentence_no) with their sentence, cut from its passage, and columns of the passage."""
    texts = passages.select("document_id", "ordinal", F.col("text").alias("_text"), *carry)
    return rows.join(texts, ["document_id", "ordinal"]).withColumn("sentence", _sentence("_text")).drop("_text")


def _with_own_sentence(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """The same for a few rows a document.

    The join is by document alone (the place is no equality, on purpose): passages that lie by
    document are not shuffled again, and a document has few rows for its passages to meet.
    """
    texts = passages.select("document_id", F.col("ordinal").alias("_at"), F.col("text").alias("_text"))
    here = texts.join(rows, (texts["document_id"] == rows["document_id"]) & (F.col("_at") >= F.col("ordinal")) & (F.col("_at") <= F.col("ordinal")))
    return here.select(rows["*"], _sentence("_text").alias("sentence"))


def best_sentences(overlap: DataFrame, *keys: str) -> DataFrame:
    """Per document and key the first of the sentences that share most words; partial maxima before the shuffle."""
    first = F.struct(F.col("overlap"), -F.col("ordinal"), -F.col("sentence_no"))
    best = overlap.groupBy("document_id", *keys).agg(F.max_by(F.struct("ordinal", "sentence_no", "overlap"), first).alias("b"))
    return best.select("document_id", *keys, "b.*")


def extractive_answers(passages: DataFrame, questions: DataFrame, *on: str) -> DataFrame:
    """The first sentence that shares most keywords with a question, as its answer and quote.

    Passages that lie by document (``repartition``) are shuffled nowhere: both reads ask for the same rows.
    """
    for c in ("document_id", *on):
        passages = passages.where(F.col(c).isNotNull())
    asked = questions.select(*on, "column_id", t.keywords(F.col("question")).alias("_keys"))
    best = best_sentences(sentence_overlap(passages, asked, *on), "column_id")
    best = _with_own_sentence(best, passages).join(questions.select("column_id", "output_type", "enum_options"), "column_id")
    option = F.filter("enum_options", lambda o: F.contains(F.lower("sentence"), F.lower(o)))
    day, money = F.regexp_extract("sentence", DATE, 0), F.regexp_extract("sentence", MONEY, 0)
    value = (
        F.when(F.col("output_type") == "boolean", "yes")
        .when((F.col("output_type") == "enum") & (F.size("enum_options") > 0), F.coalesce(F.get(option, F.lit(0)), F.get("enum_options", F.lit(0))))
        .when((F.col("output_type") == "date") & (day != ""), day)
        .when((F.col("output_type") == "money") & (money != ""), money)
        .otherwise(F.col("sentence"))
    )
    sure = F.when(F.col("overlap") >= 3, "high").when(F.col("overlap") == 2, "medium").otherwise("low")
    return best.select("document_id", "column_id", value.alias("value"), F.col("sentence").alias("quote"), F.col("ordinal").alias("chunk_ordinal"), sure.alias("confidence"), "overlap")


def with_not_found(targets: DataFrame, answers: DataFrame) -> DataFrame:
    """Every target with its answer; without one it counts as not found."""
    joined = targets.join(answers, ["document_id", "column_id"], "left")
    return joined.withColumns({"not_found": F.col("value").isNull(), "confidence": F.coalesce("confidence", F.lit("low"))})


def match_answers(targets: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers by group label; unknown labels drop out, targets without an answer fail."""
    matched = targets.join(answers, ["document_id", "group_no", "label"], "left")
    missing = F.col("value").isNull() & F.coalesce(~F.col("not_found"), F.lit(True))
    return matched.withColumns({"status": F.when(missing, "failed").otherwise("done"), "error": F.when(missing, F.lit("model returned no answer for this question"))})


def with_written_dates(rows: DataFrame, text, default_date: str | None) -> DataFrame:
    """``rows`` with ``_written``: the date in words of those of type date that are no ISO dates; only these go to the helper."""
    none = F.lit(None).cast("date")
    if default_date is None:
        return rows.withColumn("_written", none)
    open_ = F.coalesce((F.col("output_type") == "date") & t.parse_iso_date(text).isNull(), F.lit(False))
    worded = rows.where(open_).withColumn("_written", helpers.parse_written_date(default_date)(text))
    return rows.where(~open_).withColumn("_written", none).unionByName(worded)


def reset_cells(existing: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells of a review when a run begins: those of its targets wait without an error, new ones are added, the others stay."""
    waiting = targets.select(*CELL).withColumns({"status": F.lit("pending"), "error": F.lit(None).cast("string")})
    kept = existing.join(targets.select(*CELL), CELL, "left_anti")
    back = waiting.join(existing.drop("status", "error"), CELL, "left")
    return kept.unionByName(back.select(*kept.columns))


def fail_unready(cells: DataFrame, documents: DataFrame) -> DataFrame:
    """``cells`` (status, error, ...) of documents that are not ready have failed, whatever was answered."""
    state = documents.select("document_id", F.col("status").alias("_state"))
    unready = F.coalesce(F.col("_state") != "ready", F.lit(True))
    why = F.concat(F.lit("document is "), F.coalesce("_state", F.lit("missing")), F.lit(", not ready"))
    return cells.join(state, "document_id", "left").withColumns({"status": F.when(unready, "failed").otherwise(F.col("status")), "error": F.when(unready, why).otherwise(F.col("error"))}).drop("_state")


def apply_answers(answers: DataFrame, citations: DataFrame, default_date: str | None = None) -> DataFrame:
    """Cells: verified if not found or if any of its quotes held; a value that was not found is blank.

    Answers with ``status`` failed have no value and are not verified; ``from_cache`` is kept
    (false where it is missing). With ``default_date`` dates in words are read too; it
    supplies the parts that they leave out.
    """
    held = citations.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_citations"))
    cells = answers.join(held, CELL, "left")
    bad = F.coalesce(F.col("status") == "failed", F.lit(False)) if "status" in answers.columns else F.lit(False)
    lost, blank = F.coalesce("not_found", F.lit(False)), bad | F.coalesce("not_found", F.lit(False))
    flat = t.collapse_ws(F.coalesce(F.col("value"), F.lit("")))
    cells = with_written_dates(cells.withColumn("n_citations", F.when(bad, 0).otherwise(F.coalesce("n_citations", F.lit(0)))), flat, default_date)
    typed = t.typed_value(flat, F.col("output_type"), F.col("enum_options"), F.col("_written"))
    cells = cells.withColumns({"value_json": F.when(~blank, typed), "verified": ~bad & (lost | (F.col("n_citations") > 0)), "from_cache": F.coalesce("from_cache", F.lit(False)) if "from_cache" in answers.columns else F.lit(False)})
    return cells.withColumn("value_text", F.when(blank, "").otherwise(t.value_text(flat, F.col("output_type"), F.col("value_json")))).drop("_written")


def grid_table(cells: DataFrame, column_ids: list, row: str = "document_id") -> DataFrame:
    """One row per document, one column per question, in the given order."""
    shown = t.display_value(F.col("status"), F.col("value_text"), F.col("not_found"), F.col("verified"))
    return cells.select(row, "column_id", shown.alias("_shown")).groupBy(row).pivot("column_id", column_ids).agg(F.first("_shown"))


def invalidate_cells(cells: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells of columns whose question, type or options did not change."""
    was = old.select("column_id", *[F.col(c).alias(f"_{c}") for c in ("question", "output_type", "enum_options")])
    same = F.lit(True)
    for c in ("question", "output_type", "enum_options"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    changed = new.join(was, "column_id").where(~same).select("column_id")
    return cells.join(changed, "column_id", "left_anti")


def grid_counts(cells: DataFrame, *keys: str) -> DataFrame:
    done = F.col("status") == "done"
    return cells.groupBy(*keys).agg(
        F.count_distinct("document_id").alias("documents"),
        F.count_distinct("column_id").alias("columns"),
        F.count_if(F.col("status").isin("pending", "running")).alias("in_flight"),
        F.count_if(done & ~F.col("verified") & ~F.col("not_found")).alias("unverified"),
        F.coalesce(F.bool_or(F.col("model") == "fake"), F.lit(False)).alias("demo"),
    )


def with_citations(cells: DataFrame, citations: DataFrame) -> DataFrame:
    """Cells with their citations nested, in order."""
    fields = [c for c in ("quote_pos", "quoted_text", "page", "char_start", "char_end", "match_kind") if c in citations.columns]
    nested = citations.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("citations"))
    return cells.join(nested, CELL, "left")


def review_detail(rows: DataFrame, documents: DataFrame, columns: DataFrame, cells: DataFrame, citations: DataFrame, runs: DataFrame, last: int = 5) -> DataFrame:
    """A review as shown: one row per document in row order, with all that belongs to it nested.

    ``rows`` (review_id, document_id, row_order) without their document drop out. ``cells`` are
    an array in column order, of every column, empty where there is no cell yet, with the
    citations inside. ``runs`` are the review's newest, newest first; ``demo`` tells whether
    any of its cells comes from a stand-in. Each side is summed before it is joined; a row
    never holds more than one document's cells.
    """
    asked = columns.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "column_id", "question"))).alias("columns"))
    shown = with_citations(cells, citations)
    fields = [c for c in shown.columns if c not in ("review_id", "document_id")]
    cell = shown.groupBy("review_id", "document_id").agg(F.map_from_entries(F.collect_list(F.struct("column_id", F.struct(*fields).alias("cell")))).alias("_cells"))
    newest_runs = runs.withColumn("_place", F.row_number().over(Window.partitionBy("review_id").orderBy(F.desc("created_at"), F.desc("run_id")))).where(F.col("_place") <= last)
    listed = newest_runs.groupBy("review_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "run_id", "status"))), lambda r: r.dropFields("_place")).alias("runs"))
    demo = cells.groupBy("review_id").agg(F.coalesce(F.bool_or(F.col("model") == "fake"), F.lit(False)).alias("demo"))
    known = rows.join(documents.select("document_id", F.col("status").alias("document_status"), "page_count"), "document_id")
    whole = known.join(asked, "review_id", "left").join(cell, ["review_id", "document_id"], "left").join(listed, "review_id", "left").join(demo, "review_id", "left")
    in_order = F.transform("columns", lambda c: F.struct(c["column_id"].alias("column_id"), F.try_element_at(F.col("_cells"), c["column_id"]).alias("cell")))
    return whole.select("review_id", "document_id", "row_order", "document_status", "page_count", "columns", in_order.alias("cells"), "runs", F.coalesce("demo", F.lit(False)).alias("demo"))


def is_set(column: Column) -> Column:
    return F.coalesce(column, F.lit("")) != ""
