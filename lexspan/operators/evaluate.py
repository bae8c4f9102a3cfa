"""Evaluation of cells against golden answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions import helpers
from lexspan.functions import text as t
from lexspan.operators.grid import with_written_dates

NOT_PRESENT = "not present"


def judge(cells: DataFrame, golden: DataFrame, default_date: str | None = None) -> DataFrame:
    """correct, hallucinated and expected_present per (document_id, key) of ``golden``.

    The similarity ratio is computed only for text answers that containment leaves open.
    With ``default_date`` expected dates in words are read too.
    """
    rows = cells.join(golden.select("document_id", "key", "expected"), ["document_id", "key"])
    present = F.lower(F.trim(F.col("expected"))) != NOT_PRESENT
    flat = lambda c: F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("’"), F.lit("'")), r"(?U)\s+", " "))
    rows = rows.withColumns({"expected_present": present, "_p": flat(F.coalesce("value_text", F.lit(""))), "_t": flat(F.col("expected"))})
    rows = with_written_dates(rows, t.collapse_ws(F.col("expected")), default_date)
    want = t.typed_value(t.collapse_ws(F.col("expected")), F.col("output_type"), F.array().cast("array<string>"), F.col("_written"))
    kind, got = F.col("output_type"), F.col("value_json")
    typed = (
        F.when(kind == "boolean", got["bool_value"].eqNullSafe(want["bool_value"]) & want["bool_value"].isNotNull())
        .when(kind == "money", got["amount"].eqNullSafe(want["amount"]) & got["currency"].eqNullSafe(want["currency"]))
        .when(kind == "date", got["date_value"].eqNullSafe(want["date_value"]))
        .when(kind == "enum", got["text_value"].isNull())
    )
    open_text = (F.col("status") == "done") & present & ~F.col("not_found") & (kind == "text")
    contained = (F.col("_t") != "") & F.contains("_p", "_t")
    rows = rows.withColumns({"_typed": typed, "_open": open_text & ~contained, "_contained": contained})
    settled = rows.where(~F.coalesce("_open", F.lit(False))).withColumn("_ratio", F.lit(None).cast("double"))
    unsettled = rows.where(F.coalesce("_open", F.lit(False))).withColumn("_ratio", helpers.similarity(F.col("_p"), F.col("_t")))
    digits = F.col("_t").rlike("^[0-9]+$") & F.contains(F.replace("_p", F.lit(","), F.lit("")), F.col("_t"))
    correct = (
        F.when(F.col("status") != "done", False)
        .when(~F.col("expected_present"), F.col("not_found"))
        .when(F.col("not_found"), False)
        .when(F.col("output_type") != "text", F.coalesce("_typed", F.lit(False)))
        .otherwise(F.col("_contained") | F.coalesce(F.col("_ratio") >= 0.8, F.lit(False)) | digits)
    )
    wrong = (F.col("status") == "done") & ~F.col("expected_present") & ~F.col("not_found")
    return settled.unionByName(unsettled).withColumns({"correct": correct, "hallucinated": wrong}).drop("_p", "_t", "_written", "_typed", "_open", "_contained", "_ratio")


def _rates(frame) -> list:
    done, found = F.col("status") == "done", ~F.col("not_found")
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    absent = F.count_if(~F.col("expected_present"))
    answered = F.count_if(done & found)
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if("correct").alias("correct"),
        F.count_if("hallucinated").alias("hallucinated"),
        absent.alias("expected_absent"),
        F.count_if(done & found & ~F.col("verified")).alias("unverified"),
        F.count_if(~done).alias("failed"),
        ratio(F.count_if("correct"), F.count(F.lit(1))).alias("accuracy"),
        ratio(F.count_if(done & found & F.col("verified")), answered).alias("citation_verification"),
        ratio(F.count_if("hallucinated"), absent).alias("hallucination_rate"),
        ratio(F.count_if(done & ~found & F.col("expected_present")), F.count_if("expected_present")).alias("not_found_when_present"),
    ]


def question_stats(judged: DataFrame) -> DataFrame:
    """Per question and, with a null key, over all: both in one pass by grouping sets."""
    return judged.groupingSets([["key"], []], "key").agg(*_rates(judged))


def eval_summary(judged: DataFrame, verification: float = 0.95, hallucination: float = 0.02) -> DataFrame:
    total = judged.agg(*_rates(judged))
    return total.withColumns({"verification_ok": F.col("citation_verification") >= verification, "hallucination_ok": F.col("hallucination_rate") <= hallucination})


def nearest_rank(rows: DataFrame, value: str, percents: list[float], *keys: str) -> DataFrame:
    """The value at place ``round(p / 100 * (n - 1))`` (half to even) of each key."""
    scope = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    placed = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value), (F.row_number().over(scope.orderBy(value)) - 1).alias("_at"), F.count(F.lit(1)).over(scope).alias("_n"))
    out = [F.max(F.when(F.col("_at") == F.bround(F.lit(p / 100) * (F.col("_n") - 1)), F.col(value))).alias(f"p{p:g}") for p in percents]
    return placed.groupBy(*keys).agg(*out)


def cost(calls: DataFrame, price_in: float, price_cached: float, price_out: float, *keys: str) -> DataFrame:
    spent = ((F.sum("input_tokens") - F.sum("cached_input_tokens")) * price_in + F.sum("cached_input_tokens") * price_cached + F.sum("output_tokens") * price_out) / 1e6
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), spent.alias("cost"))


def sample_misses(judged: DataFrame, per_key: int = 3, most: int = 30) -> DataFrame:
    order = Window.partitionBy("key").orderBy("document_id")
    first = judged.where("NOT correct").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_key)
    return first.orderBy("key", "place").limit(most)


def check_golden(documents: DataFrame, questions: DataFrame, golden: DataFrame) -> DataFrame:
    """Documents that miss a question or have an unknown one, and golden rows without a document."""
    wanted = questions.select("key").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # a handful of questions
    listed = golden.groupBy("document_id").agg(F.array_sort(F.collect_set("key")).alias("_has"), F.count_if(F.lower("expected") == NOT_PRESENT).alias("absent"))
    keys = wanted.first()["keys"]
    rows = documents.select("document_id", F.lit(True).alias("_doc")).join(listed, "document_id", "full")
    want = F.array(*[F.lit(k) for k in keys]).cast("array<string>")
    problem = F.when(F.col("_doc").isNull(), "no document").when(F.col("_has").isNull(), "no golden answers").when(F.size(F.array_except(want, "_has")) > 0, "missing question").when(F.size(F.array_except("_has", want)) > 0, "unknown question")
    return rows.select("document_id", F.coalesce("absent", F.lit(0)).alias("absent"), problem.alias("problem"))
