"""Sources and sinks: raw files, replaceable tables, grid exports and batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.sources import versions

#: Accepted kinds of files.
MIME = {".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """name, size, hash and kind of raw files; contents are dropped at once."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lit(None).cast("string")
    for suffix, mime in MIME.items():
        kind = F.when(F.lower("path").endswith(suffix), mime).otherwise(kind)
    return raw.select(name.alias("filename"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), kind.alias("mime_type"), kind.isNotNull().alias("accepted"))


def replace_documents(rows: DataFrame, path: str, key: str = "document_id", version: int | None = None) -> None:
    """Write rows so that a document's earlier rows go; see ``versions`` for what readers see meanwhile."""
    versions.replace(rows, path, key, version=version)


def read_documents(spark: SparkSession, path: str, key: str = "document_id", before: int | None = None) -> DataFrame | None:
    """The rows of a table that ``replace_documents`` writes."""
    return versions.current(spark, path, key, before=before)


def export_grid_csv(table: DataFrame, path: str) -> None:
    """A grid as CSV with line feeds; the byte order mark rides on the first column's name."""
    first, *rest = table.columns
    table.withColumnRenamed(first, "﻿" + first).select("﻿" + first, *rest).write.mode("overwrite").csv(path, header=True, lineSep="\n", encoding="UTF-8")


ANSWERS = "answers array<struct<column_id:string,value:string,quotes:array<struct<chunk_id:string,text:string>>,confidence:string,not_found:boolean>>"
OUTPUT = "custom_id string, response struct<status_code:int,body:struct<model:string,output:array<struct<type:string,content:array<struct<type:string,text:string>>>>>>, error struct<message:string>"


def read_batch_output(lines: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """custom_id, text, model and error of each result line (column ``value``).

    ``errors`` are the lines of the batch's error file; what it says of a request is that
    request's error. Blank lines are no results.
    """
    parsed = lines.where("trim(value) <> ''").select(F.from_json("value", OUTPUT, {"mode": "PERMISSIVE"}).alias("r"))
    parts = F.flatten(F.transform(F.filter("r.response.body.output", lambda o: o["type"] == "message"), lambda o: F.transform(F.filter(o["content"], lambda c: c["type"] == "output_text"), lambda c: c["text"])))
    text = F.array_join(parts, "")
    error = F.when(F.col("r.custom_id").isNull(), "unreadable line").when(F.col("r.error.message").isNotNull(), F.col("r.error.message")).when(F.coalesce(F.col("r.response.status_code"), F.lit(0)) != 200, F.concat(F.lit("status "), F.coalesce(F.col("r.response.status_code").cast("string"), F.lit("none"))))
    rows = parsed.select("r.custom_id", F.when(error.isNull(), text).alias("text"), F.when(error.isNull(), F.col("r.response.body.model")).alias("model"), error.alias("error"))
    if errors is None:
        return rows
    told = errors.where("trim(value) <> ''").select(F.get_json_object("value", "$.custom_id").alias("custom_id"), F.coalesce(F.get_json_object("value", "$.error"), F.lit("null")).alias("error"))
    told = told.groupBy("custom_id").agg(F.max("error").alias("error"))
    none = F.lit(None).cast("string")
    return rows.join(told.select("custom_id"), "custom_id", "left_anti").unionByName(told.select("custom_id", none.alias("text"), none.alias("model"), "error"))


def parse_answers(results: DataFrame) -> DataFrame:
    """``read_batch_output`` with the answers in the texts as rows' arrays; a text that is no set of answers is an error."""
    parsed = F.from_json("text", ANSWERS, {"mode": "PERMISSIVE"})["answers"]
    rows = results.withColumn("answers", parsed)
    bad = F.col("error").isNull() & F.col("answers").isNull()
    return rows.withColumn("error", F.when(bad, "unparseable output").otherwise(F.col("error")))


def write_eval(summary: DataFrame, per_question: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(f"{path}/summary")
    per_question.write.mode("overwrite").json(f"{path}/questions")
