"""Scoping, counting, deduplication and removal over plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scoped(rows: DataFrame, workspace) -> DataFrame:
    return rows.where(F.col("workspace_id") == workspace)


def foreign_rows(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is not in their own workspace."""
    return rows.join(parents.select("workspace_id", key).distinct(), ["workspace_id", key], "left_anti")


def child_counts(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents with the number of their children, zero included."""
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias("children"))
    return parents.join(counts, key, "left").withColumn("children", F.coalesce("children", F.lit(0)))


def dedupe_documents(documents: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Documents with the id of the first one of equal content in their scope.

    Only hashes travel, and the first is found by a minimum that is combined before the shuffle.
    """
    first = documents.groupBy(*scope, "sha256").agg(F.min(F.struct(*order)).alias("_first"))
    return documents.join(first, [*scope, "sha256"]).withColumns({"kept_id": F.col(f"_first.{order[-1]}"), "duplicate": F.struct(*order) != F.col("_first")}).drop("_first")


def latest(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def append_rows(existing: DataFrame, new: DataFrame, review: str = "review_id", matter: str | None = None) -> tuple[DataFrame, DataFrame] | DataFrame:
    """New documents of a review, numbered on from its last row.

    With ``matter``, a column of ``new`` and of ``existing``, documents of another matter than
    their review's are refused: (rows to append, refused rows).
    """
    held = [F.max("row_order").alias("_last"), *([F.max(matter).alias("_matter")] if matter else [])]
    last = existing.groupBy(review).agg(*held)
    fresh = new.join(existing.select(review, "document_id"), [review, "document_id"], "left_anti").join(last, review, "left")
    number = F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy(review).orderBy("document_id"))
    if matter is None:
        return fresh.withColumn("row_order", number).drop("_last")
    foreign = F.coalesce(F.col(matter) != F.col("_matter"), F.lit(False))
    return fresh.where(~foreign).withColumn("row_order", number).drop("_last", "_matter"), fresh.where(foreign).drop("_last", "_matter")


def cascade_delete(ids: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the rows of the removed keys."""
    return [t.join(ids, key, "left_anti") for t in tables]


def set_null(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """References to removed keys become null; the rows stay."""
    gone = ids.select(F.col(key).alias("_gone")).distinct()
    return rows.join(gone, F.col(key) == F.col("_gone"), "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")
