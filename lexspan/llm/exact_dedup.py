"""Exact deduplication by sorting content.

Splitters that Spark samples from the normalised bytes deal the documents over ranges; an
external sort inside each range places equal texts next to each other, and the window
over the sorted rows compares neighbouring texts in full. A text that so many documents
share that it would fill a range of its own is divided by a salt, each part is sorted
like any other run, and the parts' summaries (one row each) are merged afterwards.
Only DataFrame functions are used.

Defined results: null text counts as empty, and all empty texts are equal. A row with null
``doc_id`` never stays unless its whole group has none. Repeated rows (same id, same text)
count in ``group_size``; one of them stays. Very long texts are compared whole. An empty
table gives an empty table. ``exact_groups`` carries the extra columns it is asked for,
unless they bear a result's name; ``drop_exact_copies`` keeps all columns of its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column, collapse_space: bool = False, fold_case: bool = False) -> Column:
    """The bytes that are compared."""
    text = F.coalesce(text, F.lit(""))
    if fold_case:
        text = F.lower(text)
    if collapse_space:
        text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.encode(text, "UTF-8")


def _runs(keyed: DataFrame, ranges: int) -> DataFrame:
    """Rows with the size and head of their run of equal (content, salt).

    Ranges follow the first bytes, then the mark that equal texts share, so the sampled
    splitters stay short however long the texts are; the sort and the comparison of
    neighbours go on to the full content.
    """
    dealt = keyed.withColumn("_first", F.substring("_content", 1, 32)).repartitionByRange(ranges, "_first", "_mark", "_salt")
    ordered = Window.partitionBy("_first", "_mark", "_content", "_salt").orderBy(F.col("doc_id").desc_nulls_last())
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return dealt.withColumns(
        {
            "_place": F.row_number().over(ordered),
            "_head": F.first("doc_id").over(whole),
            "_size": F.count(F.lit(1)).over(whole),
        }
    )


def exact_groups(
    docs: DataFrame, *, carry: tuple[str, ...] = (), collapse_space: bool = False, fold_case: bool = False, largest: bool = True, ranges: int | None = None
) -> DataFrame:
    """One row per document: ``doc_id``, ``carry``, keep_id, group_size, kept, text_sha256.

    ``largest=False`` lets the smallest identifier of each group stay instead of the largest.
    ``ranges`` is the number of ranges (default: the session's shuffle partitions).
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    carry = tuple(c for c in carry if c not in RESULT and c != "doc_id")
    sign = 1 if largest else -1
    keyed = docs.select(
        (F.col("doc_id") * sign).alias("doc_id"),
        *[F.col(c) for c in carry],
        normalised(F.col("text"), collapse_space, fold_case).alias("_content"),
    ).withColumn("_mark", F.xxhash64("_content"))

    # Marks that recur in more than a quarter of a range's share of rows: at most 4 * ranges
    # of them can exist, whatever the input, so this list is small enough to broadcast.
    counts = keyed.groupBy("_mark").agg(F.count(F.lit(1)).alias("_rows"))
    share = max(64.0, docs.count() / (4 * ranges))
    hot = counts.where(F.col("_rows") > share).select("_mark", F.ceil(F.col("_rows") / share).cast("int").alias("_parts"))
    salted = keyed.join(F.broadcast(hot), "_mark", "left").withColumn(
        "_salt", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("_parts"))).otherwise(F.lit(-1))
    )

    runs = _runs(salted, ranges).select("*", F.sha2("_content", 256).alias("text_sha256"))
    parts = (
        _runs(salted.where("_salt >= 0").select("doc_id", "_content", "_mark", "_salt"), ranges)
        .where("_place = 1")
        .groupBy(F.sha2("_content", 256).alias("text_sha256"))
        .agg(F.max("_head").alias("_whole_head"), F.sum("_size").alias("_whole_size"))
    )
    return runs.join(F.broadcast(parts), "text_sha256", "left").select(
        (F.col("doc_id") * sign).alias("doc_id"),
        *[F.col(c) for c in carry],
        (F.coalesce("_whole_head", "_head") * sign).alias("keep_id"),
        F.coalesce("_whole_size", "_size").alias("group_size"),
        ((F.col("_place") == 1) & F.col("_head").eqNullSafe(F.coalesce("_whole_head", "_head"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their own columns, whatever their names."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return exact_groups(rows, carry=("_row",), **options).where("kept").select("_row.*")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
