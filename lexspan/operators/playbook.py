"""Playbooks: one finding per document and rule, with the clause that decides it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions import text as t
from lexspan.operators.grid import best_sentences, sentence_overlap, with_sentence

SEVERITY = ["high", "medium", "low", "none"]


# Sentences of the findings.
NOT_ADDRESSED = "The document does not appear to address "
CLAUSE_READS = "The clause reads: "
NO_FINDING = "No finding was returned for this rule."


def playbook_findings(passages: DataFrame, rules: DataFrame, *on: str) -> DataFrame:
    """The sentence that shares most words with a rule, and the position it is closest to."""
    positions = ("preferred", "fallback", "unacceptable")
    keyed = rules.select("rule_id", *on, "topic", *[t.keywords(F.col(f"{p}_position")).alias(f"_{p}") for p in positions])
    asked = keyed.select(*on, "rule_id", F.array_union(t.keywords(F.col("topic")), F.col("_preferred")).alias("_keys"))
    best = with_sentence(best_sentences(sentence_overlap(passages, asked, *on), "rule_id"), passages, "section_path")
    words = t.keywords(F.col("sentence"))
    best = best.join(keyed.drop("topic", *on), "rule_id").withColumns({p: F.size(F.array_intersect(words, f"_{p}")) for p in positions}).drop(*[f"_{p}" for p in positions])
    targets = passages.select("document_id", *[c for c in on if c != "document_id"]).distinct().join(rules, list(on))
    rows = targets.join(best, ["document_id", "rule_id"], "left")
    lost = F.coalesce(F.col("overlap") < 2, F.lit(True))
    position = (
        F.when(lost, "not_addressed")
        .when((F.col("preferred") >= F.col("fallback")) & (F.col("preferred") >= F.col("unacceptable")), "preferred")
        .when(F.col("fallback") >= F.col("unacceptable"), "fallback")
        .otherwise("unacceptable")
    )
    rows = rows.withColumn("matched_position", position)
    severity = F.when(lost, "medium").when(F.col("matched_position") == "preferred", "none").when(F.col("matched_position") == "fallback", "low").otherwise("high")
    last_part = F.element_at(F.split(F.coalesce("section_path", F.lit("")), " > "), -1)
    rationale = F.when(lost, F.concat(F.lit(NOT_ADDRESSED), F.lower("topic"), F.lit("."))).otherwise(F.concat(F.lit(CLAUSE_READS), F.substring("sentence", 1, 160)))
    return rows.select("document_id", "rule_id", "ordinal_no", "matched_position", severity.alias("severity"), F.when(lost, "").otherwise(F.substring(last_part, 1, 120)).alias("clause_reference"), rationale.alias("rationale"), F.when(~lost, F.col("sentence")).alias("quote"), F.when(~lost, F.col("ordinal")).alias("chunk_ordinal"), F.when(F.col("matched_position") == "preferred", "").otherwise(F.col("preferred_position")).alias("suggested_language"))


def assemble_findings(targets: DataFrame, findings: DataFrame, verified: DataFrame) -> DataFrame:
    """One row per rule: missing ones are not addressed; the first quote that held is kept."""
    kept = verified.groupBy("document_id", "rule_id").agg(F.min_by("quoted_text", "quote_pos").alias("quoted_text"))
    rows = targets.join(findings, ["document_id", "rule_id"], "left").join(kept, ["document_id", "rule_id"], "left")
    position = F.coalesce("matched_position", F.lit("not_addressed"))
    return rows.select("document_id", "rule_id", position.alias("matched_position"), F.coalesce("severity", F.lit("medium")).alias("severity"), F.coalesce("rationale", F.lit(NO_FINDING)).alias("rationale"), "quoted_text", ((position == "not_addressed") | F.col("quoted_text").isNotNull()).alias("verified"))


def issues_list(findings: DataFrame) -> DataFrame:
    """Findings of each document numbered from the most severe, unproven ones marked."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy(rank, "ordinal_no", "rule_id"))
    return findings.withColumns({"number": number, "mark": F.when(F.col("verified"), "").otherwise("UNVERIFIED")})


def issue_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("document_id").agg(F.count(F.lit(1)).alias("topics"), F.count_if(F.col("matched_position") != "preferred").alias("deviations"))


def list_runs(runs: DataFrame, documents: DataFrame, by: str = "matter_id") -> DataFrame:
    """Runs of each document, or of each matter through its documents, newest first.

    A run of an unknown document is in no matter's list but in that document's own.
    """
    if by != "document_id":
        runs = runs.join(documents.select("document_id", by), "document_id")
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("created_at"), "run_id")))
