"""Checks of label records, taxonomies and message codings; each gives a row's errors as an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Enumerations of the label records, and the sentinels of message codings.
CONFIDENCE, SUFFICIENCY, EVIDENCE = ["high", "medium", "low"], ["sufficient", "truncated", "empty", "ambiguous"], ["patch", "file_status", "commit_message", "branch_name"]
MISSING = ["missing-what", "missing-why"]


def errors(*checks: tuple[Column, str]) -> Column:
    """Messages of the checks whose fault holds."""
    return F.filter(F.array(*[F.when(F.coalesce(fault, F.lit(False)), F.lit(text)) for fault, text in checks]), lambda x: x.isNotNull())


def label_errors(version: str, known: list[str]) -> Column:
    """Faults of a label record (columns of ``schemas.LABELS``)."""
    a = F.col("label_assignments")
    names = F.transform(a, lambda x: x["name"])
    vocabulary = F.array(*map(F.lit, known))
    return errors(
        (F.col("taxonomy_version") != version, "version"),
        (F.size(F.array_except("labels", names)) + F.size(F.array_except(names, F.col("labels"))) > 0, "assignments differ from labels"),
        (F.size(F.array_distinct(names)) != F.size(names), "repeated assignment"),
        (F.size(F.array_except(F.col("labels"), vocabulary)) > 0, "unknown label"),
        (F.exists(a, lambda x: F.coalesce(F.size(x["evidence"]), F.lit(0)) < 1), "no evidence"),
        (F.exists(a, lambda x: ~x["confidence"].isin(CONFIDENCE)), "confidence"),
        (F.exists(a, lambda x: F.exists(x["evidence"], lambda e: ~e["type"].isin(EVIDENCE))), "evidence type"),
        (F.exists(a, lambda x: (x["confidence"] == "high") & ~F.exists(x["evidence"], lambda e: e["type"] == "patch")), "high confidence without patch evidence"),
        (~F.col("patch_sufficiency").isin(SUFFICIENCY), "patch sufficiency"),
    )


def taxonomy_errors(taxonomy: DataFrame) -> DataFrame:
    """Names of families or patterns that occur more than once; ``taxonomy`` is (family, pattern)."""
    families = taxonomy.select("family", "family_no").distinct().groupBy(F.col("family").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("family"))
    patterns = taxonomy.groupBy(F.col("pattern").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("pattern"))
    return families.unionByName(patterns).where("n > 1")


def coding_errors(known: list[str], what_known: list[str], why_known: list[str]) -> Column:
    """Faults of a message coding (columns of ``schemas.PREDICTIONS`` and ``families``, derived from its labels)."""
    what, why, missing = F.col("what_expression_categories"), F.col("why_expression_categories"), F.array(*map(F.lit, MISSING))
    alone = lambda c: (F.size(F.array_intersect(c, missing)) > 0) & (F.size(c) > 1)
    only = F.size(F.array_except(why, missing)) == 0
    return errors(
        (F.size(F.array_except(F.col("pred_labels"), F.array(*map(F.lit, known)))) > 0, "unknown label"),
        (F.size(F.array_distinct("pred_labels")) != F.size("pred_labels"), "repeated label"),
        (F.size(F.array_except(what, F.array(*map(F.lit, what_known)))) + F.size(F.array_except(why, F.array(*map(F.lit, why_known)))) > 0, "unknown category"),
        (F.size(F.array_except("message_what_families", "families")) + F.size(F.array_except("families", "message_what_families")) > 0, "families differ from labels"),
        ((F.size(what) == 0) | (F.size(why) == 0), "no category"),
        (alone(what) | alone(why), "a missing category isn't alone"),
        (only != (F.size("why_intentions") == 0), "intentions"),
    )


def id_errors(coded: DataFrame, truth: DataFrame, key: str = "modification_id") -> DataFrame:
    """Ids that are coded more than once, that aren't known, or that aren't coded."""
    say = lambda df, text: df.select(key).withColumn("error", F.lit(text))
    again = coded.groupBy(key).count().where("count > 1")
    return say(again, "repeated").unionByName(say(coded.select(key).distinct().join(truth, key, "left_anti"), "unknown")).unionByName(say(truth.select(key).distinct().join(coded, key, "left_anti"), "not coded"))
