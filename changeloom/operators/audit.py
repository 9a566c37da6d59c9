"""Audits: drawing a sample of fixed confidence, states of verdicts, agreement of auditors and of the model, renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import labels as L
from . import metrics as M
from . import sampling as S


def cochran_draw(df: DataFrame, key: str, confidence: float = 0.95, margin: float = 0.05, p: float = 0.5, seed: int = 1104) -> DataFrame:
    """A simple draw of the size that confidence and margin ask for, sorted by key."""
    size = df.agg(M.cochran(F.count(F.lit(1)), confidence, margin, p).alias("n")).first()["n"]
    return S.simple(df, key, size, seed).orderBy(key)


def verdict_state(visited: Column, verdict: Column) -> tuple[Column, Column]:
    """(audited, verdict) as exported: a record that was visited and left alone is correct, one never visited has no verdict."""
    seen = F.coalesce(visited, F.lit(False))
    return seen, F.when(seen, F.coalesce(verdict, F.lit("correct")))


def first_two(auditors: list[DataFrame], key: str = "record") -> DataFrame:
    """(record, a, b): final labels of the first two auditors on the records that both have."""
    if len(auditors) < 2:
        raise ValueError("two auditors are needed")
    final = lambda df, c: df.select(key, L.final_set(X.label_list(F.col("predicted_labels")), F.coalesce("remove_labels", F.array().cast("array<string>")), F.coalesce("add_labels", F.array().cast("array<string>"))).alias(c))
    return final(auditors[0], "a").join(final(auditors[1], "b"), key)


def agreement_rows(auditors: list[DataFrame], consensus: DataFrame) -> DataFrame:
    """Agreement of two auditors, and of the model with the consensus over the sample, the low-confidence rows and all."""
    rows = M.agreement(first_two(auditors)).withColumn("comparison", F.lit("auditors")).withColumn("precision", F.lit(None).cast("double")).withColumn("recall", F.lit(None).cast("double"))
    pred = X.label_list(F.col("predicted_labels"))
    gold = L.final_set(pred, F.coalesce("remove_labels", F.array().cast("array<string>")), F.coalesce("add_labels", F.array().cast("array<string>")))
    sets = consensus.select("set", gold.alias("gold"), pred.alias("pred"))
    for name, kept in (("sample", sets.where(F.col("set") == "sample")), ("low-confidence", sets.where(F.col("set") == "low-confidence")), ("all", sets)):
        both = M.agreement(kept.select(F.col("gold").alias("a"), F.col("pred").alias("b"))).crossJoin(F.broadcast(M.macro(kept).select("precision", "recall")))  # one row each
        rows = rows.unionByName(both.withColumn("comparison", F.lit(f"model, {name}")))
    return rows


def render_labels(assignments: Column, rationale: Column, sufficiency: Column, uninformative: Column) -> Column:
    """A model's labels, evidence and rationale as Markdown; low confidence is marked."""
    fact = lambda e: F.concat(F.lit("- "), X.strip(F.coalesce(e["summary"], F.lit(""))), F.coalesce(F.when(e["file"] != "", F.concat(F.lit("\n  ↳ `"), e["file"], F.lit("`"))), F.lit("")))
    head = lambda a: F.concat(F.lit("### `"), a["name"], F.lit("` — confidence: **"), a["confidence"], F.lit("**"), F.when(a["confidence"] == "low", " ⚠️ LOW").otherwise(""))
    each = F.flatten(F.transform(assignments, lambda a: F.concat(F.array(head(a)), F.transform(a["evidence"], fact))))
    body = F.when(F.size(assignments) > 0, each).otherwise(F.array(F.lit("_(no labels assigned)_")))
    reason = F.when(X.strip(F.coalesce(rationale, F.lit(""))) != "", F.array(F.concat(F.lit("\n## Rationale\n\n"), X.strip(rationale)))).otherwise(F.array().cast("array<string>"))
    say = F.initcap(uninformative.cast("string"))
    meta = F.concat(F.lit("\n---\n_patch_sufficiency: "), sufficiency, F.lit(" · uninformative_commit_messages: "), say, F.lit("_"))
    return F.array_join(F.concat(F.array(F.lit("## Model prediction\n")), body, reason, F.array(meta)), "\n\n")
