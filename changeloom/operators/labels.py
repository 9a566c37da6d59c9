"""Joins of labels, verdicts, inputs and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import running


def final_ordered(pred: Column, removed: Column, added: Column) -> Column:
    """Predicted without removed, order and repeats kept, then added ones that aren't among them."""
    kept = F.filter(pred, lambda x: ~F.array_contains(removed, x))
    return F.concat(kept, F.array_except(added, kept))


def final_set(pred: Column, removed: Column, added: Column) -> Column:
    """(predicted - removed) + added as a set."""
    return F.array_union(F.array_except(pred, removed), added)


def final_strict(pred: Column, removed: Column, added: Column) -> Column:
    """(predicted + added) - removed as a set: a label both added and removed is out."""
    return F.array_except(F.array_union(pred, added), removed)


def with_consensus(outputs: DataFrame, consensus: DataFrame, key: str) -> DataFrame:
    """Outputs whose labels a consensus replaces where there is one, be it empty; rows without labels go."""
    c = consensus.select(key, F.col("labels").alias("_labels"), F.lit(True).alias("_there"))
    out = outputs.join(c, key, "left").withColumn("labels", F.when(F.col("_there"), F.col("_labels")).otherwise(F.col("labels")))
    return out.drop("_labels", "_there").where(F.size("labels") > 0)


def with_inputs(outputs: DataFrame, inputs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Outputs with their inputs, and the outputs that have none."""
    return outputs.join(inputs, key), outputs.join(inputs.select(key), key, "left_anti")


def message_instances(verdicts: DataFrame, inputs: DataFrame, instances: DataFrame, key: str = "modification_id") -> DataFrame:
    """Verdict, input and instance of each record; a record that lacks either raises when the result is read."""
    out = verdicts
    for name, table in (("input", inputs), ("instance", instances)):
        out = out.join(table.withColumn("_there", F.lit(True)), key, "left")
        lacking = F.raise_error(F.concat(F.lit(f"no {name} for "), F.coalesce(F.col(key).cast("string"), F.lit("a record without id")))).cast("boolean")
        out = out.where(F.when(F.col("_there"), True).otherwise(lacking)).drop("_there")
    return out


def predictions(pred: DataFrame, truth: DataFrame, verdicts: DataFrame, key: str = "modification_id") -> DataFrame:
    """Predictions with their ground truth; a verdict, where there is one, corrects the predicted labels.

    Derived families are copied, not computed again.
    """
    v = verdicts.select(key, F.col("remove_labels").alias("_r"), F.col("add_labels").alias("_a"), F.lit(True).alias("_there"))
    out = pred.join(truth.select(key, "gt_labels"), key).join(v, key, "left")
    return out.withColumn("pred_labels", F.when(F.col("_there"), final_ordered(F.col("pred_labels"), F.col("_r"), F.col("_a"))).otherwise(F.col("pred_labels"))).drop("_r", "_a", "_there")


def families(instances: DataFrame, mapping: DataFrame) -> DataFrame:
    """Instances with the distinct families of their labels; labels without a family vanish. ``mapping`` is (pattern, family)."""
    long = instances.select("id", F.explode(F.array_distinct("labels")).alias("pattern")).join(mapping, "pattern")
    by_id = long.groupBy("id").agg(F.array_sort(F.collect_set("family")).alias("families"))
    return instances.join(by_id, "id", "left").withColumn("families", F.coalesce("families", F.array().cast("array<string>")))


def low_confidence(assignments: Column) -> Column:
    """Whether any label was assigned with low confidence."""
    return F.coalesce(F.exists(assignments, lambda a: a["confidence"] == "low"), F.lit(False))


def tasks(records: DataFrame, outputs: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """Audit tasks: records with output and input, those of low confidence first, numbered in that order."""
    both = records.join(outputs, key).join(inputs, key)
    order = [F.when(F.col("set") == "low-confidence", 0).otherwise(1), F.col(key)]
    return running(both, order, place="task")


def message_tasks(predictions: DataFrame, inputs: DataFrame, key: str = "modification_id") -> DataFrame:
    """Audit tasks of message codings: predictions that have an input, numbered in the predictions' order (``row_no``)."""
    return running(predictions.join(inputs, key), [F.col("row_no")], place="task")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have a key, the new row's columns win and columns only the old one has stay."""
    there = new.withColumn("_there", F.lit(True)).alias("n")
    joined = old.alias("o").join(there, key, "full_outer")
    columns = [F.col(key)]
    for c in dict.fromkeys([*old.columns, *new.columns]):
        if c == key:
            continue
        if c in old.columns and c in new.columns:
            columns.append(F.when(F.col("n._there"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            columns.append(F.col(f"{'o' if c in old.columns else 'n'}.{c}").alias(c))
    return joined.select(*columns)


def resume(rows: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(*key).distinct(), list(key), "left_anti")
