"""Features and records of instances: candidates for labelling, their inputs, surfaces, metadata edits, renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import diffs as D
from ..functions import paths as P
from ..functions import text as X
from .clean import first_wins
from .metrics import canonical_rank, prevalence

#: Fixed value: the label whose instances are told apart by whether they edit the description.
METADATA = "modify-skill-metadata"


def identity(id_: Column) -> tuple[Column, Column, Column]:
    """Upstream, owner and branch of an id; missing parts are empty."""
    parts = F.split(id_, "::")
    return tuple(F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in range(3))


def candidates(diffs: DataFrame) -> DataFrame:
    """One row of features for each cleaned diff row, the first of each id."""
    n = lambda s: F.size(F.filter("files", lambda f: f["status"] == s))
    total = lambda c: F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + F.coalesce(f[c], F.lit(0)))
    merged = F.exists("commits", lambda c: F.coalesce(X.noise_class(c["message"]).startswith("merge"), F.lit(False)))
    rows = diffs.select(
        F.concat_ws("::", "upstream", "fork_owner", F.coalesce("fork_branch", F.lit(""))).alias("modification_id"), "upstream", "fork_owner", F.coalesce("fork_branch", F.lit("")).alias("fork_branch"), "head_sha", "row_no",
        F.size("commits").alias("commit_count"), merged.alias("has_merge_commit"), F.size("files").alias("file_count"),
        F.size(F.filter("files", lambda f: F.upper(F.element_at(F.split(f["filename"], "/"), -1)) == "SKILL.MD")).alias("skill_md_file_count"),
        n("added").alias("added_files"), n("removed").alias("removed_files"), n("renamed").alias("renamed_files"), total("additions").alias("total_additions"), total("deletions").alias("total_deletions"),
        F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + F.coalesce(F.char_length(f["patch"]), F.lit(0))).alias("skill_patch_chars"), "commits", "files",
    )
    return first_wins(rows, "modification_id")


def label_inputs(chosen: DataFrame) -> DataFrame:
    """Inputs for labelling from candidates with ``sample_stratum``."""
    commits = F.transform("commits", lambda c: F.struct(c["sha"].alias("sha"), F.coalesce(c["message"], F.lit("")).alias("message")))
    files = F.transform("files", lambda f: F.struct(f["filename"].alias("filename"), f["previous_filename"].alias("previous_filename"), f["status"].alias("status"), F.coalesce(f["additions"], F.lit(0)).alias("additions"), F.coalesce(f["deletions"], F.lit(0)).alias("deletions"), F.coalesce(f["patch"], F.lit("")).alias("patch")))
    context = F.struct("sample_stratum", F.col("commit_count").alias("raw_commit_count"), F.col("file_count").alias("raw_file_count"), "skill_md_file_count")
    return chosen.select("modification_id", "upstream", "fork_owner", "fork_branch", "head_sha", commits.alias("commits"), files.alias("files"), context.alias("input_context"), X.stem(F.col("upstream"), F.col("fork_owner"), F.col("fork_branch")).alias("stem"))


def analysis_instances(inputs: DataFrame, labels: DataFrame) -> DataFrame:
    """(modification_id, upstream, commit_messages, patch, labels) of inputs with labels, joined on the stem."""
    both = labels.select("stem", "labels").join(inputs, "stem").where(F.size("labels") > 0)
    return both.select("modification_id", "upstream", F.transform("commits", lambda c: c["message"]).alias("commit_messages"), D.patch(F.col("files")).alias("patch"), "labels")


def message_inputs(instances: DataFrame) -> DataFrame:
    """What an annotator of messages may see: the id and the messages."""
    return instances.select("modification_id", "msg")


def surfaces(patch: Column) -> Column:
    """Distinct surfaces that a patch touches."""
    return F.array_distinct(F.transform(P.file_relatives(D.paths(patch)), P.surface))


def companions(patch: Column) -> Column:
    """Distinct companion files that a patch adds or edits."""
    return F.array_intersect(F.transform(P.file_relatives(D.paths(patch)), P.name), F.array(*map(F.lit, P.COMPANIONS)))


def by_category(instances: DataFrame, categories: Column) -> DataFrame:
    """Prevalence over instances with a patch; the categories are any expression that gives an array."""
    rows = instances.select(F.col("modification_id").alias("id"), F.coalesce("upstream", F.lit("")).alias("upstream"), categories.alias("categories"), P.skill_roots(D.paths(F.col("patch"))).alias("skills"))
    return prevalence(rows)


def surface_prevalence(instances: DataFrame) -> DataFrame:
    """Prevalence by surface, in the surfaces' order."""
    return by_category(instances, surfaces(F.col("patch"))).orderBy(canonical_rank(F.col("category"), P.SURFACES), F.desc("prevalence"))


def companion_prevalence(instances: DataFrame) -> DataFrame:
    """Prevalence by companion file."""
    out = by_category(instances, companions(F.col("patch"))).orderBy(F.desc("prevalence"), "category")
    return out.select(F.col("category").alias("file"), "hits", "analyzed", "prevalence", "upstreams", "observed_upstreams", "upstream_coverage")


def edits_description(patch: Column) -> Column:
    """Whether any definition file's diff in a patch touches the description in its frontmatter."""
    return F.exists(D.files(patch), lambda f: (F.element_at(F.split(f["path"], "/"), -1) == "SKILL.md") & D.touches_field(f["diff"], "description"))


def metadata_split(instances: DataFrame) -> DataFrame:
    """Three rows: instances with the metadata label, those that edit the description, and the others."""
    meta = instances.where(F.array_contains("labels", METADATA)).select(edits_description(F.col("patch")).cast("int").alias("d"))
    c = meta.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("d"))
    rows = F.array(*[F.struct(F.lit(g).alias("group"), k.cast("long").alias("instances"), F.when(F.col("n") > 0, k / F.col("n")).otherwise(0.0).alias("share")) for g, k in (("metadata_instances", F.col("n")), ("on_description", F.col("d")), ("other_fields_only", F.col("n") - F.col("d")))])
    return c.select(F.explode(rows).alias("r")).select("r.*")


def render_diff(commits: Column, files: Column) -> Column:
    """Messages and patches as Markdown."""
    fenced = F.transform(F.coalesce(commits, F.array().cast("array<struct<sha:string,message:string>>")), lambda c: F.concat(F.lit("```\n"), X.strip(F.coalesce(c["message"], F.lit(""))), F.lit("\n```")))
    head = lambda f: F.concat(F.lit("### `"), f["filename"], F.lit("`  ("), f["status"], F.lit(", +"), F.coalesce(f["additions"], F.lit(0)).cast("string"), F.lit("/-"), F.coalesce(f["deletions"], F.lit(0)).cast("string"), F.lit(")"))
    body = lambda f: F.when(X.strip(F.coalesce(f["patch"], F.lit(""))) != "", F.concat(F.lit("```diff\n"), f["patch"], F.lit("\n```"))).otherwise("_(empty patch — no diff content captured)_")
    old = lambda f: F.when(f["previous_filename"] != "", F.concat(F.lit("_renamed from `"), f["previous_filename"], F.lit("`_")))
    parts = F.flatten(F.transform(files, lambda f: F.filter(F.array(head(f), old(f), body(f)), lambda x: x.isNotNull())))
    first = F.when(F.size(fenced) > 0, F.concat(F.array(F.lit("## Commit messages\n")), fenced)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(first, F.array(F.lit("\n## Files\n")), parts), "\n\n")


def render_messages(messages: Column) -> Column:
    """Messages as Markdown."""
    fenced = F.transform(messages, lambda m: F.concat(F.lit("```\n"), X.strip(F.coalesce(m, F.lit(""))), F.lit("\n```")))
    shown = F.when(F.size(F.coalesce(messages, F.array().cast("array<string>"))) > 0, fenced).otherwise(F.array(F.lit("_(no commit messages captured)_")))
    return F.array_join(F.concat(F.array(F.lit("## Commit messages\n")), shown), "\n\n")


def render_prediction(labels: Column, families: Column, what: Column, why: Column, intentions: Column, evidence: Column) -> Column:
    """A model's coding of messages as Markdown. The true labels are no input: whoever audits mustn't see them.

    Headings, names of the fields and what stands for none are fixed values.
    """
    none = F.lit("_(none)_")
    ticked = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.array_join(F.transform(c, lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")).otherwise(none)
    line = lambda name, shown: F.concat(F.lit(f"**{name}:** "), shown)
    axis = [F.lit("## What axis\n"), line("pred_labels", ticked(labels)), line("families", ticked(families)), line("what_expression", ticked(what)), F.lit("\n## Why axis\n"), line("why_expression", ticked(why))]
    listed = F.concat(F.array(F.lit("**why_intentions:**")), F.transform(intentions, lambda x: F.concat(F.lit("- "), x)))
    wanted = F.when(F.size(F.coalesce(intentions, F.array().cast("array<string>"))) > 0, listed).otherwise(F.array(line("why_intentions", none)))
    said = X.strip(F.coalesce(evidence, F.lit("")))
    shown = F.when(said != "", F.array(F.concat(F.lit("\n## Evidence\n\n"), said))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(*axis), wanted, shown), "\n\n")


def matrix(rows: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """A table of values with one column for each of the (few, fixed) column names, as a heat map needs it."""
    return rows.groupBy(row).pivot(column).agg(F.first(value)).orderBy(row)
