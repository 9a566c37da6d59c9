"""Cleaning of change records: forks, shared history, sync rows, files in scope, commits, redundant branches.

Rows have the columns of ``schemas.DIFFS``; ``row_no`` carries the order of the input where order decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..functions import text as X
from .containment import maximal_keys


def is_active(created: Column, pushed: Column) -> Column:
    """Whether a fork was pushed to more than five minutes after its creation; a missing or bad time keeps it."""
    time = lambda c: F.try_to_timestamp(c.cast("string"))
    return F.coalesce(time(pushed) > time(created) + F.expr("INTERVAL 5 MINUTES"), F.lit(True))


def popular(repos: DataFrame, stars: int = 20_000, forks: int = 2_000) -> DataFrame:
    """Repositories with enough stars and forks that hold a definition file."""
    return repos.where((F.col("stargazers_count") >= stars) & (F.col("forks_count") >= forks) & F.coalesce("has_skill_md", F.lit(False)))


def has_definition(tree: Column) -> Column:
    """Whether a tree (array of path, type) holds a definition file."""
    return F.exists(tree, lambda e: (e["type"] == "blob") & (F.element_at(F.split(e["path"], "/"), -1) == "SKILL.md"))


def holds_definition(tree: Column, truncated: Column, searched: Column) -> Column:
    """Whether a repository holds a definition file: by its tree or, where the listing was cut short, by a search; unknown is no."""
    cut = F.coalesce(truncated, F.lit(False)) & F.coalesce(searched, F.lit(False))
    return F.coalesce(has_definition(tree), F.lit(False)) | cut


def default_branch(branch: Column) -> Column:
    """Default branch, ``main`` where it isn't known."""
    return F.coalesce(branch, F.lit("main"))


def utc_now() -> Column:
    """The present time in UTC, to the second, as ISO text."""
    return F.date_format(F.to_utc_timestamp(F.date_trunc("second", F.current_timestamp()), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def repo_metadata(repos: DataFrame, captured_at: Column | None = None) -> DataFrame:
    """Rows of ``schemas.REPO_METADATA`` from repositories as the API gives them, stamped with the present time by default."""
    return repos.select(F.col("full_name").alias("repo_name"), F.col("stargazers_count").alias("stars"), F.col("forks_count").alias("forks"), "default_branch", (utc_now() if captured_at is None else captured_at).alias("captured_at"))


def branch_rows(forks: DataFrame, branches: DataFrame) -> DataFrame:
    """A row for each branch of each fork; ``branches`` is (full_name, fork_branch). A fork without a listing has none."""
    return forks.join(branches.select("full_name", "fork_branch"), "full_name")


def first_rows(df: DataFrame, n: int, order: str = "row_no", zero: str = "all") -> DataFrame:
    """The first ``n`` rows in the order of the input, for a trial; 0 means all rows or none, as ``zero`` says."""
    return df if n == 0 and zero == "all" else df.orderBy(order).limit(n)


def first_wins(df: DataFrame, *key: str, order: str = "row_no") -> DataFrame:
    """The first row of each key; rows are combined before the shuffle, so a key may have any number of them."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*key).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def keyword_union(frames: list[DataFrame], key: str = "full_name") -> DataFrame:
    """Results of several searches, the first search that found a row winning."""
    out = None
    for i, f in enumerate(frames):
        part = f.withColumn("_k", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return first_wins(out, key, order="_k").drop("_k")


def shared(pairs: DataFrame) -> DataFrame:
    """(scope, item) of items that at least two owners of a scope have; ``pairs`` are (scope, owner, item).

    Least and greatest owner differ exactly if there are two, and both are combined before the shuffle.
    """
    return pairs.groupBy("scope", "item").agg((F.min("owner") != F.max("owner")).alias("many")).where("many").select("scope", "item")


def drop_shared_history(diffs: DataFrame) -> DataFrame:
    """Rows in state ``ok`` without the commits that several owners of an upstream have; rows left without any go.

    Only hashes are shuffled for the count; the hashes to drop come back to each row as one array.
    """
    ok = diffs.where("status = 'ok'")
    items = ok.select("row_no", F.col("upstream").alias("scope"), F.col("fork_owner").alias("owner"), F.explode("commits.sha").alias("item"))
    gone = items.join(shared(items.select("scope", "owner", "item")), ["scope", "item"]).groupBy("row_no").agg(F.collect_set("item").alias("gone"))
    out = ok.join(gone, "row_no", "left")
    kept = F.filter("commits", lambda c: ~F.coalesce(F.array_contains(F.col("gone"), c["sha"]), F.lit(False)))
    return out.withColumn("commits", kept).drop("gone").where(F.size("commits") > 0)


def owner_dir(path: Column, dirs: Column) -> Column:
    """Longest of the directories that is the path or above it, or null."""
    fits = F.filter(dirs, lambda d: (path == d) | path.startswith(F.concat(d, F.lit("/"))))
    return F.aggregate(fits, F.lit(None).cast("string"), lambda a, d: F.when(a.isNull() | (F.length(d) > F.length(a)), d).otherwise(a))


def longest_prefix(rows: DataFrame, dirs: DataFrame, path: str = "path", dir_: str = "dir", key: str | None = None) -> DataFrame:
    """(row columns, owner): the longest of ``dirs`` (key, dir) above each path, or null.

    Paths are exploded into their ancestors, which are joined by equality; no comparison of all pairs.
    """
    on = ["_dir"] if key is None else ["_dir", key]
    table = dirs.select(F.col(dir_).alias("_dir"), *([key] if key else [])).distinct()
    slim = rows.select(F.col(path).alias("_path"), *([key] if key else [])).distinct()
    long = slim.select("_path", *([key] if key else []), F.explode(P.ancestors(F.col("_path"))).alias("_dir"))
    best = long.join(table, on).groupBy("_path", *([key] if key else [])).agg(F.max_by("_dir", F.length("_dir")).alias("owner"))
    best = best.select(F.col("_path"), "owner", *([F.col(key).alias("_key")] if key else []))
    same = F.col(path) == F.col("_path")
    return rows.join(best, same & (F.col(key) == F.col("_key")) if key else same, "left").select(*[rows[c] for c in rows.columns], "owner")


def files_in_dirs(files: Column, dirs: Column) -> Column:
    """Files inside known directories, without those in directories whose definition file this very change adds or removes."""
    touched = F.filter(files, lambda f: (P.name(f["filename"]) == "SKILL.md") & f["status"].isin("added", "removed"))
    gone = F.array_distinct(F.transform(touched, lambda f: P.parent(f["filename"])))
    return F.filter(files, lambda f: owner_dir(f["filename"], dirs).isNotNull() & owner_dir(f["filename"], gone).isNull())


def assets(files: Column, roots: Column) -> Column:
    """Files that belong to packages whose roots are known or appear in this change."""
    own = F.transform(F.filter(files, lambda f: P.is_definition(f["filename"])), lambda f: P.parent(F.array_join(P.parts(f["filename"]), "/")))
    every = F.array_union(own, F.coalesce(roots, F.array().cast("array<string>")))
    return F.filter(files, lambda f: P.is_asset(f["filename"], every))


def with_dirs(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows with ``dirs``: the known directories of their upstream that are above any of their files, or a file's own parent.

    ``index`` has (repo, path) of definition files. Files are exploded into their ancestors, which are joined by equality; so
    an upstream may have any number of packages, and a row meets only those that its own files lie in.
    """
    known = index.select(F.col("repo").alias("upstream"), P.parent(F.col("path")).alias("_d")).distinct()
    numbered = rows if "row_no" in rows.columns else rows.withColumn("row_no", F.monotonically_increasing_id())
    names = numbered.select("row_no", "upstream", F.explode("files.filename").alias("_f")).distinct()
    above = F.concat(P.ancestors(F.col("_f")), P.ancestors(P.parent(F.col("_f"))), F.array(F.lit(".")))
    met = names.select("row_no", "upstream", F.explode(above).alias("_d")).distinct().join(known, ["upstream", "_d"])
    out = numbered.join(met.groupBy("row_no").agg(F.collect_set("_d").alias("dirs")), "row_no", "left")
    return out.select(*rows.columns, F.coalesce("dirs", F.array().cast("array<string>")).alias("dirs"))


def in_scope(diffs: DataFrame, index: DataFrame) -> DataFrame:
    """Rows that don't only follow their upstream, with the files in scope; ``index`` has (repo, path) of definition files."""
    own = with_dirs(diffs.where(~X.is_sync(F.col("fork_branch"), F.col("commits"))), index)
    own = own.withColumn("files", files_in_dirs(F.col("files"), F.col("dirs")))
    return own.withColumn("files", assets(F.col("files"), F.col("dirs"))).drop("dirs").where(F.size("files") > 0)


def clean_commits(commits: Column) -> Column:
    """Commits that are neither mechanical nor maintenance, with footers trimmed."""
    kept = F.filter(commits, lambda c: X.noise_class(c["message"]).isNull())
    trimmed = F.transform(kept, lambda c: c.withField("message", X.trim_footers(c["message"])))
    return F.filter(trimmed, lambda c: X.maintenance_class(c["message"]).isNull() & (c["message"] != ""))


def maximal_sets(rows: DataFrame, group: list[str], items: str, first: Column, order: str = "row_no", hot: int = 500_000) -> DataFrame:
    """Rows whose set of ``items`` is not inside another row's set of the same group, by ``maximal_keys``.

    Rows are read twice; where group and order are all that is asked for, ``maximal_keys`` reads them once.
    """
    return rows.join(maximal_keys(rows, group, items, first, order, hot).select(order), order, "left_semi")


def dedup_branches(diffs: DataFrame) -> DataFrame:
    """Branches of an owner that aren't contained in another one; default branches win ties."""
    with_sets = diffs.withColumn("_sha", F.col("commits.sha"))
    return maximal_sets(with_sets, ["upstream", "fork_owner"], "_sha", F.col("fork_branch").isin("main", "master")).drop("_sha")


def cleaned(diffs: DataFrame) -> DataFrame:
    """Rows with clean commits and some left, without contained branches."""
    out = diffs.withColumn("commits", clean_commits(F.col("commits"))).where(F.size("commits") > 0)
    return dedup_branches(out)


def funnel(steps: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """One row for each (step, unit, frame): the number of its rows."""
    out = None
    for i, (step, unit, frame) in enumerate(steps):
        row = frame.agg(F.count(F.lit(1)).alias("count")).select(F.lit(i).alias("no"), F.lit(step).alias("step"), F.lit(unit).alias("unit"), "count")
        out = row if out is None else out.unionByName(row)
    return out


def new_packages(diffs: DataFrame, index: DataFrame) -> DataFrame:
    """Counts over all rows and their shares: rows that modify a known package, add one, do both, or only add."""
    rows = with_dirs(diffs, index)
    dirs, of = F.col("dirs"), lambda f: P.parent(f["filename"])
    added = F.exists("files", lambda f: (P.name(f["filename"]) == "SKILL.md") & (f["status"] == "added") & ~F.array_contains(dirs, of(f)))
    modified = F.exists("files", lambda f: owner_dir(f["filename"], dirs).isNotNull() | owner_dir(of(f), dirs).isNotNull())
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    a, m = F.col("a"), F.col("m")
    kinds = {"modifies_existing": m, "adds_new": a, "modifies_existing_and_adds_new": a & m, "adds_new_only": a & ~m}
    flags = rows.select(F.coalesce(added, F.lit(False)).alias("a"), F.coalesce(modified, F.lit(False)).alias("m"))
    counts = flags.agg(F.count(F.lit(1)).alias("total"), *[one(c).alias(k) for k, c in kinds.items()])
    long = counts.select("total", F.explode(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*kinds))).alias("category", "count"))
    return long.select("category", "count", F.when(F.col("total") > 0, F.col("count") / F.col("total")).otherwise(0.0).alias("share_of_total"), F.col("total").alias("denominator"))


def of_upstream(forks: DataFrame, upstream: str, most: int | None = None) -> DataFrame:
    """Forks of one upstream, the first ``most`` in the order of the input."""
    rows = forks.where(F.col("upstream") == upstream)
    return rows if most is None else rows.orderBy("row_no").limit(most)


def compared(raw: DataFrame) -> DataFrame:
    """Typed records from raw comparisons: files below the prefix, and a status that keeps a tombstone for the rest."""
    kept = F.filter(F.coalesce("files", F.array().cast(raw.schema["files"].dataType)), lambda f: (F.col("prefix") == "") | f["filename"].startswith(F.col("prefix")))
    status = F.when(~F.col("found"), "not_found").when(F.size("files") > 0, "ok").otherwise("no_diff")
    return raw.withColumn("files", kept).withColumn("status", status).withColumn("head_sha", F.try_element_at(F.col("commits.sha"), F.lit(-1)))
