"""Queries over change records that are made of the tables: orders are changes of a file for each line item, documents are
patches and messages, customers are forks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import anonymize as A
from ..functions import diffs as D
from ..functions import paths as P
from ..functions import text as X
from ..operators import audit as U
from ..operators import clean as C
from ..operators import features as T
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import sampling as S
from ..operators import security as Z
from ..operators import validate as V
from ..sources import io
from .queries import document_diffs, instances, query, rounded, table, two_sets


def pick(values: list, place: Column) -> Column:
    """One of some texts by a number that counts from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))


def longs(df: DataFrame) -> DataFrame:
    """Integers as longs."""
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def text_array(*items) -> Column:
    """An array of texts, empty if there are none."""
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in items]).cast("array<string>")


def order_changes(spark, sf) -> DataFrame:
    """Rows of changes from orders that have line items: upstreams are priorities, owners are customers."""
    items = table(spark, sf, "lineitem")
    no = F.col("l_linenumber")
    name = F.when(no == 1, "SKILL.md").when(no == 2, "a/skill.md").otherwise(F.concat(F.lit("f"), "l_suppkey", F.lit(".py")))
    status = F.when(F.col("l_returnflag") == "A", "added").when(F.col("l_returnflag") == "R", "removed").otherwise("renamed")
    patch = F.when(no != 3, F.concat(F.lit("+"), "l_linestatus", F.lit(" é")))
    commit = F.struct(F.concat_ws("/", "l_partkey", F.col("l_quantity").cast("long")).alias("sha"), F.when(no == 1, "Merge branch 'x'").otherwise("edit").alias("message"))
    file = F.struct(name.alias("filename"), F.lit(None).cast("string").alias("previous_filename"), status.alias("status"), F.col("l_suppkey").alias("additions"), F.when(no % 2 == 1, no.cast("long")).alias("deletions"), patch.alias("patch"))
    made = items.groupBy("l_orderkey").agg(F.collect_list(commit).alias("commits"), F.collect_list(file).alias("files"))
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").join(made, key == F.col("l_orderkey"))
    return rows.select(
        key.alias("row_no"), F.col("o_orderpriority").alias("upstream"), F.col("o_custkey").cast("string").alias("fork_owner"), F.when(key % 3 == 1, "main").when(key % 3 == 2, "dev").alias("fork_branch"),
        F.when(F.col("o_orderstatus") == "P", "no_diff").otherwise("ok").alias("status"), F.concat(F.lit("h"), key).alias("head_sha"), "commits", "files",
    )


def patch_instances(spark, sf) -> DataFrame:
    """Documents as patches of one to six files: a definition file whose frontmatter they edit, and companions of it."""
    d, k = F.col("doc_id"), (F.col("doc_id") % 9).cast("string")
    own = lambda name: F.concat(F.lit("skills/"), k, F.lit(f"/{name}"))
    head = lambda path: F.concat(F.lit("diff --git "), path, F.lit(" "), path, F.lit("  [modified +1/-1]\n"))
    edit = F.when(d % 3 == 0, "+description: x").when(d % 3 == 1, "+name: y").otherwise(" description: a\n+  more")
    files = [
        F.concat(head(own("SKILL.md")), F.lit("@@ -1 +1 @@\n ---\n"), edit, F.lit("\n ---\n "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n "))),
        F.when(d % 2 == 0, F.concat(head(own("scripts/run.py")), F.lit("+x"))), F.when(d % 3 == 0, F.concat(head(own("AGENTS.md")), F.lit("-x"))), F.when(d % 5 == 0, F.concat(head(own("implementer-prompt.md")), F.lit("+x"))),
        F.when(d % 7 == 0, F.concat(head(F.lit("README.md")), F.lit("+x"))), F.when(d % 4 == 0, F.concat(head(F.lit("lib/util/a.ts")), F.lit(" x"))),
    ]
    labels = F.when(d % 4 != 0, text_array(T.METADATA, "other")).otherwise(text_array("other"))
    return table(spark, sf, "documents").select(d.cast("string").alias("modification_id"), F.col("source").alias("upstream"), F.concat_ws("\n", *files).alias("patch"), labels.alias("labels"))


@query
def surface_prevalence(spark, sf):
    """Prevalence of the surfaces that the documents' patches touch."""
    return rounded(T.surface_prevalence(patch_instances(spark, sf)))


@query
def companion_prevalence(spark, sf):
    """Prevalence of companion files in the documents' patches."""
    return rounded(T.companion_prevalence(patch_instances(spark, sf)))


@query
def metadata_split(spark, sf):
    """Patches with the metadata label by whether they edit the description in the frontmatter."""
    return rounded(T.metadata_split(patch_instances(spark, sf)))


@query
def patch_roots(spark, sf):
    """Root and path below it of every file of the documents' patches."""
    paths = D.paths(F.col("patch"))
    return patch_instances(spark, sf).select("modification_id", F.array_join(P.file_roots(paths), ",").alias("roots"), F.array_join(P.file_relatives(paths), ",").alias("relatives"), F.array_join(P.skill_roots(paths), ",").alias("skills"))


@query
def candidate_features(spark, sf):
    """Features of the first change of each owner's branch."""
    return longs(T.candidates(order_changes(spark, sf)).drop("commits", "files", "row_no"))


@query
def label_inputs(spark, sf):
    """Inputs for labelling of the whole population."""
    made = T.label_inputs(S.everything(T.candidates(order_changes(spark, sf))))
    deleted = F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["deletions"])
    chars = F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + F.length(f["patch"]))
    return longs(made.select("modification_id", "stem", F.size("commits").alias("commits"), F.size("files").alias("files"), deleted.alias("deletions"), chars.alias("patch_chars"), "input_context.raw_file_count", "input_context.sample_stratum"))


@query
def shared_history(spark, sf):
    """Changes without the commits that several owners of an upstream have."""
    out = C.drop_shared_history(order_changes(spark, sf))
    return longs(out.select("row_no", F.size("commits").alias("commits"), F.array_join(F.array_sort("commits.sha"), ",").alias("shas")))


@query
def first_changes(spark, sf):
    """The first 500 changes in the order of the orders."""
    return C.first_rows(order_changes(spark, sf).select("row_no", "upstream"), 500)


@query
def commit_cleaning(spark, sf):
    """Turns as commits of their conversation, mechanical and maintenance ones removed, footers trimmed."""
    heads = ["Merge pull request #7 from x", "Merge branch 'a'", "Merge the rest", "Revert \"it\"", "v1.2.3 out", "Release 2.0", "Initial commit", "update readme.md", "Created with care", "Squashed commit of the following:", ""]
    words = ["Sync with upstream", "fix the index", "lint", "new plugin", "bump it", "readme", "npm i", "allowlist", "-"]
    c = F.col("conv_id")
    said = F.when(F.col("turn") == 0, pick(heads, c)).when(F.col("turn") == 1, F.concat(pick(words, c), F.lit(" "), "text")).otherwise(F.concat("text", F.lit("\n\n\n\nSigned-off-by: A <a@b>\n")))
    commits = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("sha"), said.alias("message"))))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(commits.alias("commits"))
    kept = rows.select("conv_id", F.explode(C.clean_commits(F.col("commits"))).alias("c"))
    return kept.select("conv_id", F.col("c.sha").alias("turn"), F.md5("c.message").alias("h"))


@query
def sync_rows(spark, sf):
    """Changes that only follow their upstream, by branch or by message."""
    k = F.col("c_custkey")
    branch = pick(["main", "auto-sync", "sync/upstream", "upstream-3", "merge-upstream-x", "my-auto-syncs", "Upstream-9b"], k)
    message = pick(["edit", "Synced with upstream", "sync with upstream today", "resync with upstream", None], k)
    commits = F.array(F.struct(F.lit("1").alias("sha"), F.lit("first").alias("message")), F.struct(F.lit("2").alias("sha"), message.alias("message")))
    return table(spark, sf, "customer").select("c_custkey", X.is_sync(branch, commits).alias("sync"))


@query
def path_scopes(spark, sf):
    """Whether planted paths belong to the repository, whether to a package, and whether each page's own path does."""
    planted = ["docs/x.md", "SKILL.md", "README.md", "pkg/readme.md", "pkg/a.png", "other/a.py", "skills/x/a.py", "skills/a.py", "pkg/scripts/run", "pkg/run", "a/b/x.env.example", "a/bc/x.md", "", "./pkg//y.json", ".github/skill.md", "deep/er/Skill.MD"]
    path, own = pick(planted, F.col("page_id")), F.regexp_extract("url", r"://([^?#]*)", 1)
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", P.is_maintenance(path).alias("maintenance"), P.is_asset(path, text_array("pkg", "a/b")).alias("asset"), P.is_asset(F.concat(own, F.lit(".md")), F.array(host)).alias("own_asset"))


@query
def definition_probe(spark, sf):
    """Whether repositories made of pages hold a definition file, by their tree or, where it is cut short, by a search."""
    k = F.col("page_id")
    tree = F.array(F.struct(F.lit("README.md").alias("path"), F.lit("blob").alias("type")), F.struct(pick(["a/SKILL.md", "SKILL.md", "x/skill.md", "b"], k).alias("path"), F.when(k % 4 == 1, "tree").otherwise("blob").alias("type")))
    return table(spark, sf, "pages").select("page_id", C.holds_definition(tree, k % 3 == 0, F.when(k % 7 != 0, k % 5 == 0)).alias("holds"))


@query
def repo_metadata(spark, sf):
    """Metadata of repositories made of customers, their default branch filled in."""
    k = F.col("c_custkey")
    repos = table(spark, sf, "customer").select(F.col("c_name").alias("full_name"), k.alias("stargazers_count"), (k * 7 % 100).alias("forks_count"), C.default_branch(F.when(k % 3 == 0, "trunk")).alias("default_branch"))
    return C.repo_metadata(repos, F.lit("2024-01-01T00:00:00+00:00"))


@query
def branch_rows(spark, sf):
    """Branches of forks: the priorities of each customer's orders."""
    forks = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("full_name"))
    listed = table(spark, sf, "orders").join(forks, F.col("o_custkey") == F.col("c_custkey")).select("full_name", F.col("o_orderpriority").alias("fork_branch")).distinct()
    return C.branch_rows(forks, listed).select("c_custkey", "full_name", "fork_branch")


@query
def frontmatter_fields(spark, sf):
    """Fields of frontmatter put before the documents, some malformed, some no mapping, some missing."""
    d = F.col("doc_id")
    block = F.when(d % 4 == 0, "name: [a").when(d % 4 == 1, "- a\n- b").otherwise(F.concat(F.lit("name: 'n "), "lang", F.lit("'\nnumber: "), d, F.lit("\ndeep:\n  x: [1, 2]")))
    text = F.when(d % 5 == 0, F.col("text")).otherwise(F.concat(F.lit("---\n"), block, F.lit("\n---\n"), "text"))
    read = table(spark, sf, "documents").select("doc_id", D.frontmatter_variant(text).alias("f"))
    get = lambda path, kind: F.try_variant_get("f", path, kind)
    return read.select("doc_id", get("$.name", "string").alias("name"), get("$.number", "long").alias("number"), get("$.deep.x[1]", "long").alias("second"))


@query
def vocabularies(spark, sf):
    """Closed vocabularies: types of parts below their brands, and what and why a message may express."""
    part = table(spark, sf, "part")
    brands = part.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("t")).select(F.struct(F.col("p_brand").alias("name"), F.transform("t", lambda t: F.struct(t.alias("name"))).alias("patterns")).alias("f"))
    taxonomy = brands.agg(F.array_sort(F.collect_list("f")).alias("families"))
    allowed = lambda c: F.struct(F.transform(F.array_sort(F.collect_set(c)), lambda x: F.struct(x.alias("label"))).alias("allowed"))
    messages = table(spark, sf, "nation").agg(allowed(F.col("n_name")).alias("what_expression_categories"), allowed(F.when(F.col("n_nationkey") > 0, F.col("n_name")).otherwise("missing-why")).alias("why_expression_categories"))
    return io.vocabularies(taxonomy, messages)


@query
def sorted_pairs(spark, sf):
    """Pairs of families by falling prevalence, with their place."""
    names = ["REGION_2", "AMERICA", "ASIA"]
    found = M.sorted_pairs(rounded(M.pairs(instances(spark, sf)).select("a", "b", "prevalence")), names)
    return found.select("a", "b", "prevalence", "place")


@query
def match_tables(spark, sf):
    """Matches and documents in each of the tables by role, all in one."""
    out = None
    for name, rows in Z.by_role(Z.scan(Z.diff_lines(document_diffs(spark, sf)))).items():
        part = rows.select(F.lit(name).alias("matches_on"), "role", "id")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("matches_on", "role").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("id").alias("instances"))


@query
def release_instances(spark, sf):
    """Public view of documents as instances, some of whose ids have three parts."""
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").select("doc_id", F.when(d % 2 == 0, F.concat("source", F.lit("::"), d, F.lit("::main"))).otherwise(F.col("source")).alias("modification_id"), F.array(F.concat("text", F.lit(" token=abc")), F.lit("/home/ann/x")).alias("commit_messages"), F.concat(F.lit("+"), "text").alias("patch"))
    return A.VIEWS["instances"](rows).select("doc_id", "modification_id", F.md5(F.array_join("commit_messages", "|")).alias("messages"), F.md5("patch").alias("patch"))


@query
def release_diffs(spark, sf):
    """Public view of customers as owners of diffs, some without a name or a base."""
    k = F.col("c_custkey")
    commits = F.array(F.struct(k.cast("string").alias("sha"), F.lit("token: x y").alias("message")))
    rows = table(spark, sf, "customer").select("c_custkey", F.when(k % 5 == 0, "").otherwise(F.col("c_name")).alias("fork_owner"), F.when(k % 3 > 0, F.concat(F.lit("b"), k)).alias("merge_base_sha"), F.concat(F.lit("h"), k).alias("head_sha"), commits.alias("commits"))
    return A.VIEWS["diffs"](rows).select("c_custkey", "fork_owner", "merge_base_sha", "head_sha", F.col("commits")[0]["sha"].alias("sha"), F.col("commits")[0]["message"].alias("message"))


@query
def release_forks(spark, sf):
    """Public view of customers as forks, named for their owner twice."""
    k, name = F.col("c_custkey"), F.col("c_name")
    rows = table(spark, sf, "customer").select("c_custkey", F.when(k % 5 == 0, "").otherwise(name).alias("owner"), F.concat(name, F.lit("/"), name).alias("full_name"), F.concat(F.lit("https://h.example/"), name, F.lit("/"), name, F.lit(".git")).alias("clone_url"))
    return A.VIEWS["forks"](rows)


@query
def label_record_errors(spark, sf):
    """Faults of label records made of the labels."""
    d = F.col("doc_id")
    kind = F.when(d % 23 == 0, "rumour").when(F.col("quality") == 0, "commit_message").otherwise("patch")
    evidence = lambda k: F.struct(k.alias("type"), F.lit("s").alias("summary"), F.lit("f").alias("file"))
    nothing = F.array().cast("array<struct<type:string,summary:string,file:string>>")
    first = F.when(d % 11 == 0, "zz").otherwise("a")
    x = F.struct(first.alias("name"), F.when(d % 17 == 0, "sure").otherwise("high").alias("confidence"), F.array(evidence(kind)).alias("evidence"))
    y = F.struct(F.lit("b").alias("name"), F.lit("low").alias("confidence"), F.when(F.col("toxic") == 1, nothing).otherwise(F.array(evidence(F.lit("patch")))).alias("evidence"))
    rows = table(spark, sf, "labels").select("doc_id", F.when(d % 7 == 0, "2").otherwise("1").alias("taxonomy_version"), F.array(first, F.lit("b")).alias("labels"), F.when(d % 5 == 0, F.array(x)).when(d % 19 == 0, F.array(x, y, y)).otherwise(F.array(x, y)).alias("label_assignments"), F.when(d % 13 == 0, "odd").otherwise("sufficient").alias("patch_sufficiency"))
    return rows.select("doc_id", F.array_join(V.label_errors("1", ["a", "b"]), "; ").alias("errors"))


@query
def message_coding_errors(spark, sf):
    """Faults of message codings made of the labels."""
    d = F.col("doc_id")
    rows = table(spark, sf, "labels").select(
        "doc_id", F.when(d % 5 == 0, text_array("a", "a")).when(d % 7 == 0, text_array("zz")).otherwise(text_array("a", "b")).alias("pred_labels"),
        F.when(d % 11 == 0, text_array("w", "missing-what")).when(d % 13 == 0, text_array()).when(d % 17 == 0, text_array("w9")).otherwise(text_array("w")).alias("what_expression_categories"),
        F.when(F.col("toxic") == 1, text_array("missing-why")).otherwise(text_array("y")).alias("why_expression_categories"), F.when(F.col("quality") == 1, text_array("i")).otherwise(text_array()).alias("why_intentions"),
        F.when(d % 3 == 0, text_array("F")).otherwise(text_array("G")).alias("message_what_families"), text_array("G").alias("families"),
    )
    return rows.select("doc_id", F.array_join(V.coding_errors(["a", "b"], ["w", "missing-what"], ["y", "missing-why"]), "; ").alias("errors"))


@query
def coded_ids(spark, sf):
    """Documents that are coded twice, that aren't known, and that aren't coded."""
    labels = table(spark, sf, "labels")
    coded = labels.select("doc_id").unionByName(labels.where("toxic = 1").select("doc_id")).unionByName(labels.where("quality = 0").select((-F.col("doc_id") - 1).alias("doc_id")))
    return V.id_errors(coded, table(spark, sf, "documents").select("doc_id"), "doc_id")


@query
def agreement_rows(spark, sf):
    """Agreement of two auditors of the orders' families, and of the model with their consensus by set."""
    rows = two_sets(spark, sf).withColumn("predicted_labels", F.when(F.size("a") == 0, "(none)").otherwise(F.array_join("a", ", ")))
    record = F.col("id").cast("string").alias("record")
    verdict = lambda removed, added: rows.select(record, "predicted_labels", removed.alias("remove_labels"), added.alias("add_labels"))
    none = F.lit(None).cast("array<string>")
    auditors = [verdict(F.slice("b", 1, 1), none), verdict(none, F.slice("b", 1, 1))]
    which = F.when(F.col("id") % 3 == 0, "sample").when(F.col("id") % 3 == 1, "low-confidence").otherwise("other")
    consensus = rows.select(record, which.alias("set"), "predicted_labels", F.slice("b", 1, 1).alias("remove_labels"), F.slice("b", 2, 1).alias("add_labels"))
    return rounded(U.agreement_rows(auditors, consensus))


@query
def message_instances(spark, sf):
    """Verdict, input and instance of each labelled document, by language."""
    docs = table(spark, sf, "documents")
    both = L.message_instances(table(spark, sf, "labels").select("doc_id", "quality"), docs.select("doc_id", "lang"), docs.select("doc_id", "source"), "doc_id")
    return both.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))


@query
def message_tasks(spark, sf):
    """Audit tasks of codings of every other document, the last document first, with their renderings."""
    d = F.col("doc_id")
    pred = table(spark, sf, "labels").select("doc_id", (-d).alias("row_no"), F.when(F.col("quality") == 1, text_array("good", "x")).otherwise(text_array()).alias("p"), F.when(F.col("toxic") == 1, text_array("i", "j")).otherwise(text_array()).alias("i"))
    inputs = table(spark, sf, "documents").where("doc_id % 2 = 0").select("doc_id", F.array("text", F.lit(None)).alias("msg"))
    tasks = L.message_tasks(pred, inputs, "doc_id")
    shown = T.render_prediction(F.col("p"), text_array("F"), text_array(), text_array("y"), F.col("i"), F.when(d % 3 == 0, " seen "))
    return longs(tasks.select("doc_id", "task", F.md5(T.render_messages(F.col("msg"))).alias("messages"), F.md5(shown).alias("shown")))


@query
def rendered_changes(spark, sf):
    """Documents as changes of one file, rendered for reading."""
    commits = F.array(F.struct(F.lit("1").alias("sha"), F.col("text").alias("message")))
    file = F.struct(F.lit("a.md").alias("filename"), F.when(F.col("doc_id") % 3 == 0, "b.md").alias("previous_filename"), F.lit("modified").alias("status"), F.col("doc_id").alias("additions"), F.lit(None).cast("long").alias("deletions"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("+"), "lang")).alias("patch"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.render_diff(commits, F.array(file))).alias("h"))
