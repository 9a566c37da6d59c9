"""Queries that run the operators over the tables of a folder. Each takes (spark, sf_dir) and returns a DataFrame.

An instance is an order: its upstream is the customer, its labels are the nations of its suppliers, the labels' families
are their regions, and its skills are the brands of its parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

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

QUERIES = {}


def query(f):
    """Register a query under its name."""
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def fact(spark: SparkSession, sf: str) -> DataFrame:
    """(id, upstream, pattern, family, skill, flag) of every line item. Dimensions of fixed size are broadcast by size."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    supplier = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag")
    rows = items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("upstream"), F.col("n_name").alias("pattern"), F.col("r_name").alias("family"), F.col("p_brand").alias("skill"), F.col("l_returnflag").alias("flag"))


def instances(spark: SparkSession, sf: str, categories: str = "family") -> DataFrame:
    """(id, upstream, categories, skills) of every order with line items."""
    return fact(spark, sf).groupBy("id", "upstream").agg(F.collect_set(categories).alias("categories"), F.collect_set("skill").alias("skills"))


def two_sets(spark: SparkSession, sf: str) -> DataFrame:
    """(id, a, b): families of an order's returned and of its other accepted line items."""
    of = lambda f: F.array_sort(F.collect_set(F.when(F.col("flag") == f, F.col("family"))))
    return fact(spark, sf).where("flag in ('R', 'A')").groupBy("id").agg(of("R").alias("a"), of("A").alias("b"))


@query
def prevalence_patterns(spark, sf):
    """Prevalence of the labels."""
    return rounded(M.prevalence(instances(spark, sf, "pattern")).orderBy(F.desc("prevalence"), "category"))


@query
def prevalence_families(spark, sf):
    """Prevalence of the families."""
    return rounded(M.prevalence(instances(spark, sf)).orderBy(F.desc("prevalence"), "category"))


@query
def family_bundles(spark, sf):
    """Families that occur together, in twos and threes."""
    return rounded(M.bundles(instances(spark, sf))).withColumn("rank", F.col("rank").cast("long")).withColumn("size", F.col("size").cast("long"))


@query
def family_pairs(spark, sf):
    """Co-occurrence of all pairs of families."""
    return rounded(M.pairs(instances(spark, sf)))


@query
def pairs_top_n(spark, sf):
    """Co-occurrence of the three most frequent families."""
    return rounded(M.pairs(instances(spark, sf), top=3))


@query
def label_families(spark, sf):
    """Families through the label map, where one label is unknown and vanishes."""
    mapping = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey > 0").select(F.col("n_name").alias("pattern"), F.col("r_name").alias("family"))
    rows = instances(spark, sf, "pattern").select("id", F.col("categories").alias("labels"))
    return L.families(rows, mapping).select("id", F.size("labels").cast("long").alias("n_labels"), F.array_join("families", ",").alias("families"))


@query
def instance_share(spark, sf):
    """Share of orders by segment."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(M.share(rows, "c_mktsegment"))


@query
def recall_hit_rate(spark, sf):
    """Mean recall and any-hit rate of one set of families against the other."""
    return rounded(M.recall(two_sets(spark, sf).select(F.col("a").alias("pred"), F.col("b").alias("ref"))))


@query
def label_mismatch(spark, sf):
    """Pooled labels that the other set lacks."""
    return rounded(M.mismatch(two_sets(spark, sf).select(F.col("a").alias("pred"), F.col("b").alias("ref"))))


@query
def agreement(spark, sf):
    """Agreement of both sets."""
    return rounded(M.agreement(two_sets(spark, sf)))


@query
def macro_pr(spark, sf):
    """Macro precision and recall of one set against the other."""
    return rounded(M.macro(two_sets(spark, sf).select(F.col("a").alias("pred"), F.col("b").alias("gold"))))


@query
def audit_precision(spark, sf):
    """Pooled precision and recall after corrections, with Wilson bounds."""
    rows = two_sets(spark, sf).select(F.col("a").alias("pred"), F.slice("b", 1, 1).alias("removed"), F.slice("b", 2, 2).alias("added"))
    return rounded(M.precision_recall(rows))


@query
def final_labels(spark, sf):
    """The three forms of final labels."""
    rows = two_sets(spark, sf).select("id", "a", F.slice("b", 1, 1).alias("r"), F.slice("b", 1, 2).alias("d"))
    show = lambda c: F.array_join(F.array_sort(c), ",")
    return rows.select("id", show(L.final_ordered(F.col("a"), F.col("r"), F.col("d"))).alias("ordered"), show(L.final_set(F.col("a"), F.col("r"), F.col("d"))).alias("as_set"), show(L.final_strict(F.col("a"), F.col("r"), F.col("d"))).alias("strict"))


@query
def kappa_alpha(spark, sf):
    """Cohen's kappa of the two marks of the labelled documents."""
    n = lambda q, t: F.sum(F.when((F.col("quality") == q) & (F.col("toxic") == t), 1).otherwise(0))
    c = table(spark, sf, "labels").agg(n(1, 1).alias("n11"), n(1, 0).alias("n10"), n(0, 1).alias("n01"), n(0, 0).alias("n00"))
    return rounded(c.select("*", M.kappa(*map(F.col, ("n11", "n10", "n01", "n00"))).alias("kappa")))


@query
def why_family_lift(spark, sf):
    """Lift of property keys by type of event."""
    rows = table(spark, sf, "events").select(F.array("event_type").alias("why"), F.array(F.get_json_object("props", "$.k")).alias("what"))
    return rounded(M.conditional_lift(rows, "why", "what"))


@query
def expression_share(spark, sf):
    """Share of the types and property keys of events over all events, repeats within an event counted."""
    rows = table(spark, sf, "events").select(F.array("event_type", F.get_json_object("props", "$.k"), "event_type").alias("e"))
    return rounded(M.expression_share(rows, "e"))


@query
def wilson_bounds(spark, sf):
    """Share of good documents by source, with bounds."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    g = rows.groupBy("source").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return rounded(g.select("source", "k", "n", low.alias("low"), high.alias("high")))


@query
def cochran_size(spark, sf):
    """Sample sizes by source and for all documents."""
    sizes = table(spark, sf, "documents").rollup("source").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select(F.coalesce("source", F.lit("(all)")).alias("source"), "n", M.cochran(F.col("n")).alias("size"))


@query
def stratified_quotas(spark, sf):
    """Quotas of 300 documents by language."""
    return S.quotas(table(spark, sf, "documents"), "lang", "doc_id", 300).select("lang", "quota")


@query
def stratified_sample(spark, sf):
    """A draw of 300 documents by those quotas."""
    return S.stratified(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 300).select("doc_id", "lang", "sample_stratum")


@query
def random_sample(spark, sf):
    """A draw of 100 documents."""
    return S.simple(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 100)


@query
def audit_population(spark, sf):
    """The draw and the toxic documents, tagged."""
    low = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return S.tagged_population(random_sample(spark, sf).select("doc_id"), low, "doc_id")


@query
def batch_claim(spark, sf):
    """The next 50 documents that are neither drawn nor labelled."""
    return S.claim(table(spark, sf, "documents").select("doc_id"), random_sample(spark, sf), table(spark, sf, "labels"), "doc_id")


@query
def active_entities(spark, sf):
    """Users with more than five minutes between first and last event."""
    t = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return t.where(C.is_active(F.col("a"), F.col("b"))).select("user_id")


@query
def shared_keys_drop(spark, sf):
    """Values that a single user has for a type of event, counted by type."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("scope"), F.col("user_id").alias("owner"), F.round("value", 1).alias("item"))
    own = e.join(C.shared(e), ["scope", "item"], "left_anti")
    return own.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("owner").alias("owners"))


@query
def first_wins_dedup(spark, sf):
    """The first document of each text."""
    return C.first_wins(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h")), "h", order="doc_id")


@query
def subset_dedup(spark, sf):
    """Orders of a customer whose set of brands no other of their orders holds."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    supplier = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    items = table(spark, sf, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    items = items.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    items = items.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = items.groupBy(F.col("o_orderkey").alias("row_no"), F.col("o_custkey").alias("upstream"), "o_orderstatus").agg(F.collect_set("p_brand").alias("skills"))
    return C.maximal_keys(rows, ["upstream"], "skills", F.col("o_orderstatus") == "O").select(F.col("row_no").alias("id"), "upstream")


@query
def subset_dedup_hot(spark, sf):
    """Orders of a nation whose set of parts no other order there holds; all sets share one item."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_no"), F.concat(F.lit("p"), (F.col("l_partkey") % 400).cast("string")).alias("part"))
    sets = lines.groupBy("row_no").agg(F.concat(F.collect_set("part"), F.array(F.lit("everywhere"))).alias("parts"))
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("row_no"), F.col("c_nationkey").alias("nation"), "o_orderstatus")
    return C.maximal_keys(sets.join(orders, "row_no"), ["nation"], "parts", F.col("o_orderstatus") == "O").select(F.col("row_no").alias("id"), "nation")


@query
def resume_anti_join(spark, sf):
    """Documents that have no label yet, counted by source."""
    return L.resume(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query
def consensus_override(spark, sf):
    """Labels of orders, replaced by a consensus where there is one, rows left without any dropped."""
    rows = two_sets(spark, sf)
    out = L.with_consensus(rows.select("id", F.col("a").alias("labels")), rows.where("id % 3 = 0").select("id", F.col("b").alias("labels")), "id")
    return out.select("id", F.array_join(F.array_sort("labels"), ",").alias("labels"))


@query
def joined_inputs(spark, sf):
    """Labelled documents with their text's length, and how many documents have no label."""
    found, missing = L.with_inputs(table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    n = missing.agg(F.count(F.lit(1)).alias("without"))
    return found.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).crossJoin(F.broadcast(n)).select(F.col("quality").cast("long").alias("quality"), "n", "chars", "without")


@query
def upsert_merge(spark, sf):
    """Customers with some replaced and some added."""
    old = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.where("c_custkey % 2 = 0").select((F.col("c_custkey") * 3).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"), F.lit(True).alias("seen"))
    return L.upsert(old, new, "c_custkey")


@query
def message_noise(spark, sf):
    """Classes of turns, some given the subject of a mechanical commit."""
    heads = ["Merge pull request #7 from x", "Merge branch 'a'", "Merge the rest", "Revert \"it\"", "v1.2.3 out", "Release 2.0", "Initial commit", "update readme.md", "Created with care", "Squashed commit of the following:", ""]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("conv_id") % 11 + 1).cast("int"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") == 0, head).otherwise(F.col("text")).alias("m"))
    return c.groupBy(F.coalesce(X.noise_class(F.col("m")), F.lit("(none)")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query
def maintenance_class(spark, sf):
    """Maintenance classes of documents' first lines, some words planted."""
    words = ["Sync with upstream", "fix the index", "lint", "new plugin", "bump it", "readme", "npm i", "allowlist", "-"]
    head = F.element_at(F.array(*map(F.lit, words)), (F.col("doc_id") % 9 + 1).cast("int"))
    c = table(spark, sf, "documents").select("doc_id", F.concat(head, F.lit(" "), "text").alias("m"))
    return c.select("doc_id", F.coalesce(X.maintenance_class(F.col("m")), F.lit("(none)")).alias("class"))


@query
def footer_trim(spark, sf):
    """Documents without planted footers and surplus blank lines."""
    m = F.concat(F.lit("  "), "text", F.lit("\n\n\n\nSigned-off-by: A <a@b>\nFixes: 12\nmore\n\nco-authored-by: B\n \n"))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.trim_footers(m)).alias("h"))


@query
def redact_text(spark, sf):
    """Documents without secrets and local paths, some planted."""
    m = F.concat("text", F.lit(" ghp_abcdefghijklmnopqrstuvwx sk-ABCDEFGHIJKLMNOPQRSTUV Password: hunter2, /home/ann/x /Users/bo/y C:\\Users\\Cy\\z"))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.redact(m)).alias("h"), F.contains(X.redact(F.col("text")), F.lit("<REDACTED>")).alias("had_secret"))


@query
def redact_snippet(spark, sf):
    """Lines of code made from documents, without the values of secret keys."""
    word = F.regexp_extract("text", r"[A-Za-z]+", 0)
    m = F.concat(F.lit("api_key = \"" ), word, F.lit("\" color = '"), word, F.lit("'; my-token="), word, F.lit("; {\"password\": \""), word, F.lit("\"} Bearer "), word)
    return table(spark, sf, "documents").select("doc_id", X.redact_snippet(m).alias("line"))


@query
def pseudonym_digest(spark, sf):
    """Short pseudonyms of customers."""
    return table(spark, sf, "customer").select("c_custkey", A.digest(F.col("c_name"), "customer").alias("pseudonym"))


@query
def pseudonym_uuid5(spark, sf):
    """UUIDs of customers' names, as ids of three parts and of one."""
    return table(spark, sf, "customer").select("c_custkey", A.modification_id(F.concat(F.col("c_mktsegment"), F.lit("::"), "c_name", F.lit("::main"))).alias("id"), A.modification_id(F.col("c_name")).alias("kept"))


@query
def label_parsing(spark, sf):
    """Comma-separated labels, parsed and joined again."""
    raw = F.concat(F.lit(" a ,,"), "n_name", F.lit(", (none) ,b"))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(X.label_list(raw), "|").alias("labels"), X.stem(F.col("n_name"), F.lit("a/b c"), F.lit("//")).alias("stem"))


@query
def csv_decimals(spark, sf):
    """Balances with four decimals, ties to even."""
    return table(spark, sf, "customer").select("c_custkey", X.fixed4(F.col("c_acctbal") / 64).alias("x"))


def document_lines(spark, sf) -> DataFrame:
    """(id, line, content) of the documents, some given a line that a rule matches."""
    planted = ["curl http://x.test/a", "wget https://github.com/x", "cat ~/.ssh/id_rsa", "chmod 777 /x", "eval (x)", "exec(y.decode())", "pip install --upgrade z", "nothing here"]
    extra = F.element_at(F.array(*map(F.lit, planted)), (F.col("doc_id") % 8 + 1).cast("int"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat("text", F.lit("\n"), extra).alias("t"))
    return docs.select("id", F.posexplode(F.split("t", "\n")).alias("line", "content"))


@query
def redact_snippet_lines(spark, sf):
    """Every line of the documents without the values of secret keys. Has no SQL: tests hold it against brute force."""
    return document_lines(spark, sf).select("id", "line", X.redact_snippet(F.col("content")).alias("content"))


@query
def security_matches(spark, sf):
    """Rules, categories and greatest severity of each document with a match."""
    lines = document_lines(spark, sf)
    out = Z.by_instance(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), Z.scan(lines))
    return out.select("id", "flagged", "matches", "severity", "rules", "categories")


@query
def security_summary(spark, sf):
    """Counts over all documents."""
    lines = document_lines(spark, sf)
    return rounded(Z.summary(Z.by_instance(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), Z.scan(lines))))


@query
def security_by_rule(spark, sf):
    """Documents and matches by rule."""
    return rounded(Z.by(Z.scan(document_lines(spark, sf)), ["rule", "category", "severity"], table(spark, sf, "documents")))


@query
def security_by_category(spark, sf):
    """Documents and matches by category."""
    return rounded(Z.by(Z.scan(document_lines(spark, sf)), ["category"], table(spark, sf, "documents")))


def document_diffs(spark, sf, loose: bool = False) -> DataFrame:
    """(id, patch): lines of a document as a diff of one file, six to a hunk, added, removed and kept in turn.

    If ``loose``, the first six lines of odd documents stand before any hunk.
    """
    bare = (F.col("id") % 2 == 1) & F.lit(loose)
    rows = document_lines(spark, sf).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line", "content"))).alias("l"))
    mark = lambda r: F.concat(F.when((r["line"] % 6 == 0) & ~(bare & (r["line"] == 0)), "@@ -1 +1 @@\n").otherwise(""), F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), r["line"] % 3 + 1), r["content"])
    status = F.element_at(F.array(F.lit("modified"), F.lit("added"), F.lit("removed")), (F.col("id") % 3 + 1).cast("int"))
    return rows.select("id", F.concat(F.lit("diff --git a.md a.md  ["), status, F.lit(" +1/-1]\n"), F.array_join(F.transform("l", mark), "\n")).alias("patch"))


@query
def diff_lines(spark, sf):
    """Lines of the diffs by role and status of the file, with hunks."""
    rows = Z.diff_lines(document_diffs(spark, sf))
    return rows.groupBy("role", "file_status").agg(F.count(F.lit(1)).alias("lines"), F.sum("line").alias("line_numbers"), F.max("block").cast("long").alias("last_block"))


@query
def diff_matches_origin(spark, sf):
    """Documents with matches on added lines, on others, on both, by category."""
    return Z.origin(Z.scan(Z.diff_lines(document_diffs(spark, sf))), ["category"])


@query
def diff_line_edits(spark, sf):
    """Documents by edit of the lines that match."""
    return Z.line_edits(Z.scan(Z.diff_lines(document_diffs(spark, sf))))


@query
def diff_hunks(spark, sf):
    """Hunks with matches by status; some documents have lines before their first hunk."""
    lines = Z.diff_lines(document_diffs(spark, sf, loose=True), hunks=True)
    return Z.hunks(Z.scan(lines), Z.hunk_roles(lines)).groupBy("hunk_status", "deleted_only").agg(F.count(F.lit(1)).alias("hunks"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.sum("context").alias("context"))


@query
def diff_removed_alone(spark, sf):
    """Matches on removed lines of hunks without a match on an added line, by rule."""
    return Z.removed_alone(Z.scan(Z.diff_lines(document_diffs(spark, sf)))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query
def diff_origin_total(spark, sf):
    """Documents with matches on added lines, on others, on both."""
    return Z.origin(Z.scan(Z.diff_lines(document_diffs(spark, sf))))


@query
def diff_origin_by_rule(spark, sf):
    """Documents with matches on added lines, on others, on both, by rule."""
    return Z.origin(Z.scan(Z.diff_lines(document_diffs(spark, sf))), ["rule"])


@query
def diff_added_by_rule(spark, sf):
    """Documents and matches on added lines by rule."""
    found = Z.scan(Z.diff_lines(document_diffs(spark, sf))).where("role = 'added'")
    return rounded(Z.by(found, ["rule"], table(spark, sf, "documents")))


@query
def diff_deleted_only(spark, sf):
    """Documents whose matches are all on removed lines."""
    return Z.deleted_only(Z.scan(Z.diff_lines(document_diffs(spark, sf))))


@query
def diff_file_statuses(spark, sf):
    """Documents with matches by status of the file."""
    return Z.file_statuses(Z.scan(Z.diff_lines(document_diffs(spark, sf))))


@query
def document_headings(spark, sf):
    """Headings of documents whose lines were given marks, some inside fences."""
    mark = lambda r: F.when(r["line"] % 7 == 3, F.concat(F.lit("## "), r["content"], F.lit(" "))).when(r["line"] % 11 == 5, "```").otherwise(r["content"])
    rows = document_lines(spark, sf).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line", "content"))).alias("l"))
    h = rows.select("id", D.headings(F.array_join(F.transform("l", mark), "\n")).alias("h"))
    return h.select("id", F.size("h").cast("long").alias("n"), F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x["line"]).alias("lines"))


def page_paths(spark, sf) -> DataFrame:
    """(page_id, path): host and path of each URL."""
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"://([^?#]*)", 1).alias("path"))


@query
def longest_prefix_owner(spark, sf):
    """Longest known directory above each page, among hosts and their language folders of even pages."""
    pages = page_paths(spark, sf)
    even = pages.where("page_id % 2 = 0")
    dirs = even.select(F.regexp_extract("path", r"^[^/]+", 0).alias("dir")).unionByName(even.where("page_id % 4 = 0").select(F.regexp_extract("path", r"^[^/]+/[^/]+", 0).alias("dir")))
    return C.longest_prefix(pages, dirs).select("page_id", "owner")


@query
def path_surface(spark, sf):
    """Surfaces of paths made from pages."""
    heads = ["SKILL.md", "scripts/", "x/references/", "assets/a/", "config.json", "my-example.md", "a.png", "agents/", "plain.md", "x/"]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("page_id") % 10 + 1).cast("int"))
    path = F.when(head.endswith("/"), F.concat(head, F.regexp_extract("path", r"[^/]+$", 0))).otherwise(head)
    return page_paths(spark, sf).groupBy(P.surface(path).alias("surface")).agg(F.count(F.lit(1)).alias("n"))


@query
def funnel_counts(spark, sf):
    """Rows that are left after each step."""
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    unique = docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    labels = table(spark, sf, "labels")
    return C.funnel([("read", "documents", docs), ("unique", "documents", unique), ("labelled", "documents", unique.join(labels, "doc_id")), ("good", "documents", unique.join(labels.where("quality = 1"), "doc_id"))]).withColumn("no", F.col("no").cast("long"))


@query
def turn_window_rank(spark, sf):
    """Rank of turns by length within their conversation, and the running number of assistant turns."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    w = Window.partitionBy("conv_id")
    return c.select("conv_id", "turn", F.row_number().over(w.orderBy(F.desc("n"), "turn")).cast("long").alias("rank"), F.sum((F.col("role") == "assistant").cast("long")).over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)).alias("answers"))


@query
def taxonomy_check(spark, sf):
    """Names that occur more than once in a taxonomy whose families are sizes and whose patterns are types and brands of parts."""
    parts = table(spark, sf, "part").select(F.concat(F.lit("size "), F.col("p_size") % 7).alias("family"), (F.col("p_size") % 14).alias("family_no"), F.concat_ws(" ", "p_brand", "p_type").alias("pattern"))
    return V.taxonomy_errors(parts.distinct()).select("kind", "name", "n")


@query
def verdict_states(spark, sf):
    """Exported states of marks: a labelled document was visited, a bad one has a verdict."""
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    seen, verdict = U.verdict_state(F.col("quality").isNotNull(), F.when(F.col("quality") == 0, "wrong"))
    return rows.groupBy(seen.alias("audited"), verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query
def cochran_draw(spark, sf):
    """A draw of the documents at 95 % confidence and 5 % margin."""
    return U.cochran_draw(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query
def label_jaccard(spark, sf):
    """Similarity of both sets of families of each order, and whether the first holds the second."""
    rows = two_sets(spark, sf)
    return rounded(rows.select("id", M.jaccard(F.col("a"), F.col("b")).alias("jaccard"), (F.size(F.array_except("b", "a")) == 0).alias("holds")))


@query
def popular_repos(spark, sf):
    """Repositories, made from customers, with enough stars and forks and a definition file."""
    c = table(spark, sf, "customer")
    repos = c.select("c_custkey", (F.col("c_custkey") * 3_701 % 40_000).alias("stargazers_count"), (F.col("c_custkey") * 1_301 % 4_000).alias("forks_count"), F.when(F.col("c_nationkey") > 2, F.col("c_nationkey") % 3 > 0).alias("has_skill_md"))
    return C.popular(repos).select("c_custkey")


@query
def keyword_union(spark, sf):
    """Customers that two searches find, each with the first search that found it."""
    c = table(spark, sf, "customer")
    found = [c.where("c_nationkey < 10").select("c_custkey", F.lit("nation").alias("search")), c.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("segment").alias("search"))]
    return C.keyword_union(found, "c_custkey")


@query
def forks_of_upstream(spark, sf):
    """The first 50 orders, by key, of one priority."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_no"), F.col("o_orderpriority").alias("upstream"))
    return C.of_upstream(rows, "1-URGENT", most=50)


def page_changes(spark, sf) -> DataFrame:
    """A change for each page: a definition file that it edits, adds or removes, a script of another package, a file at the top."""
    status = F.element_at(F.array(F.lit("modified"), F.lit("added"), F.lit("removed")), (F.col("page_id") % 3 + 1).cast("int"))
    file = lambda name, of: F.struct(name.alias("filename"), of.alias("status"))
    files = F.array(file(F.concat(F.lit("skills/"), F.col("page_id") % 7, F.lit("/SKILL.md")), status), file(F.concat(F.lit("skills/"), (F.col("page_id") + 1) % 7, F.lit("/deep/a.py")), F.lit("modified")), file(F.lit("README.md"), F.lit("modified")))
    branch = F.when(F.col("page_id") % 11 == 0, "sync/upstream").otherwise("main")
    commits = F.array(F.struct(F.lit("1").alias("sha"), F.lit("edit").alias("message")))
    return table(spark, sf, "pages").select(F.col("page_id").alias("row_no"), (F.col("page_id") % 5).cast("string").alias("upstream"), branch.alias("fork_branch"), commits.alias("commits"), files.alias("files"))


def page_index(spark, sf) -> DataFrame:
    """(repo, path) of four known packages of each upstream but the last."""
    return table(spark, sf, "nation").where("n_nationkey < 16").select((F.col("n_nationkey") % 4).cast("string").alias("repo"), F.concat(F.lit("skills/"), F.floor(F.col("n_nationkey") / 4), F.lit("/SKILL.md")).alias("path"))


@query
def files_in_scope(spark, sf):
    """Files of the pages' changes that lie in known packages."""
    return C.in_scope(page_changes(spark, sf), page_index(spark, sf)).select("row_no", F.array_join("files.filename", ",").alias("files"))


@query
def new_packages(spark, sf):
    """Shares of the pages' changes that edit known packages, add some, or both."""
    return rounded(C.new_packages(page_changes(spark, sf), page_index(spark, sf)))


@query
def predictions_with_truth(spark, sf):
    """Predicted labels of labelled documents, corrected where a verdict is there, and their true ones."""
    labels = table(spark, sf, "labels")
    pred = labels.select("doc_id", F.array(F.when(F.col("quality") == 1, "good").otherwise("bad"), F.lit("x")).alias("pred_labels"))
    verdicts = labels.where("toxic = 1").select("doc_id", F.array(F.lit("x")).alias("remove_labels"), F.array(F.lit("toxic"), F.lit("good")).alias("add_labels"))
    truth = table(spark, sf, "documents").select("doc_id", F.array("lang").alias("gt_labels"))
    out = L.predictions(pred, truth, verdicts, "doc_id")
    return out.select("doc_id", F.array_join("pred_labels", ",").alias("pred"), F.array_join("gt_labels", ",").alias("truth"))


@query
def audit_tasks(spark, sf):
    """Tasks of an audit of the labelled documents, toxic ones first."""
    labels = table(spark, sf, "labels")
    records = labels.select("doc_id", F.when(F.col("toxic") == 1, "low-confidence").otherwise("sample").alias("set"))
    return L.tasks(records, labels.select("doc_id", "quality"), table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "set", F.col("task").cast("long").alias("task"))


@query
def low_confidence(spark, sf):
    """Labelled documents with a label of low confidence; those without assignments have none."""
    mark = lambda c, high: F.struct(F.lit(c).alias("name"), F.when(high, "high").otherwise("low").alias("confidence"))
    rows = table(spark, sf, "labels").select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.array(mark("quality", F.col("quality") == 1), mark("toxic", F.col("toxic") == 0))).alias("a"))
    return rows.select("doc_id", L.low_confidence(F.col("a")).alias("low"))


@query
def instance_identity(spark, sf):
    """Upstream, owner and branch of ids, some of which lack parts."""
    id_ = F.concat_ws("::", "c_mktsegment", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")), F.when(F.col("c_custkey") % 3 > 1, "main"))
    upstream, owner, branch = T.identity(id_)
    return table(spark, sf, "customer").select("c_custkey", upstream.alias("upstream"), owner.alias("owner"), branch.alias("branch"))


@query
def patch_text(spark, sf):
    """Patches of two files each, made from documents."""
    file = F.struct(F.lit("b.md").alias("filename"), F.when(F.col("doc_id") % 2 == 0, "a.md").otherwise("").alias("previous_filename"), F.lit("renamed").alias("status"), F.col("doc_id").alias("additions"), F.lit(None).cast("long").alias("deletions"), F.col("text").alias("patch"))
    other = F.struct(F.lit("c.md").alias("filename"), F.lit(None).cast("string").alias("previous_filename"), F.lit(None).cast("string").alias("status"), F.lit(1).cast("long").alias("additions"), F.lit(2).cast("long").alias("deletions"), F.lit("").alias("patch"))
    return table(spark, sf, "documents").select("doc_id", F.md5(D.patch(F.array(file, other))).alias("h"))
