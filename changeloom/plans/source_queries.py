"""Queries that stage rows of the tables in the shared folder and read them back through the library's sources, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as U
from ..operators import features as T
from ..operators import metrics as M
from ..operators.numbering import running
from ..sources import comparisons, io, versions
from ..sources.tables import new_path, remove_at_end
from .queries import query, rounded, table

SQL: dict[str, str] = {}


def place(spark, tag: str) -> str:
    """A new folder that goes when the application ends."""
    path = new_path(spark, tag)
    remove_at_end(spark, path)
    return path


@query
def compared_documents(spark, sf):
    """Documents as comparisons, a file for each line, of which those below the prefix count; some branches aren't there."""
    d = F.col("doc_id")
    line = lambda x, i: F.struct(F.concat(F.element_at(F.array(F.lit("skills/"), F.lit("docs/"), F.lit("")), i % 3 + 1), F.lit("f"), i.cast("string")).alias("filename"), F.lit("modified").alias("status"), F.char_length(x).alias("additions"))
    commits = F.array(F.struct(F.concat(F.lit("c"), d.cast("string")).alias("sha"), F.struct(F.col("lang").alias("message")).alias("commit")))
    files = F.when(d % 5 == 0, F.array().cast("array<struct<filename:string,status:string,additions:int>>")).otherwise(F.transform(F.split("text", "\n"), line))
    body = F.to_json(F.struct(d.alias("ahead_by"), commits.alias("commits"), files.alias("files")))
    asked = table(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("upstream"), F.col("lang").alias("fork_owner"), F.concat(F.lit("b"), d.cast("string")).alias("fork_branch"), F.lit("main").alias("base"), F.lit("skills/").alias("prefix"), F.when(d % 7 != 0, body).alias("body"))
    path = place(spark, "requests")
    comparisons.stage(asked, path)
    read = comparisons.read_comparisons(spark, path).where("status != 'no_diff' and fork_owner in ('en', 'fr', 'de')")
    return read.select("upstream", "fork_branch", "status", "head_sha", "ahead_by", F.size("files").cast("long").alias("files"), F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["additions"]).alias("additions"))


SQL["compared_documents"] = """with d as (select *, case when doc_id % 5 = 0 then [] else string_split(text, chr(10)) end as l from documents where lang in ('en', 'fr', 'de')),
f as (select doc_id, count(*) as n, sum(len(x)) as a from (select doc_id, unnest(l) as x, generate_subscripts(l, 1) as i from d) where (i - 1) % 3 = 0 group by 1)
select coalesce(source, '') as upstream, 'b' || doc_id as fork_branch, case when doc_id % 7 = 0 then 'not_found' else 'ok' end as status, case when doc_id % 7 <> 0 then 'c' || doc_id end as head_sha, case when doc_id % 7 <> 0 then doc_id end as ahead_by,
case when doc_id % 7 = 0 then 0 else n end as files, case when doc_id % 7 = 0 then 0 else a end::bigint as additions from d left join f using (doc_id) where doc_id % 7 = 0 or n > 0"""


@query
def staged_lines(spark, sf):
    """Documents as lines of JSON, some of them cut off: those that can be read, with their place."""
    d = F.col("doc_id")
    whole = F.to_json(F.struct(d, "text", "n_chars"))
    lines = table(spark, sf, "documents").select(d, F.when(d % 9 == 0, F.substring(whole, 1, 8)).when(d % 11 == 0, F.concat(whole, F.lit("\n\n"))).otherwise(whole).alias("value"))
    path = place(spark, "lines")
    lines.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    read = io.read_jsonl(spark, path, "doc_id long, text string, n_chars long")
    numbered = running(read, [F.col("row_no")])
    return numbered.select("doc_id", F.md5("text").alias("h"), "n_chars", "place")


SQL["staged_lines"] = "select doc_id, md5(text) as h, n_chars, row_number() over (order by doc_id) as place from documents where doc_id % 9 <> 0"


@query
def staged_folder(spark, sf):
    """Suppliers as a JSON file each, of two shapes, read back as VARIANT."""
    s = table(spark, sf, "supplier")
    rows = s.select(F.concat(F.lit("s-"), "s_suppkey").alias("stem"), F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 2 == 0, F.struct(F.col("s_name").alias("name"), F.array(F.round("s_acctbal", 2)).alias("amounts"))).alias("deep"))
    path = place(spark, "folder")
    io.write_per_row(rows, path)
    get = lambda p, kind: F.try_variant_get("value", p, kind)
    return io.read_variants(spark, path).select("stem", get("$.key", "long").alias("key"), get("$.deep.name", "string").alias("name"), get("$.deep.amounts[0]", "double").alias("amount"))


SQL["staged_folder"] = "select 's-' || s_suppkey as stem, s_suppkey as key, case when s_suppkey % 2 = 0 then s_name end as name, case when s_suppkey % 2 = 0 then round(s_acctbal, 2) end as amount from supplier"


@query
def replaced_rows(spark, sf):
    """Customers, replaced by a version made of themselves: some changed, some gone, and the version before still there."""
    path, kind = place(spark, "versions"), "c_custkey long, c_acctbal double"
    versions.replace_rows(table(spark, sf, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal")), path)
    now = versions.read_version(spark, path, kind)
    versions.replace_rows(now.where("c_custkey % 5 != 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.lit(0.0)).otherwise(F.col("c_acctbal"))), path, after=1)
    old = versions.read_version(spark, path, kind, number=1).select("c_custkey", F.col("c_acctbal").alias("before"))
    return old.join(versions.read_version(spark, path, kind), "c_custkey", "left")


SQL["replaced_rows"] = "select c_custkey, round(c_acctbal, 2) as before, case when c_custkey % 5 = 0 then null when c_custkey % 3 = 0 then 0.0 else round(c_acctbal, 2) end as c_acctbal from customer"


@query
def share_order(spark, sf):
    """Customers by nation in a report's order: the larger first, equal ones by name."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return running(rounded(M.share(c.select(F.col("n_name"), (F.col("c_custkey") % 4).alias("k")).select(F.concat_ws(" ", "n_name", F.col("k").cast("string")).alias("name")), "name")), [F.desc("n"), F.col("name")])


SQL["share_order"] = "with c as (select n_name || ' ' || (c_custkey % 4) as name, count(*) as n from customer join nation on n_nationkey = c_nationkey group by 1) select name, n, sum(n) over ()::bigint as total, round(n / sum(n) over (), 6) as share, row_number() over (order by n desc, name) as place from c"


@query
def canonical_order(spark, sf):
    """Types of parts of every brand in a fixed order, those it doesn't name last, by name."""
    order = ["STANDARD", "PROMO", "SMALL"]
    types = table(spark, sf, "part").select("p_brand", "p_type").distinct()
    return running(types, [M.canonical_rank(F.col("p_type"), order), F.col("p_type")], ("p_brand",))


SQL["canonical_order"] = "with t as (select distinct p_brand, p_type from part) select *, row_number() over (partition by p_brand order by case p_type when 'STANDARD' then 1 when 'PROMO' then 2 when 'SMALL' then 3 else 4 end, p_type) as place from t"


@query
def batch_status(spark, sf):
    """Documents, labelled ones and batches that are left, by source."""
    docs = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("done")).distinct(), "doc_id", "left")
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count("done").alias("done"))
    return counts.select("source", "total", "done", M.batches(F.col("total"), F.col("done"), 7).alias("left"))


SQL["batch_status"] = "select source, count(*) as total, count(l.doc_id) as done, ceil((count(*) - count(l.doc_id)) / 7.0)::bigint as left from documents d left join (select distinct doc_id from labels) l using (doc_id) group by 1"


@query
def blind_messages(spark, sf):
    """Labelled documents as what an annotator may see of them: id and messages, no label."""
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    instances = both.select(F.col("doc_id").cast("string").alias("modification_id"), F.array("text", "lang").alias("msg"), F.array(F.col("quality").cast("string")).alias("gt_labels"))
    return T.message_inputs(instances).select("modification_id", F.md5(F.array_join("msg", "|")).alias("h"))


SQL["blind_messages"] = "select doc_id::varchar as modification_id, md5(text || '|' || lang) as h from documents join labels using (doc_id)"


@query
def type_matrix(spark, sf):
    """Parts of every brand by type, a column for each type, as a heat map needs them."""
    counts = table(spark, sf, "part").groupBy("p_brand", F.translate("p_type", " ", "_").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    out = T.matrix(counts, "p_brand", "t", "n")
    row = F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in sorted(out.columns) if c != "p_brand"])
    return out.select("p_brand", F.to_json(row).alias("row"))


SQL["type_matrix"] = """with t as (select distinct replace(p_type, ' ', '_') as t from part), b as (select distinct p_brand from part),
c as (select p_brand, replace(p_type, ' ', '_') as t, count(*) as n from part group by 1, 2)
select p_brand, '{' || string_agg('"' || t || '":' || coalesce(n, 0), ',' order by t) || '}' as row from b cross join t left join c using (p_brand, t) group by 1"""


@query
def rendered_labels(spark, sf):
    """Labels of documents as Markdown: one or two with evidence, some of low confidence, or none, with a rationale or without."""
    d = F.col("doc_id")
    proof = F.array(F.struct(F.lit("patch").alias("type"), F.concat(F.lit(" "), F.col("source"), F.lit(" ")).alias("summary"), F.when(d % 3 == 0, F.concat(F.col("lang"), F.lit(".md"))).alias("file")))
    label = lambda name, level: F.struct(F.lit(name).alias("name"), level.alias("confidence"), proof.alias("evidence"))
    level = F.when(F.col("toxic") == 1, "low").otherwise("high")
    labels = F.when(d % 4 == 0, F.array().cast("array<struct<name:string,confidence:string,evidence:array<struct<type:string,summary:string,file:string>>>>")).when(F.col("quality") == 1, F.array(label("good", level))).otherwise(F.array(label("bad", level), label("short", F.lit("high"))))
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return both.select("doc_id", U.render_labels(labels, F.when(d % 2 == 0, F.col("lang")), F.lit("sufficient"), d % 5 == 0).alias("text"))


SQL["rendered_labels"] = """with x as (select *, case when toxic = 1 then '**low** ⚠️ LOW' else '**high**' end as level, chr(10) || chr(10) as nn,
chr(10) || chr(10) || '- ' || source || case when doc_id % 3 = 0 then chr(10) || '  ↳ `' || lang || '.md`' else '' end as proof from documents join labels using (doc_id))
select doc_id, '## Model prediction' || chr(10) || nn || case when doc_id % 4 = 0 then '_(no labels assigned)_' when quality = 1 then '### `good` — confidence: ' || level || proof else '### `bad` — confidence: ' || level || proof || nn || '### `short` — confidence: **high**' || proof end
|| case when doc_id % 2 = 0 then nn || chr(10) || '## Rationale' || nn || lang else '' end || nn || chr(10) || '---' || chr(10) || '_patch_sufficiency: sufficient · uninformative_commit_messages: ' || case when doc_id % 5 = 0 then 'True' else 'False' end || '_' as text from x"""
