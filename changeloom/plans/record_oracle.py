"""DuckDB SQL for the queries over change records, written apart from them."""

from __future__ import annotations

from ..functions import anonymize as A
from ..functions import text as X
from .oracle import DIFF, SETS, matched, pairs, quoted, redacted, uuid5

NL = "chr(10)"
CHANGES = """i as (select o_orderkey as id, o_orderpriority as up, o_custkey::varchar as owner, case o_orderkey % 3 when 1 then 'main' when 2 then 'dev' end as branch, o_orderstatus <> 'P' as ok, l_linenumber as k,
l_partkey || '/' || l_quantity::bigint as sha, case l_returnflag when 'A' then 'added' when 'R' then 'removed' else 'renamed' end as f, l_suppkey as a, case when l_linenumber % 2 = 1 then l_linenumber end as d, case when l_linenumber <> 3 then '+' || l_linestatus || ' é' end as p
from orders join lineitem on l_orderkey = o_orderkey),
g as (select up || '::' || owner || '::' || coalesce(branch, '') as modification_id, up as upstream, owner as fork_owner, coalesce(branch, '') as fork_branch, id, 'h' || id as head_sha, count(*) as n, bool_or(k = 1) as merged, count(*) filter (k in (1, 2)) as defs,
count(*) filter (f = 'added') as added, count(*) filter (f = 'removed') as removed, count(*) filter (f = 'renamed') as renamed, sum(a)::bigint as adds, coalesce(sum(d), 0)::bigint as dels, coalesce(sum(length(p)), 0)::bigint as chars from i group by up, owner, branch, id),
c as (select * from g qualify row_number() over (partition by modification_id order by id) = 1)"""

PATCHES = """inst as (select doc_id as id, coalesce(source, '') as upstream from documents), n as (select count(*) as n, count(distinct upstream) as u from inst),
sk as (select id, upstream, 'skills/' || (id % 9) as skill from inst union all select id, upstream, 'lib/util' from inst where id % 4 = 0)"""
SURFACES = "ic as (select id, upstream, 'SKILL.md' as category from inst union all select id, upstream, 'scripts' from inst where id % 2 = 0 union all select id, upstream, 'AGENTS.md' from inst where id % 3 = 0 union all select id, upstream, 'additional files' from inst where id % 5 = 0 union all select id, upstream, 'README.md' from inst where id % 7 = 0)"
COMPANIONS = "ic as (select id, upstream, 'AGENTS.md' as category from inst where id % 3 = 0 union all select id, upstream, 'implementer-prompt.md' from inst where id % 5 = 0)"
PREVALENCE = """w as (select id, 1 / sqrt(count(*) over (partition by upstream)) as w from inst), h as (select category, count(*) as hits, sum(w) as w, count(distinct upstream) as ups from ic join w using (id) group by 1),
r as (select category, count(distinct (ic.upstream, skill)) as skills from ic join sk using (id) group by 1), t as (select (select sum(w) from w) as tw, (select count(distinct (upstream, skill)) from sk) as ts)"""


def agree(sets: str, name: str, shown: bool) -> str:
    """Agreement of two sets of labels; precision and recall of the second against the first, if shown."""
    macro = "(select round(avg(case when n11 + n01 = 0 then 0 else n11 / (n11 + n01) end), 6) from k), (select round(avg(case when n11 + n10 = 0 then 0 else n11 / (n11 + n10) end), 6) from k)" if shown else "null::double, null::double"
    return f"""(with two as ({sets}), u as (select distinct unnest(a || b) as l from two), c as (select l, sum((list_contains(a, l) and list_contains(b, l))::int) as n11, sum((list_contains(a, l) and not list_contains(b, l))::int) as n10,
sum((not list_contains(a, l) and list_contains(b, l))::int) as n01, count(*) as n from two, u group by 1), k as (select *, n - n11 - n10 - n01 as n00 from c),
kk as (select avg(case when pe = 1 then 1 else (po - pe) / (1 - pe) end) as mk from (select (n11 + n00) / n as po, ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n * n) as pe from k)),
p as (select sum(n11) as n11, sum(n10) as n10, sum(n01) as n01, sum(n) as n from k), q as (select *, (2 * n11 + n10 + n01) / (2 * n) as p1 from p),
m(precision_, recall_) as (select {macro})
select '{name}' as comparison, (select count(*) from two) as records, round((select avg(case when len(list_distinct(a || b)) = 0 then 1 else len(list_intersect(a, b)) / len(list_distinct(a || b)) end) from two), 6) as mean_jaccard, round(mk, 6) as macro_kappa,
round(2 * n11 / (2 * n11 + n10 + n01), 6) as positive_agreement, round(1 - ((n10 + n01) / n) / (2 * p1 * (1 - p1)), 6) as alpha, precision_ as precision, recall_ as recall from q, kk, m)"""


GOLD = "list_distinct(list_filter(a, lambda x: not list_contains(b[1:1], x)) || b[2:2])"


def cleaned() -> str:
    """Turns that stay as commits, trimmed."""
    words = ["Sync with upstream", "fix the index", "lint", "new plugin", "bump it", "readme", "npm i", "allowlist", "-"]
    case = " ".join(f"when {i} then {quoted(w)}" for i, w in enumerate(words))
    edge = "[^" + chr(92) + "p{L}" + chr(92) + "p{N}" + chr(92) + "p{M}_]"
    tests = " or ".join(f"regexp_matches(s, {quoted(f'(?i)(?:^|{edge})(?:{w})(?:$|{edge})')})" for _, w in X.MAINTENANCE)
    return f"""with m as (select conv_id, turn, case turn when 1 then case conv_id % 9 {case} end || ' ' || text else text || {NL} || {NL} || {NL} || {NL} || 'Signed-off-by: A <a@b>' || {NL} end as m from conversations where turn > 0),
t as (select conv_id, turn, trim(regexp_replace(regexp_replace(m, '(?im)^(?:{X.FOOTERS}):.*$', '', 'g'), '\\n{{3,}}', {NL} || {NL}, 'g'), ' ' || chr(9) || {NL} || chr(13)) as t from m), s as (select *, string_split(t, {NL})[1] as s from t)
select conv_id, turn, md5(t) as h from s where t <> '' and not ({tests})"""


def digest(value: str, prefix: str) -> str:
    """Short pseudonym."""
    return f"'{prefix}-' || substr(sha256('{A.SALT}:{prefix}:' || {value}), 1, 12)"


LABEL_FAULTS = [("doc_id % 7 = 0", "version"), ("doc_id % 5 = 0", "assignments differ from labels"), ("doc_id % 19 = 0 and doc_id % 5 <> 0", "repeated assignment"), ("doc_id % 11 = 0", "unknown label"), ("toxic = 1 and doc_id % 5 <> 0", "no evidence"), ("doc_id % 17 = 0", "confidence"), ("doc_id % 23 = 0", "evidence type"), ("doc_id % 17 <> 0 and (doc_id % 23 = 0 or quality = 0)", "high confidence without patch evidence"), ("doc_id % 13 = 0", "patch sufficiency")]
CODING_FAULTS = [("doc_id % 5 <> 0 and doc_id % 7 = 0", "unknown label"), ("doc_id % 5 = 0", "repeated label"), ("doc_id % 11 <> 0 and doc_id % 13 <> 0 and doc_id % 17 = 0", "unknown category"), ("doc_id % 3 = 0", "families differ from labels"), ("doc_id % 11 <> 0 and doc_id % 13 = 0", "no category"), ("doc_id % 11 = 0", "a missing category isn''t alone"), ("(toxic = 1) <> (quality <> 1)", "intentions")]


def faults(of: list[tuple[str, str]]) -> str:
    """Faults of the labels' records."""
    return f"select doc_id, concat_ws('; ', {', '.join(f"case when {test} then '{name}' end" for test, name in of)}) as errors from labels"


SQL = {
    "surface_prevalence": f"with {PATCHES}, {SURFACES}, {PREVALENCE} select category, hits, n as analyzed, round(hits / n, 6) as prevalence, round(h.w / tw, 6) as adjusted_prevalence, skills, ts as observed_skills, round(skills / ts, 6) as skill_breadth, ups as upstreams, u as observed_upstreams, round(ups / u, 6) as upstream_coverage from h join r using (category), n, t",
    "companion_prevalence": f"with {PATCHES}, {COMPANIONS}, {PREVALENCE} select category as file, hits, n as analyzed, round(hits / n, 6) as prevalence, ups as upstreams, u as observed_upstreams, round(ups / u, 6) as upstream_coverage from h, n",
    "metadata_split": "with m as (select count(*) as n, count(*) filter (doc_id % 3 <> 1) as d from documents where doc_id % 4 <> 0), l as (select n, unnest(['metadata_instances', 'on_description', 'other_fields_only']) as \"group\", unnest([n, d, n - d]) as instances from m) select \"group\", instances, round(instances / n, 6) as share from l",
    "patch_roots": """with k as (select doc_id, 'skills/' || (doc_id % 9) as k from documents) select doc_id::varchar as modification_id, concat_ws(',', k, case when doc_id % 2 = 0 then k end, case when doc_id % 3 = 0 then k end, case when doc_id % 5 = 0 then k end, case when doc_id % 7 = 0 then '' end, case when doc_id % 4 = 0 then 'lib/util' end) as roots,
concat_ws(',', 'SKILL.md', case when doc_id % 2 = 0 then 'scripts/run.py' end, case when doc_id % 3 = 0 then 'AGENTS.md' end, case when doc_id % 5 = 0 then 'implementer-prompt.md' end, case when doc_id % 7 = 0 then 'README.md' end, case when doc_id % 4 = 0 then 'a.ts' end) as relatives, concat_ws(',', k, case when doc_id % 4 = 0 then 'lib/util' end) as skills from k""",
    "candidate_features": f"with {CHANGES} select modification_id, upstream, fork_owner, fork_branch, head_sha, n as commit_count, merged as has_merge_commit, n as file_count, defs as skill_md_file_count, added as added_files, removed as removed_files, renamed as renamed_files, adds as total_additions, dels as total_deletions, chars as skill_patch_chars from c",
    "label_inputs": f"with {CHANGES} select modification_id, upstream || '--' || fork_owner || '--' || case fork_branch when '' then 'x' else fork_branch end as stem, n as commits, n as files, dels as deletions, chars as patch_chars, n as raw_file_count, 'full' as sample_stratum from c",
    "shared_history": f"with {CHANGES}, o as (select * from i where ok), s as (select up, sha from o group by 1, 2 having count(distinct owner) > 1) select id as row_no, count(*) as commits, string_agg(sha, ',' order by sha) as shas from o where not exists (select 1 from s where s.up = o.up and s.sha = o.sha) group by 1",
    "first_changes": "select o_orderkey as row_no, o_orderpriority as upstream from orders where o_orderkey in (select l_orderkey from lineitem) order by 1 limit 500",
    "commit_cleaning": cleaned(),
    "sync_rows": "select c_custkey, c_custkey % 7 in (1, 2, 3, 4) or c_custkey % 5 in (1, 2) as sync from customer",
    "path_scopes": """with p as (select page_id, regexp_extract(url, '://([^?#]*)', 1) || '.md' as own from pages) select page_id, page_id % 16 in (0, 2, 12, 14) as maintenance, page_id % 16 in (1, 3, 6, 8, 10, 13, 15) as asset, strpos(own, '/') > 0 and starts_with(own, regexp_extract(own, '^[^/]+', 0)) as own_asset from p""",
    "definition_probe": "select page_id, page_id % 4 = 0 or (page_id % 3 = 0 and page_id % 7 <> 0 and page_id % 5 = 0) as holds from pages",
    "repo_metadata": "select c_name as repo_name, c_custkey as stars, c_custkey * 7 % 100 as forks, case when c_custkey % 3 = 0 then 'trunk' else 'main' end as default_branch, '2024-01-01T00:00:00+00:00' as captured_at from customer",
    "branch_rows": "select distinct c_custkey, c_name as full_name, o_orderpriority as fork_branch from customer join orders on o_custkey = c_custkey",
    "frontmatter_fields": "with d as (select *, doc_id % 5 <> 0 and doc_id % 4 > 1 as good from documents) select doc_id, case when good then 'n ' || lang end as name, case when good then doc_id end as number, case when good then 2::bigint end as second from d",
    "vocabularies": "select distinct 'patterns' as vocabulary, p_type as name from part union all select 'what', n_name from nation union all select 'what', 'missing-what' union all select 'why', n_name from nation where n_nationkey > 0 union all select 'why', 'missing-why'",
    "sorted_pairs": f"""with p as (select a, b, round(prevalence, 6) as prevalence from ({pairs()})), r as (select * from (values ('REGION_2', 1), ('AMERICA', 2), ('ASIA', 3)) as t(name, k))
select a, b, prevalence, row_number() over (order by prevalence desc, coalesce(x.k, 4), coalesce(y.k, 4), a, b) as place from p left join r x on x.name = a left join r y on y.name = b""",
    "match_tables": f"with {DIFF}, {matched('dl')}, t as (select 'added' as matches_on, role, id from m where role = 'added' union all select 'context', role, id from m where role <> 'added' union all select 'removed', role, id from m where role = 'removed') select matches_on, role, count(*) as matches, count(distinct id) as instances from t group by 1, 2",
    "release_instances": f"with t as (select doc_id, source, text || ' token=abc' as a, '+' || text as p, source || '::' || doc_id || '::main' as v from documents) select doc_id, case when doc_id % 2 = 0 then {uuid5('v')} else source end as modification_id, md5({redacted('a')} || '|<LOCAL_USER_PATH>/x') as messages, md5({redacted('p')}) as patch from t",
    "release_diffs": f"select c_custkey, case when c_custkey % 5 = 0 then '' else {digest('c_name', 'fork-owner')} end as fork_owner, case when c_custkey % 3 > 0 then {digest("('b' || c_custkey)", 'sha')} end as merge_base_sha, {digest("('h' || c_custkey)", 'sha')} as head_sha, {digest('c_custkey', 'sha')} as sha, 'token=<REDACTED> y' as message from customer",
    "release_forks": f"with d as (select c_custkey, c_name, case when c_custkey % 5 = 0 then '' else {digest('c_name', 'fork-owner')} end as owner from customer) select c_custkey, owner, case owner when '' then c_name else owner end || '/' || c_name as full_name, 'https://h.example/' || case owner when '' then c_name else owner end || '/' || c_name || '.git' as clone_url from d",
    "label_record_errors": faults(LABEL_FAULTS),
    "message_coding_errors": faults(CODING_FAULTS),
    "coded_ids": "select doc_id, 'repeated' as error from labels where toxic = 1 union all select -doc_id - 1, 'unknown' from labels where quality = 0 union all select doc_id, 'not coded' from documents where doc_id not in (select doc_id from labels)",
    "agreement_rows": f"with {SETS}, co as (select id, {GOLD} as a, a as b from two) "
    + " union all ".join([agree("select list_filter(a, lambda x: not list_contains(b[1:1], x)) as a, list_distinct(a || b[1:1]) as b from two", "auditors", False), agree("select a, b from co where id % 3 = 0", "model, sample", True), agree("select a, b from co where id % 3 = 1", "model, low-confidence", True), agree("select a, b from co", "model, all", True)]),
    "message_instances": "select lang, source, count(*) as n, sum(quality)::bigint as good from labels join documents using (doc_id) group by 1, 2",
    "message_tasks": f"""select doc_id, row_number() over (order by -doc_id) as task, md5('## Commit messages' || {NL} || {NL} || {NL} || '```' || {NL} || trim(text, ' ' || chr(9) || {NL} || chr(13)) || {NL} || '```' || {NL} || {NL} || '```' || {NL} || {NL} || '```') as messages,
md5(array_to_string(list_filter(['## What axis' || {NL}, '**pred_labels:** ' || case when quality = 1 then '`good`, `x`' else '_(none)_' end, '**families:** `F`', '**what_expression:** _(none)_', {NL} || '## Why axis' || {NL}, '**why_expression:** `y`', case when toxic = 1 then '**why_intentions:**' else '**why_intentions:** _(none)_' end,
case when toxic = 1 then '- i' end, case when toxic = 1 then '- j' end, case when doc_id % 3 = 0 then {NL} || '## Evidence' || {NL} || {NL} || 'seen' end], lambda x: x is not null), {NL} || {NL})) as shown from labels join documents using (doc_id) where doc_id % 2 = 0""",
    "rendered_changes": f"""select doc_id, md5(array_to_string(list_filter(['## Commit messages' || {NL}, '```' || {NL} || trim(text, ' ' || chr(9) || {NL} || chr(13)) || {NL} || '```', {NL} || '## Files' || {NL}, '### `a.md`  (modified, +' || doc_id || '/-0)', case when doc_id % 3 = 0 then '_renamed from `b.md`_' end,
case when doc_id % 2 = 0 then '```diff' || {NL} || '+' || lang || {NL} || '```' else '_(empty patch — no diff content captured)_' end], lambda x: x is not null), {NL} || {NL})) as h from documents""",
}
