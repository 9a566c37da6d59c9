"""DuckDB SQL for the queries, written apart from them."""

from __future__ import annotations

import re

from ..functions import anonymize as A
from ..functions import text as X
from ..operators.security import GLOBAL, RULES

FACT = """fact as (select o_orderkey as id, o_custkey as upstream, n_name as pattern, r_name as family, p_brand as skill, l_returnflag as flag
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey),
inst as (select distinct id, upstream from fact), n as (select count(*) as n, count(distinct upstream) as u from inst)"""
SETS = f"""{FACT}, two as (select id, coalesce(list_sort(list_distinct(list(family) filter (flag = 'R'))), []) as a, coalesce(list_sort(list_distinct(list(family) filter (flag = 'A'))), []) as b
from fact where flag in ('R', 'A') group by id)"""


def prevalence(column: str) -> str:
    """Prevalence by a column of the facts."""
    return f"""with {FACT}, size as (select upstream, count(*) as c from inst group by 1), w as (select id, upstream, 1 / sqrt(c) as w from inst join size using (upstream)),
ic as (select distinct id, upstream, {column} as category from fact),
h as (select category, count(*) as hits, sum(w.w) as w, count(distinct ic.upstream) as ups from ic join w using (id) group by 1),
r as (select category, count(distinct (ic.upstream, skill)) as skills from ic join (select distinct id, skill from fact) s using (id) group by 1),
t as (select (select sum(w) from w) as tw, (select count(distinct (upstream, skill)) from fact) as ts)
select category, hits, n as analyzed, round(hits / n, 6) as prevalence, round(h.w / tw, 6) as adjusted_prevalence, skills, ts as observed_skills, round(skills / ts, 6) as skill_breadth,
ups as upstreams, u as observed_upstreams, round(ups / u, 6) as upstream_coverage from h join r using (category), n, t"""


BUNDLES = f"""with {FACT}, ic as (select distinct id, upstream, family as c from fact), k as (select c, count(*) as k from ic group by 1),
b as (select x.id, x.upstream, x.c || ' + ' || y.c as bundle, 2 as size, [x.c, y.c] as l from ic x join ic y on x.id = y.id and x.c < y.c
union all select x.id, x.upstream, x.c || ' + ' || y.c || ' + ' || z.c, 3, [x.c, y.c, z.c] from ic x join ic y on x.id = y.id and x.c < y.c join ic z on x.id = z.id and y.c < z.c),
g as (select bundle, size, any_value(l) as l, count(*) as support, count(distinct upstream) as ups from b group by 1, 2),
r as (select bundle, count(distinct (upstream, skill)) as skills from b join (select distinct id, skill from fact) s using (id) group by 1),
e as (select bundle, product(k / n) as expected from (select bundle, unnest(l) as c from g) join k using (c), n group by 1)
select bundle, size::bigint as size, support, round(support / n, 6) as prevalence, skills, round(ups / u, 6) as upstream_coverage, round(expected, 6) as expected, round(support / n / expected, 6) as lift,
row_number() over (order by support / n desc, size, bundle) as rank from g join r using (bundle) join e using (bundle), n"""


def pairs(top: int | None = None) -> str:
    """Pairs of families."""
    cut = f" order by k desc, c limit {top}" if top else ""
    return f"""with {FACT}, ic as (select distinct id, family as c from fact), k as (select c, count(*) as k from ic group by 1{cut}),
t as (select x.c as a, y.c as b, count(*) as t from ic x join ic y on x.id = y.id and x.c < y.c group by 1, 2)
select p.c as a, q.c as b, p.k as a_count, q.k as b_count, coalesce(t, 0) as together, round(coalesce(t, 0) / n, 6) as prevalence, round(coalesce(t, 0) / n / (p.k / n * q.k / n), 6) as lift
from k p join k q on p.c < q.c left join t on t.a = p.c and t.b = q.c, n"""


def re2(pattern: str) -> str:
    """A pattern for an engine whose word boundaries know ASCII alone: boundaries become classes, which take a character."""
    pattern = re.sub(r"\\b(?=[\w(])", r"(?:^|[^\\p{L}\\p{N}\\p{M}_])", pattern)
    return re.sub(r"\\b", r"(?:$|[^\\p{L}\\p{N}\\p{M}_])", pattern)


def quoted(text: str) -> str:
    """An SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def lines(planted: bool = True) -> str:
    """The documents' lines with the planted one, counted from 0."""
    extra = ["curl http://x.test/a", "wget https://github.com/x", "cat ~/.ssh/id_rsa", "chmod 777 /x", "eval (x)", "exec(y.decode())", "pip install --upgrade z", "nothing here"]
    case = " ".join(f"when {i} then {quoted(t)}" for i, t in enumerate(extra))
    return f"""doc as (select doc_id as id, string_split(text || chr(10) || case doc_id % 8 {case} end, chr(10)) as l from documents),
line as (select id, unnest(l) as content, generate_subscripts(l, 1) - 1 as line from doc)"""


def matched(table: str = "line") -> str:
    """Matches of the rules on a table of lines."""
    tests = []
    for i, r in enumerate(RULES):
        rule = "(?i)" + "|".join(f"(?:{re2(p)})" for p in r.patterns)
        before = "(?i)" + "|".join(f"(?:{re2(p)})" for p in r.prefilters)
        allowed = "".join(f" and strpos(lower(content), {quoted(d)}) = 0" for d in r.allowed)
        tests.append(f"select x.*, {i} as rule_no, '{r.id}' as rule, '{r.category}' as category, '{r.severity}' as severity from x where regexp_matches(content, {quoted(before)}) and regexp_matches(content, {quoted(rule)}){allowed}")
    texts = " or ".join(f"strpos(lower(content), {quoted(t)}) > 0" for t in GLOBAL)
    return f"x as (select * from {table} where {texts}), m as ({' union all '.join(tests)})"


BY_DOC = f"""with {lines()}, {matched()},
g as (select id, count(*) as matches, max(case severity when 'CRITICAL' then 2 else 1 end) as rank, list(rule order by line, rule_no) as rl, list(category order by line, rule_no) as cl from m group by 1),
d as (select doc_id as id, g.id is not null as flagged, coalesce(matches, 0) as matches, case rank when 2 then 'CRITICAL' when 1 then 'WARNING' else '' end as severity,
coalesce(array_to_string(list_filter(rl, lambda x, i: list_position(rl, x) = i), ';'), '') as rules, coalesce(array_to_string(list_filter(cl, lambda x, i: list_position(cl, x) = i), ';'), '') as categories
from documents left join g on g.id = doc_id)"""


def by(keys: str) -> str:
    """Documents and matches by keys."""
    return f"""with {lines()}, {matched()} select {keys}, count(distinct id) as instances, round(count(distinct id) / (select count(*) from documents), 6) as prevalence, count(*) as matches,
round(count(*) / (select count(*) from m), 6) as match_share from m group by {keys}"""


DIFF = f"""{lines()}, dl as (select id, content, ['added', 'removed', 'context'][line % 3 + 1] as role, line // 6 as block, line + line // 6 + 2 as line,
['modified', 'added', 'removed'][id % 3 + 1] as file_status from line where not (line % 3 = 0 and starts_with(content, '++')) and not (line % 3 = 1 and starts_with(content, '--')))"""
FLAGS = "max((role = 'added')::int) as a, max((role <> 'added')::int) as c"

_NOISE_HEADS = ["squashed", "merge_pr", "merge_branch", "merge_other", "revert", "release_note", "release_note", "initial_commit", "update_readme", "create_using"]


def maintenance() -> str:
    """Maintenance classes by the words of each."""
    words = ["Sync with upstream", "fix the index", "lint", "new plugin", "bump it", "readme", "npm i", "allowlist", "-"]
    case = " ".join(f"when {i} then {quoted(w)}" for i, w in enumerate(words))
    tests = " ".join(f"when regexp_matches(s, {quoted('(?i)(?:^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 'p{M}_])(?:' + w + ')(?:$|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 'p{M}_])')}) then '{name}'" for name, w in X.MAINTENANCE)
    return f"with d as (select doc_id, string_split(trim(case doc_id % 9 {case} end || ' ' || text), chr(10))[1] as s from documents) select doc_id, case {tests} else '(none)' end as class from d"


def redacted(column: str) -> str:
    """A text without secrets and paths."""
    out = column
    for p, by_ in [(p, b) for p, b in X.SECRETS] + [(p, "<LOCAL_USER_PATH>") for p in X.LOCAL_PATHS]:
        p = p.replace("(?iU)", "(?i)").replace("(?U)", "")
        out = f"regexp_replace({out}, {quoted(p)}, {quoted(by_.replace('$1', chr(92) + '1'))}, 'g')"
    return out


def uuid5(value: str) -> str:
    """UUID of version 5 in our namespace."""
    import hashlib

    space = hashlib.sha256(A.SALT.encode()).hexdigest()[:32]
    h = f"sha1(unhex('{space}') || encode({value}))"
    variant = f"substr('89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


QUOTAS = """t as (select lang, count(*) as size, min(doc_id) as seen from documents group by 1),
b as (select *, case when sum(least(size, 1)) over () <= 300 then least(size, 1) else 0 end as base from t),
r as (select *, size - base as room, 300 - sum(base) over () as spare, sum(size - base) over () as rooms from b),
w as (select *, case when spare > 0 and rooms > 0 then (spare * room)::double / rooms::double else 0 end as part from r),
o as (select *, least(floor(part), room) as whole from w),
f as (select *, row_number() over (order by whole < room desc, part - floor(part) desc, seen) as turn, spare - sum(whole) over () as more from o),
q as (select lang, (base + whole + (whole < room and part > 0 and turn <= more)::int)::bigint as quota from f)"""
CHANGES = "c as (select page_id, page_id % 5 as up, page_id % 7 as k1, (page_id + 1) % 7 as k2, page_id % 3 as s from pages)"
SQL = {
    "prevalence_patterns": prevalence("pattern"),
    "prevalence_families": prevalence("family"),
    "family_bundles": BUNDLES,
    "family_pairs": pairs(),
    "pairs_top_n": pairs(3),
    "label_families": f"with {FACT}, l as (select id, count(distinct pattern) as n_labels from fact group by 1), f as (select id, string_agg(distinct family, ',' order by family) as families from fact where pattern <> (select n_name from nation where n_nationkey = 0) group by 1) select id, n_labels, coalesce(families, '') as families from l left join f using (id)",
    "instance_share": "select c_mktsegment, count(*) as n, sum(count(*)) over ()::bigint as total, round(count(*) / sum(count(*)) over (), 6) as share from orders join customer on o_custkey = c_custkey group by 1",
    "recall_hit_rate": f"with {SETS} select count(*) as n, round(coalesce(avg(len(list_intersect(a, b)) / len(b)), 0), 6) as recall, round(coalesce(avg((len(list_intersect(a, b)) > 0)::int), 0), 6) as any_hit from two where len(b) > 0",
    "label_mismatch": f"with {SETS}, s as (select sum(len(a))::bigint as asserted, sum(len(list_intersect(a, b)))::bigint as captured from two) select asserted, captured, asserted - captured as unmatched, round((asserted - captured) / asserted, 6) as share_unmatched from s",
    "agreement": f"""with {SETS}, u as (select distinct family as l from fact where flag in ('R', 'A')), c as (select l, sum((list_contains(a, l) and list_contains(b, l))::int) as n11, sum((list_contains(a, l) and not list_contains(b, l))::int) as n10,
sum((not list_contains(a, l) and list_contains(b, l))::int) as n01, count(*) as n from two, u group by 1), k as (select *, n - n11 - n10 - n01 as n00 from c),
kk as (select avg(case when pe = 1 then 1 else (po - pe) / (1 - pe) end) as mk from (select (n11 + n00) / n as po, ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n * n) as pe from k)),
p as (select sum(n11) as n11, sum(n10) as n10, sum(n01) as n01, sum(n) as n from k), q as (select *, (2 * n11 + n10 + n01) / (2 * n) as p1 from p)
select (select count(*) from two) as records, round((select avg(case when len(list_distinct(a || b)) = 0 then 1 else len(list_intersect(a, b)) / len(list_distinct(a || b)) end) from two), 6) as mean_jaccard, round(mk, 6) as macro_kappa,
round(2 * n11 / (2 * n11 + n10 + n01), 6) as positive_agreement, round(1 - ((n10 + n01) / n) / (2 * p1 * (1 - p1)), 6) as alpha from q, kk""",
    "macro_pr": f"""with {SETS}, u as (select distinct family as l from fact where flag in ('R', 'A')), c as (select l, sum((list_contains(a, l) and list_contains(b, l))::int) as t, sum(list_contains(a, l)::int) as p, sum(list_contains(b, l)::int) as g from two, u group by 1)
select count(*) as labels, round(avg(case when p = 0 then 0 else t / p end), 6) as precision, round(avg(case when g = 0 then 0 else t / g end), 6) as recall from c""",
    "audit_precision": f"""with {SETS}, f as (select a, list_filter(list_distinct(a || b[2:3]), lambda x: not list_contains(b[1:1], x)) as f from two), s as (select sum(len(list_intersect(a, f)))::bigint as hits, sum(len(a))::bigint as predicted, sum(len(f))::bigint as final from f),
w as (select *, hits / predicted as p, hits / final as r, 1.96 * 1.96 as zz from s)
select hits, predicted, final, round(p, 6) as precision, round(r, 6) as recall,
round((p + zz / (2 * predicted) - 1.96 * sqrt(p * (1 - p) / predicted + zz / (4 * predicted * predicted))) / (1 + zz / predicted), 6) as precision_low, round((p + zz / (2 * predicted) + 1.96 * sqrt(p * (1 - p) / predicted + zz / (4 * predicted * predicted))) / (1 + zz / predicted), 6) as precision_high,
round((r + zz / (2 * final) - 1.96 * sqrt(r * (1 - r) / final + zz / (4 * final * final))) / (1 + zz / final), 6) as recall_low, round((r + zz / (2 * final) + 1.96 * sqrt(r * (1 - r) / final + zz / (4 * final * final))) / (1 + zz / final), 6) as recall_high from w""",
    "final_labels": f"""with {SETS}, p as (select id, a, b[1:1] as r, b[1:2] as d from two), k as (select *, list_filter(a, lambda x: not list_contains(r, x)) as kept from p)
select id, array_to_string(list_sort(kept || list_filter(d, lambda x: not list_contains(kept, x))), ',') as ordered, array_to_string(list_sort(list_distinct(kept || d)), ',') as as_set, array_to_string(list_sort(list_filter(list_distinct(a || d), lambda x: not list_contains(r, x))), ',') as strict from k""",
    "kappa_alpha": f"""with c as (select sum((quality = 1 and toxic = 1)::int)::bigint as n11, sum((quality = 1 and toxic = 0)::int)::bigint as n10, sum((quality = 0 and toxic = 1)::int)::bigint as n01, sum((quality = 0 and toxic = 0)::int)::bigint as n00 from labels),
k as (select *, n11 + n10 + n01 + n00 as n from c), e as (select *, (n11 + n00) / n as po, ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n * n) as pe from k) select n11, n10, n01, n00, round((po - pe) / (1 - pe), 6) as kappa from e""",
    "why_family_lift": """with e as (select event_type as why, json_extract_string(props, '$.k') as what from events), n as (select count(*) as n from e), y as (select why, count(*) as why_count from e where why is not null group by 1 having count(*) >= 5), x as (select what, count(*) as what_count from e where what is not null group by 1),
b as (select why, what, count(*) as both_ from e group by 1, 2) select why, what, why_count, what_count, coalesce(both_, 0) as "both", round(coalesce(both_, 0) / why_count / (what_count / n), 6) as lift from y cross join x left join b using (why, what), n""",
    "expression_share": "with e as (select event_type as x from events union all select json_extract_string(props, '$.k') from events union all select event_type from events) select x as expression, count(*) as k, round(count(*) / (select count(*) from events), 6) as share from e group by 1",
    "wilson_bounds": """with g as (select source, sum(quality)::bigint as k, count(*) as n from labels join documents using (doc_id) group by 1), p as (select *, k / n as p, 1.96 * 1.96 as zz from g)
select source, k, n, round((p + zz / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 6) as low, round((p + zz / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 6) as high from p""",
    "cochran_size": "with g as (select coalesce(source, '(all)') as source, count(*) as n from documents group by rollup (source)), z as (select *, 1.96 * 1.96 * 0.5 * 0.5 / (0.05 * 0.05) as n0 from g) select source, n, least(ceil(n0 * n / (n0 + n - 1)), n)::bigint as size from z",
    "random_sample": "select doc_id, source from documents order by md5('1104:' || doc_id), doc_id limit 100",
    "audit_population": "with s as (select doc_id from documents order by md5('1104:' || doc_id), doc_id limit 100), p as (select doc_id, 0 as p from s union all select doc_id, 1 from labels where toxic = 1) select doc_id, case when min(p) = 0 then 'sample' else 'low-confidence' end as \"set\" from p group by 1",
    "batch_claim": "with s as (select doc_id from documents order by md5('1104:' || doc_id), doc_id limit 100) select doc_id from documents where doc_id not in (from s) and doc_id not in (select doc_id from labels) order by doc_id limit 50",
    "active_entities": "select user_id from events group by 1 having max(ts) > min(ts) + interval 5 minutes",
    "shared_keys_drop": "with e as (select event_type as scope, user_id as owner, round(value, 1) as item from events), s as (select scope, item from e group by 1, 2 having count(distinct owner) >= 2) select scope, count(*) as n, count(distinct owner) as owners from e where not exists (select 1 from s where s.scope = e.scope and s.item = e.item) group by 1",
    "first_wins_dedup": "select md5(text) as h, min(doc_id) as doc_id from documents group by 1",
    "subset_dedup": f"""with {FACT}, s as (select id, upstream, list_sort(list_distinct(list(skill))) as s, any_value(o_orderstatus) = 'O' as d from fact join orders on o_orderkey = id group by 1, 2)
select id, upstream from s a where not exists (select 1 from s b where b.upstream = a.upstream and b.id <> a.id and list_has_all(b.s, a.s) and (len(b.s) > len(a.s) or (b.d and not a.d) or (b.d = a.d and b.id < a.id)))""",
    "subset_dedup_hot": """with s as (select l_orderkey as id, c_nationkey as nation, list_distinct(list('p' || l_partkey % 400)) as s, any_value(o_orderstatus) = 'O' as d from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey group by 1, 2),
i as (select id, nation, unnest(s) as x from s), n as (select id, nation, d, len(s) as n from s),
h as (select a.id, b.id as other, count(*) as k from i a join i b on a.nation = b.nation and a.x = b.x and a.id <> b.id group by 1, 2),
g as (select h.id from h join n a on a.id = h.id join n b on b.id = h.other where k = a.n and (b.n > a.n or (b.d and not a.d) or (b.d = a.d and b.id < a.id)))
select id, nation from n where id not in (select id from g)""",
    "resume_anti_join": "select source, count(*) as n from documents where doc_id not in (select doc_id from labels) group by 1",
    "consensus_override": f"with {SETS}, o as (select id, case when id % 3 = 0 then b else a end as l from two) select id, array_to_string(l, ',') as labels from o where len(l) > 0",
    "joined_inputs": "select quality::bigint as quality, count(*) as n, sum(n_chars)::bigint as chars, (select count(*) from documents where doc_id not in (select doc_id from labels)) as without from labels join documents using (doc_id) group by 1",
    "upsert_merge": "with new as (select c_custkey * 3 as c_custkey, 'new ' || c_name as c_name, true as seen from customer where c_custkey % 2 = 0) select coalesce(n.c_custkey, o.c_custkey) as c_custkey, coalesce(n.c_name, o.c_name) as c_name, o.c_acctbal, n.seen from customer o full join new n on o.c_custkey = n.c_custkey",
    "message_noise": f"""with c as (select case when turn = 0 then case conv_id % 11 {' '.join(f"when {i} then '{k}'" for i, k in enumerate(['merge_pr', 'merge_branch', 'merge_other', 'revert', 'release_note', 'release_note', 'initial_commit', 'update_readme', 'create_using', 'squashed', 'empty']))} end
when trim(text, ' ' || chr(10) || chr(9)) = '' then 'empty' else '(none)' end as class from conversations) select class, count(*) as n from c group by 1""",
    "maintenance_class": maintenance(),
    "footer_trim": f"""with t as (select doc_id, '  ' || text || chr(10) || chr(10) || chr(10) || chr(10) || 'Signed-off-by: A <a@b>' || chr(10) || 'Fixes: 12' || chr(10) || 'more' || chr(10) || chr(10) || 'co-authored-by: B' || chr(10) || ' ' || chr(10) as m from documents)
select doc_id, md5(trim(regexp_replace(regexp_replace(m, '(?im)^(?:{X.FOOTERS}):.*$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) as h from t""",
    "redact_text": f"with t as (select doc_id, text, text || ' ghp_abcdefghijklmnopqrstuvwx sk-ABCDEFGHIJKLMNOPQRSTUV Password: hunter2, /home/ann/x /Users/bo/y C:\\Users\\Cy\\z' as m from documents) select doc_id, md5({redacted('m')}) as h, strpos({redacted('text')}, '<REDACTED>') > 0 as had_secret from t",
    "redact_snippet": "with t as (select doc_id, regexp_extract(text, '[A-Za-z]+', 0) as w from documents) select doc_id, case when w = '' then 'api_key = \"\" color = ''''; my-token=; {\"password\": \"\"} Bearer ' else 'api_key=\"<redacted>\" color = ''' || w || '''; my-token=<redacted>; {\"password\": \"<redacted>\"} Bearer <redacted>' end as line from t",
    "pseudonym_digest": f"select c_custkey, 'customer-' || substr(sha256('{A.SALT}:customer:' || c_name), 1, 12) as pseudonym from customer",
    "pseudonym_uuid5": f"with t as (select c_custkey, c_name, c_mktsegment || '::' || c_name || '::main' as v from customer) select c_custkey, {uuid5('v')} as id, c_name as kept from t",
    "label_parsing": "select n_nationkey, 'a|' || n_name || '|b' as labels, replace(n_name, '/', '-') || '--a-b-c--x' as stem from nation",
    "csv_decimals": "select c_custkey, printf('%.4f', c_acctbal / 64) as x from customer",
    "security_matches": f"{BY_DOC} select * from d",
    "security_summary": f"{BY_DOC} select count(*) as instances, sum(flagged::int)::bigint as flagged, sum((severity = 'CRITICAL')::int)::bigint as critical, sum((severity = 'WARNING')::int)::bigint as warning, sum(matches)::bigint as matches, round(sum(flagged::int) / count(*), 6) as prevalence from d",
    "security_by_rule": by("rule, category, severity"),
    "security_by_category": by("category"),
    "diff_lines": f"with {DIFF} select role, file_status, count(*) as lines, sum(line)::bigint as line_numbers, max(block)::bigint as last_block from dl group by 1, 2",
    "diff_matches_origin": f"with {DIFF}, {matched('dl')}, f as (select category, id, {FLAGS} from m group by 1, 2) select category, sum(a)::bigint as added, sum(c)::bigint as context, sum(a * c)::bigint as \"both\", sum(a * (1 - c))::bigint as added_only, sum((1 - a) * c)::bigint as context_only from f group by 1",
    "diff_line_edits": f"with {DIFF}, {matched('dl')}, f as (select id, max((role = 'added')::int) as a from m where file_status <> 'removed' and role in ('added', 'removed') group by 1) select case a when 1 then 'added' else 'deleted' end as edit, count(*) as instances from f group by 1",
    "diff_hunks": f"""with {DIFF}, {matched('dl')}, s as (select id, block, max((role = 'added')::int) as a, max((role = 'removed')::int) as r from dl group by 1, 2), h as (select id, block, sum((role = 'added')::int) as added, sum((role = 'removed')::int) as removed, sum((role = 'context')::int) as context from m group by 1, 2)
select case when a = 1 and r = 1 then 'modified' when a = 1 then 'added' when r = 1 then 'removed' else 'context' end as hunk_status, removed > 0 and added = 0 as deleted_only, count(*) as hunks, sum(added)::bigint as added, sum(removed)::bigint as removed, sum(context)::bigint as context from h join s using (id, block) group by 1, 2""",
    "diff_removed_alone": f"with {DIFF}, {matched('dl')} select rule, count(*) as n from m where role = 'removed' and not exists (select 1 from m o where o.id = m.id and o.block = m.block and o.role = 'added') group by 1",
    "diff_file_statuses": f"with {DIFF}, {matched('dl')} select file_status, count(distinct id) as instances from m where file_status <> 'removed' group by 1",
    "document_headings": f"with {lines()}, f as (select *, line % 11 = 5 and line % 7 <> 3 as fence from line), g as (select *, sum(fence::int) over (partition by id order by line) % 2 = 1 as inside from f), h as (select id, line from g where line % 7 = 3 and not inside and trim(content) <> '') select doc_id as id, count(h.id) as n, coalesce(sum(line + 1), 0)::bigint as lines from documents left join h on h.id = doc_id group by 1",
    "longest_prefix_owner": """with p as (select page_id, regexp_extract(url, '://([^?#]*)', 1) as path from pages), d as (select distinct regexp_extract(path, '^[^/]+', 0) as dir from p where page_id % 2 = 0 union select distinct regexp_extract(path, '^[^/]+/[^/]+', 0) from p where page_id % 4 = 0)
select page_id, arg_max(dir, length(dir)) as owner from p left join d on path = dir or starts_with(path, dir || '/') group by 1""",
    "path_surface": """with s as (select case page_id % 10 when 0 then 'SKILL.md' when 1 then 'scripts' when 2 then 'references' when 3 then 'assets' when 4 then 'configuration' when 5 then 'examples' when 6 then 'assets' when 7 then 'agents/' when 8 then 'additional files' else 'additional directories' end as s, page_id,
regexp_extract(regexp_extract(url, '://([^?#]*)', 1), '[^/]+$', 0) as leaf from pages) select case when leaf = '' and page_id % 10 in (1, 2, 7, 9, 3) then case page_id % 10 when 3 then 'assets' when 2 then 'additional directories' else 'additional files' end else s end as surface, count(*) as n from s group by 1""",
    "funnel_counts": "with u as (select min(doc_id) as doc_id from documents group by text) select 0::bigint as no, 'read' as step, 'documents' as unit, count(*) as count from documents union all select 1, 'unique', 'documents', count(*) from u union all select 2, 'labelled', 'documents', count(*) from u join labels using (doc_id) union all select 3, 'good', 'documents', count(*) from u join labels using (doc_id) where quality = 1",
    "turn_window_rank": "select conv_id, turn, row_number() over (partition by conv_id order by length(text) desc, turn) as rank, sum((role = 'assistant')::int) over (partition by conv_id order by turn rows unbounded preceding)::bigint as answers from conversations",
    "taxonomy_check": """with t as (select distinct 'size ' || (p_size % 7) as family, p_size % 14 as no, concat_ws(' ', p_brand, p_type) as pattern from part)
select 'family' as kind, family as name, count(distinct no) as n from t group by 2 having count(distinct no) > 1 union all select 'pattern', pattern, count(*) from t group by 2 having count(*) > 1""",
    "verdict_states": "select quality is not null as audited, case when quality is null then null when quality = 0 then 'wrong' else 'correct' end as verdict, count(*) as n from documents left join labels using (doc_id) group by 1, 2",
    "cochran_draw": "with n as (select count(*) as n, 1.96 * 1.96 * 0.5 * 0.5 / (0.05 * 0.05) as n0 from documents), r as (select doc_id, row_number() over (order by md5('1104:' || doc_id), doc_id) as k from documents) select doc_id from r, n where k <= least(ceil(n0 * n / (n0 + n - 1)), n)",
    "label_jaccard": f"with {SETS} select id, round(case when len(list_distinct(a || b)) = 0 then 1 else len(list_intersect(a, b)) / len(list_distinct(a || b)) end, 6) as jaccard, list_has_all(a, b) as holds from two",
    "stratified_quotas": f"with {QUOTAS} select lang, quota from q",
    "stratified_sample": f"with {QUOTAS}, d as (select doc_id, lang, row_number() over (partition by lang order by md5('1104:' || doc_id), doc_id) as k from documents) select doc_id, d.lang, 'repo:' || d.lang as sample_stratum from d join q on q.lang is not distinct from d.lang where k <= quota",
    "diff_origin_total": f"with {DIFF}, {matched('dl')}, f as (select id, {FLAGS} from m group by 1) select coalesce(sum(a), 0)::bigint as added, coalesce(sum(c), 0)::bigint as context, coalesce(sum(a * c), 0)::bigint as \"both\", coalesce(sum(a * (1 - c)), 0)::bigint as added_only, coalesce(sum((1 - a) * c), 0)::bigint as context_only from f",
    "diff_origin_by_rule": f"with {DIFF}, {matched('dl')}, f as (select rule, id, {FLAGS} from m group by 1, 2) select rule, sum(a)::bigint as added, sum(c)::bigint as context, sum(a * c)::bigint as \"both\", sum(a * (1 - c))::bigint as added_only, sum((1 - a) * c)::bigint as context_only from f group by 1",
    "diff_added_by_rule": f"with {DIFF}, {matched('dl')}, a as (select * from m where role = 'added') select rule, count(distinct id) as instances, round(count(distinct id) / (select count(*) from documents), 6) as prevalence, count(*) as matches, round(count(*) / (select count(*) from a), 6) as match_share from a group by 1",
    "diff_deleted_only": f"with {DIFF}, {matched('dl')} select id, count(*) as matches from m group by 1 having count(*) = count(*) filter (role = 'removed')",
    "popular_repos": "select c_custkey from customer where c_custkey * 3701 % 40000 >= 20000 and c_custkey * 1301 % 4000 >= 2000 and c_nationkey > 2 and c_nationkey % 3 > 0",
    "keyword_union": "select c_custkey, case when c_nationkey < 10 then 'nation' else 'segment' end as search from customer where c_nationkey < 10 or c_mktsegment = 'BUILDING'",
    "forks_of_upstream": "select o_orderkey as row_no, o_orderpriority as upstream from orders where o_orderpriority = '1-URGENT' order by o_orderkey limit 50",
    "files_in_scope": f"with {CHANGES}, f as (select page_id, concat_ws(',', case when up < 4 and k1 < 4 and s = 0 then 'skills/' || k1 || '/SKILL.md' end, case when up < 4 and k2 < 4 then 'skills/' || k2 || '/deep/a.py' end) as files from c where page_id % 11 <> 0) select page_id as row_no, files from f where files <> ''",
    "new_packages": f"""with {CHANGES}, f as (select up = 4 and s = 1 or k1 >= 4 and s = 1 as a, up < 4 and (k1 < 4 or k2 < 4) as m from c), t as (select count(*) as total, sum(m::int) as m, sum(a::int) as a, sum((a and m)::int) as am, sum((a and not m)::int) as only_a from f),
l as (select total, unnest(['modifies_existing', 'adds_new', 'modifies_existing_and_adds_new', 'adds_new_only']) as category, unnest([m, a, am, only_a])::bigint as count from t) select category, count, round(count / total, 6) as share_of_total, total as denominator from l""",
    "predictions_with_truth": "select doc_id, case when toxic = 1 then case when quality = 1 then 'good,toxic' else 'bad,toxic,good' end else case when quality = 1 then 'good,x' else 'bad,x' end end as pred, lang as truth from labels join documents using (doc_id)",
    "audit_tasks": "select doc_id, case when toxic = 1 then 'low-confidence' else 'sample' end as \"set\", row_number() over (order by case when toxic = 1 then 0 else 1 end, doc_id) as task from labels join documents using (doc_id)",
    "low_confidence": "select doc_id, doc_id % 4 > 0 and (quality <> 1 or toxic <> 0) as low from labels",
    "instance_identity": "select c_custkey, c_mktsegment as upstream, case when c_custkey % 3 > 0 then c_name else '' end as owner, case when c_custkey % 3 > 1 then 'main' else '' end as branch from customer",
    "patch_text": "select doc_id, md5('diff --git ' || case when doc_id % 2 = 0 then 'a.md' else 'b.md' end || ' b.md  [renamed +' || doc_id || '/-0]' || chr(10) || case when text = '' then '' else text || chr(10) end || 'diff --git c.md c.md  [ +1/-2]') as h from documents",
}
