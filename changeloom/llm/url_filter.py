"""URL filter: path rules, then logistic regression on hashed character n-grams of host and path (operator 7).

Everything over the table is one projection of SQL functions, without a shuffle: the n-grams of a URL are hashed into
``BUCKETS`` buckets, and the weights of the buckets, a literal array, are added up. The weights are trained on the driver
by batch gradient descent from ``LABELLED``, a table of a few dozen URLs, so the model is the same wherever it is made.

Host and path are empty where the URL is null or has no ``://``; then no rule fits and the model's bias decides. URLs of any length are judged whole; of rules of equal length that fit, the first one wins. Repeated
rows are judged each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (rule, verdict); a rule is a host and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Buckets (three hexadecimal digits of an MD5), sizes of n-grams, passes, step and ridge of the training.
BUCKETS, SIZES, PASSES, STEP, RIDGE = 4096, (3, 4), 200, 1.0, 0.002
#: The labelled URLs: made-up hosts and paths to block, and to allow.
BLOCKED = """adult-zone.test/en/1 adult-tube.test/video/2 www.adult-cam.test/free free-porn.test/hd/3 xxx-videos.test/fr/4.html
sexy-chat.test/room/5 hot-xxx.test/es/6 spam-fields.test/en/7 spam-farm.test/?page=2 link-spam.test/seo/8 seo-farm.test/9
content-farm.test/top10 casino-royal.test/bonus/10 online-casino.test/slots poker-win.test/bet/11 bet-now.test/odds lucky-slots.test/jackpot
cheap-pills.test/viagra/12 viagra-shop.test/buy pharma-deal.test/cialis replica-watch.test/sale/13 free-money.test/win/14 win-prize.test/claim
malware-drop.test/setup.exe phish-login.test/verify/15 secure-login-verify.test/account crack-keygen.test/download/16 warez-zone.test/torrent/17
torrent-free.test/movie/18 click-bait.test/shock/19 ad-track.test/redirect/20 payday-loan.test/apply/21 escort-city.test/girls/22 nude-pics.test/gallery""".split()
ALLOWED = """www.river.test/en/1 blog.quarry.test/post/2 m.valley.test/fr/3.html docs.timber.test/guide/4 wiki.pebble.test/page/5 news.summit.test/es/6
library.test/catalog/7 university.test/course/8 www.meadow.test/de/9 blog.harbour.test/en/10/ m.lantern.test/en/11#top
orchard.test/en/12?page=2 willow.test/es/13 www.granite.test/14.html blog.copper.test/en/15 m.saffron.test/fr/16
city-council.test/minutes/17 museum.test/collection/18 weather.test/forecast/19 recipes.test/soup/20 garden-club.test/roses/21 school.test/pupils
research-lab.test/paper/22 open-data.test/tables/23 history.test/articles/24 travel.test/routes/25 forum.cedar.test/thread/26 help.maple.test/faq
journal.test/volume/27 music-school.test/lessons/28 maps.test/city/29 cinema.test/program/30 hospital.test/contact/31 bakery.test/bread/32""".split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def grams(host: str, path: str) -> list[str]:
    """The n-grams of both, marked by origin; the ends of each are marked too."""
    out = []
    for mark, text in (("h", host), ("p", path)):
        full = f"^{text}$"
        out += [mark + full[i : i + n] for n in SIZES for i in range(len(full) - n + 1)]
    return out


def bucket(gram: str) -> int:
    """The bucket of an n-gram."""
    return int(hashlib.md5(gram.encode()).hexdigest()[:3], 16)


@lru_cache(maxsize=1)
def weights() -> tuple[tuple[float, ...], float]:
    """Weights of the buckets and the bias, trained on the labelled URLs."""
    rows = []
    for label, urls in ((1, BLOCKED), (0, ALLOWED)):
        for url in urls:
            host, slash, path = url.split("?")[0].split("#")[0].partition("/")
            found = [bucket(g) for g in grams(host, slash + path)]
            rows.append((label, found, 1 / math.sqrt(len(found))))
    w, bias = [0.0] * BUCKETS, 0.0
    for _ in range(PASSES):
        change, shift = {}, 0.0
        for label, found, unit in rows:
            p = 1 / (1 + math.exp(-(bias + unit * sum(w[b] for b in found))))
            shift += p - label
            for b in found:
                change[b] = change.get(b, 0.0) + unit * (p - label)
        bias -= STEP * shift / len(rows)
        w = [x * (1 - RIDGE) for x in w]
        for b, g in change.items():
            w[b] -= STEP * g / math.sqrt(len(rows))
    return tuple(round(x, 6) for x in w), round(bias, 6)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page; ``score`` is the model's log odds for blocking."""
    w, bias = weights()
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END")
    host = F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), UPPER, LOWER)
    cut = pages.select("page_id", rest.alias("rest")).select("page_id", host.alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))

    fits = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        of, slash, start = rule.partition("/")
        there = ((F.col("host") == of) | F.col("host").endswith("." + of)) & F.col("path").startswith(slash + start)
        fits.append((there, rule, verdict))
    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for there, name, verdict in reversed(fits):
        rule, by_rule = F.when(there, name).otherwise(rule), F.when(there, verdict).otherwise(by_rule)

    parts = []
    for mark, column in (("h", "host"), ("p", "path")):
        for n in SIZES:
            joined = ", ".join(f"c[i + {k}]" for k in range(n))
            chars = f"split(concat('^', {column}, '$'), '')"
            parts.append(f"CASE WHEN char_length({column}) >= {n - 2} THEN transform(array({chars}), c -> transform(sequence(0, size(c) - {n}), i -> concat('{mark}', {joined})))[0] ELSE array() END")
    array = f"array({', '.join(f'{x!r}D' for x in w)})"
    added = f"aggregate(g, CAST(0 AS DOUBLE), (a, x) -> a + element_at({array}, CAST(conv(substr(md5(x), 1, 3), 16, 10) AS INT) + 1))"
    scored = cut.withColumn("g", F.expr(f"concat({', '.join(parts)})"))
    score = F.expr(f"CASE WHEN size(g) = 0 THEN {bias!r}D ELSE {bias!r}D + {added} / sqrt(size(g)) END")
    scored = scored.select("page_id", "host", "path", rule.alias("rule"), by_rule.alias("by_rule"), score.alias("score"))
    verdict = F.coalesce("by_rule", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("score", 4).alias("score"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle() -> str:
    """DuckDB SQL for the query."""
    w, bias = weights()
    whens = sorted(RULES, key=lambda r: -len(r[0]))
    test = lambda r: f"(host = '{r.split('/')[0]}' or ends_with(host, '.{r.split('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}')"
    case = lambda k: "case " + " ".join(f"when {test(r[0])} then '{r[k]}'" for r in whens) + " end"
    part = lambda mark, c, n: f"list_transform(range(1, greatest(length({c}) + 4 - {n}, 1)), lambda i: '{mark}' || substr('^' || {c} || '$', i, {n}))"
    lists = ", ".join(part(m, c, n) for m, c in (("h", "host"), ("p", "path")) for n in SIZES)
    return f"""
with r as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
c as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
g as (select *, {case(0)} as rule, {case(1)} as by_rule, flatten([{lists}]) as g from c),
w as (select unnest(range(1, {BUCKETS + 1})) as k, unnest([{", ".join(map(repr, w))}]) as v),
x as (select page_id, host, path, rule, by_rule, len(g) as n, unnest(case when len(g) = 0 then [null] else g end) as gram, generate_subscripts(case when len(g) = 0 then [null] else g end, 1) as i from g),
s as (select x.*, w.v from x left join w on w.k = ('0x' || substr(md5(gram), 1, 3))::int + 1),
t as (select page_id, host, path, rule, by_rule, case when any_value(n) = 0 then {bias!r} else {bias!r} + sum(v order by i) / sqrt(any_value(n)) end as score from s group by all)
select page_id, host, path, rule, coalesce(by_rule, case when score > 0 then 'block' else 'allow' end) as verdict, round(score, 4) as score from t
"""
