"""Secret scan: three fixed patterns, and candidates that a character Markov model calls random (operator 12).

Everything over the table is one projection of SQL functions, without a shuffle. Spans of a pattern come from two passes of
the same regular expression over the whole text, one that gives the matches and one that gives what lies between them; their
lengths, added up (``arrays.prefix_sums``), are the places. Passes run only where a cheap test says that a match may be there.

A candidate of the model is a run of at least ``LEAST`` characters of ``ALPHABET``, ``VARIETY`` different ones among them. Two first-order Markov models, of random
strings and of ordinary identifiers, words and numbers, give every first character and every pair of characters a log-likelihood
ratio, in thousandths, as whole numbers, so sums don't depend on their order. A candidate whose ratios add up to ``BOUND`` is
a span of kind ``random``. The models are trained on the driver from ``labelled()``, samples made by rules from a list of words,
from repeated characters and from digests, so they are the same wherever they are made. The model adds spans; those of the patterns stay, even where
both meet.

Null text counts as empty; an empty text has no span; texts of any length are scanned whole, at a cost in proportion to their
length; repeated rows are scanned each; ids may be null; other columns are ignored, whatever their names; an empty table gives an
empty result. Where several kinds begin at one place they come in the order of ``KINDS``.
"""

from __future__ import annotations

import base64
import hashlib
import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import prefix_sums
from ..functions.text import bound

# Fixed values of the contract: patterns, and the least length of a match, or of its second group.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
#: Characters of the model's candidates, and the least numbers of them and of different ones.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST, VARIETY = 20, 8
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Kinds of spans in the order in which they are listed.
KINDS = ("assign", "access", "hex", "random")
#: Sum of log-likelihood ratios, in thousandths, from which a candidate is a secret; and the weight of unseen pairs.
BOUND, SMOOTH = 12_000, 0.25
#: Words that ordinary identifiers and paths are made of.
WORDS = """get set user account name value list index count total order item price customer request response handler manager service client server
session context config option default parser token reader writer stream buffer file path folder report table column row query result error
message event listener callback render view model controller test expected actual number string array length width height color style
information development organisation international administration understanding responsibility transformation communication environment
verantwortung entwicklung gesellschaft wissenschaft versicherung bundesregierung zusammenarbeit einrichtungen geschwindigkeit unterscheidung
gouvernement développement administration renseignement établissement fonctionnement enseignement particulièrement
desarrollo información administración responsabilidad establecimiento internacional funcionamiento""".split()


def _digest(*key: object) -> bytes:
    return hashlib.sha256(":".join(map(str, key)).encode()).digest()


def labelled(split: str = "train", n: int = 10 * len(ALPHABET)) -> list[tuple[str, int]]:
    """Labelled samples, n of each label: random strings (1) as keys are written, ordinary ones (0) of words and numbers."""
    out = []
    for i in range(n):
        d = _digest(split, "random", i) + _digest(split, "more", i)
        size = LEAST + d[0] % 24
        big = int.from_bytes(d, "big")
        letters = lambda a: "".join(a[(big >> 6 * k) % len(a)] for k in range(size))  # noqa: B023, E731
        out.append(((d.hex()[:size], base64.b64encode(d).decode()[:size], base64.urlsafe_b64encode(d).decode()[:size], letters(ALPHABET[:62]), letters(ALPHABET[26:62]))[i % 5], 1))
    for i in range(n):
        d = _digest(split, "ordinary", i)
        plain = lambda k: "".join(c for c in WORDS[d[k] * 7 % len(WORDS)] if c in ALPHABET)  # noqa: B023, E731
        words = [plain(k) for k in range(3 + d[30] % 3)]
        number = str(int.from_bytes(d[8:20], "big"))
        if i % 20 == 7:  # a date or a range of numbers
            number = "-/"[i // 20 % 2].join((number[:4], number[4:6], number[6:8], number[8:12], number[12:14], number[14:20]))
        made = ("_".join(words), "".join(w.capitalize() for w in words), words[0] + "".join(w.capitalize() for w in words[1:]), "-".join(words), "_".join(words).upper(), "/".join(words), "".join(words), number[:26], f"{words[0]}/{words[1]}/{words[2]}-v{d[20] % 10}", ALPHABET[i // 10 % len(ALPHABET)] * (20 + d[22] % 40))[i % 10]
        out.append((made + "".join(words) * (len(made) < LEAST), 0))
    return out


@lru_cache(maxsize=1)
def ratios() -> tuple[int, ...]:
    """Log-likelihood ratios in thousandths: one for each first character, then one for each pair, in the alphabet's order."""
    n, counts = len(ALPHABET), {}
    place = {c: k for k, c in enumerate(ALPHABET)}
    for label in (0, 1):
        first, pairs = [SMOOTH] * n, [[SMOOTH] * n for _ in range(n)]
        for text, what in labelled():
            if what == label:
                first[place[text[0]]] += 1
                for a, b in zip(text, text[1:], strict=False):
                    pairs[place[a]][place[b]] += 1
        counts[label] = [first, *pairs]
    share = lambda label, row, k: counts[label][row][k] / sum(counts[label][row])
    return tuple(round(1000 * math.log(share(1, row, k) / share(0, row, k))) for row in range(n + 1) for k in range(n))


def ratio(text: str) -> int:
    """The sum of a string's ratios, as the query makes it."""
    w, place = ratios(), [ALPHABET.index(c) for c in text]
    return w[place[0]] + sum(w[(a + 1) * len(ALPHABET) + b] for a, b in zip(place, place[1:], strict=False))


def _places(text: Column, pattern: str) -> Column:
    """(text, start) of every match, in order, in code points."""

    def both(found: Column, between: Column) -> Column:
        steps = F.transform(found, lambda m, i: (F.char_length(m) + F.char_length(between[i + 1])).cast("long"))
        placed = lambda before: F.transform(found, lambda m, i: F.struct(m.alias("text"), (before[i] + F.char_length(between[0])).alias("start")))
        return bound(prefix_sums(steps), placed)

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: bound(F.split(text, pattern, -1), lambda s: both(f, s)))


def _random(candidate: Column) -> Column:
    """Whether the model calls a candidate random."""
    n, w = len(ALPHABET), F.array(*map(F.lit, ratios()))
    place = lambda c: F.instr(F.lit(ALPHABET), c)

    def total(k: Column) -> Column:
        step = lambda a, i: a + w[k[i - 1] * n + k[i] - 1].cast("long")
        return F.aggregate(F.sequence(F.lit(1), F.size(k) - 1), w[k[0] - 1].cast("long"), step)

    return bound(F.transform(F.split(candidate, ""), place), lambda k: F.when(F.size(F.array_distinct(k)) >= VARIETY, total(k) >= BOUND).otherwise(False))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``, all spans of the document: an array of (start, kind, end), kind as a place in ``KINDS``, ordered."""
    text = F.coalesce("text", F.lit(""))
    gates = (
        (text.contains("=") | text.contains(":")) & text.rlike(ASSIGN),
        text.contains("AKIA"),
        text.rlike(HEX),
        text.rlike(CANDIDATE),
    )
    keep = (
        lambda m: F.char_length(F.regexp_extract(m["text"], ASSIGN, 2)) >= 12,
        lambda m: F.lit(True),
        lambda m: F.lit(True),
        lambda m: _random(m["text"]),
    )
    parts = []
    for kind, (gate, pattern, ok) in enumerate(zip(gates, (ASSIGN, ACCESS, HEX, CANDIDATE), keep, strict=True)):
        span = lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.char_length(m["text"])).alias("end"))  # noqa: B023, E731
        spans = F.transform(F.filter(_places(text, pattern), ok), span)
        parts.append(F.when(gate, spans).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    return docs.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def listed(found: Column) -> Column:
    """Spans as text, ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the fixed patterns, the digest of their spans, and all spans of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = listed(F.filter("found", lambda s: s["kind"] < 3))
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def oracle() -> str:
    """DuckDB SQL for the query."""
    n = len(ALPHABET)
    quoted = [p.replace("'", "''") for p in (ASSIGN, ACCESS, HEX, CANDIDATE)]
    each = " union all ".join(f"select doc_id, row_no, {k} as kind, regexp_extract_all(text, '{p}') as m, regexp_split_to_array(text, '{p}') as b from d where regexp_matches(text, '{p}')" for k, p in enumerate(quoted))
    w = ", ".join(map(str, ratios()))
    return f"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as row_no from documents),
f as ({each}),
x as (select row_no, kind, unnest(m) as t, generate_subscripts(m, 1) as i, b from f),
y as (select row_no, kind, i, t, len(t) as n, len(b[i]) as before from x),
p as (select *, sum(before + n) over (partition by row_no, kind order by i) - n as s from y),
w as (select unnest(range(1, {n * (n + 1) + 1})) as k, unnest([{w}]) as v),
c as (select row_no, i, t, unnest(range(1, n + 1)) as j from p where kind = 3 and len(list_distinct(string_split(t, ''))) >= {VARIETY}),
r as (select row_no, i from (select row_no, i, case when j = 1 then strpos('{ALPHABET}', t[1]) else strpos('{ALPHABET}', t[j - 1]) * {n} + strpos('{ALPHABET}', t[j]) end as k from c) join w using (k) group by all having sum(v) >= {BOUND}),
k as (select row_no, kind, s::bigint as s, (s + n)::bigint as e from p left join r using (row_no, i) where case kind when 0 then len(regexp_extract(t, '{quoted[0]}', 2)) >= 12 when 3 then r.row_no is not null else true end),
l as (select *, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || s || ':' || e as said from k),
g as (select row_no, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as b, count(*) filter (kind = 2) as h,
  string_agg(said, ',' order by s, kind) filter (kind < 3) as base, string_agg(said, ',' order by s, kind) as spans from l group by row_no)
select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (row_no)"""
