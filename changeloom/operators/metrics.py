"""Prevalence, co-occurrence, agreement and interval measures over instances with sets of labels.

An instance is a row (id, upstream, categories array, skills array). Shares have a zero where their denominator is zero,
unless a function says otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bound
from ..sources.tables import written
from .numbering import running


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0 or missing."""
    return F.when(F.coalesce(b, F.lit(0)) != 0, a / b).otherwise(F.lit(0.0))


def weighted(instances: DataFrame) -> DataFrame:
    """Instances with ``w``, one over the root of the number of instances of their upstream.

    Sizes are counted with partial aggregation and joined back, so a large upstream isn't gathered in a window; null is an upstream too.
    """
    sizes = instances.groupBy("upstream").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumnRenamed("upstream", "_u")
    return instances.join(sizes, F.col("upstream").eqNullSafe(F.col("_u"))).withColumn("w", 1 / F.sqrt("size")).drop("size", "_u")


#: Names of a vocabulary that may go into an expression.
MOST_NAMES = 10_000


def vocabulary(values: DataFrame) -> list:
    """The distinct values of the only column, in order; raises if they are too many for a vocabulary. Null isn't one of them."""
    c = F.col(values.columns[0])
    found = [r[0] for r in values.select(c.alias("v")).where("v is not null").distinct().limit(MOST_NAMES + 1).collect()]
    if len(found) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} distinct categories")
    return sorted(found)


def _few(counts: DataFrame, what: str) -> DataFrame:
    """Counts of a vocabulary, written, with a broadcast hint; raises if they are too many for one."""
    out = written(counts, "vocabulary")
    if out.count() > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} distinct {what}")
    return F.broadcast(out)


def _coded(instances: DataFrame) -> tuple[DataFrame, list]:
    """(upstream, skills, ids): instances with categories as ascending places in the vocabulary, from 1; written. And the vocabulary."""
    rows = written(instances.select("upstream", F.array_distinct("skills").alias("skills"), "categories"), "instances")
    names = vocabulary(rows.select(F.explode("categories")))
    places = F.create_map(*[x for i, n in enumerate(names, 1) for x in (F.lit(n), F.lit(i).cast("long"))]) if names else F.lit(None).cast("map<string,bigint>")
    ids = F.transform(F.filter(F.array_distinct("categories"), lambda x: x.isNotNull()), lambda x: F.try_element_at(places, x))
    return rows.select("upstream", "skills", F.array_sort(ids).alias("ids")), names


def _by_upstream(rows: DataFrame, ids: Column) -> DataFrame:
    """(id, hits, w, upstreams) of each id of ``ids`` and, under 0, of all rows; a row weighs one over the root of its upstream's rows.

    Rows are counted by (upstream, id) with partial aggregation, so a large upstream isn't gathered anywhere.
    """
    counts = rows.select("upstream", F.explode(F.concat(F.array(F.lit(0).cast("long")), ids)).alias("id")).groupBy("upstream", "id").agg(F.count(F.lit(1)).alias("hits"))
    together = counts.groupBy("upstream").agg(F.collect_list(F.struct("id", "hits")).alias("all"), F.max(F.when(F.col("id") == 0, F.col("hits"))).alias("size"))
    each = together.select("size", F.inline("all"))
    return each.groupBy("id").agg(F.sum("hits").alias("hits"), F.sum(F.col("hits") / F.sqrt("size")).alias("w"), F.count(F.lit(1)).alias("upstreams"))


def _reach(rows: DataFrame, ids: Column) -> DataFrame:
    """(id, skills): distinct skills, each of its upstream, of the rows with each id of ``ids`` and, under 0, of all rows.

    Ids are bits of words of 64. Each skill's words are united over its rows, with partial aggregation, and then each bit is added up
    over the skills: exact, and without a row for each id and skill.
    """
    every = F.concat(F.array(F.lit(0).cast("long")), ids)
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
    word = lambda x: F.floor(x / 64).cast("long")
    mask = lambda a, w: F.aggregate(F.filter(a, lambda x: word(x) == w), F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(bit(x)))
    words = bound(every, lambda a: F.transform(F.array_distinct(F.transform(a, word)), lambda w: F.struct(w.alias("word"), mask(a, w).alias("mask"))))
    long = rows.select("upstream", "skills", words.alias("words")).select("upstream", F.explode("skills").alias("skill"), "words").select("upstream", "skill", F.inline("words"))
    united = long.groupBy("upstream", "skill", "word").agg(F.bit_or("mask").alias("mask"))
    added = united.groupBy("word").agg(F.array(*[F.sum(F.call_function("shiftrightunsigned", F.col("mask"), F.lit(b)).bitwiseAND(1)) for b in range(64)]).alias("n"))
    return added.select("word", F.posexplode("n").alias("b", "skills")).where("skills > 0").select((F.col("word") * 64 + F.col("b")).alias("id"), "skills")


def _counted(rows: DataFrame, ids: Column, reached: Column) -> DataFrame:
    """(id, hits, w, upstreams, skills) of every id, with the same of all rows (``n``, ``all_w``, ``all_upstreams``, ``all_skills``)."""
    out = written(_by_upstream(rows, ids).join(_reach(rows, reached), "id", "left").withColumn("skills", F.coalesce("skills", F.lit(0))), "counted")
    whole = out.where("id = 0").select(F.col("hits").alias("n"), F.col("w").alias("all_w"), F.col("upstreams").alias("all_upstreams"), F.col("skills").alias("all_skills"))
    return out.where("id > 0").crossJoin(F.broadcast(whole))  # one row


def prevalence(instances: DataFrame) -> DataFrame:
    """One row for each category: hits, share, weighted share, and how much of skills and upstreams it reaches.

    An instance credits all of its skills to each of its categories; categories are a vocabulary, null is none of them. Instances
    are computed and written once; hits and weights are summed by upstream and skills counted as bits (``_reach``).
    """
    rows, names = _coded(instances)
    out = _counted(rows, F.col("ids"), F.col("ids"))
    name = F.get(F.array(*map(F.lit, names)), (F.col("id") - 1).cast("int")) if names else F.lit(None).cast("string")
    return out.select(
        name.alias("category"), "hits", F.col("n").alias("analyzed"), ratio(F.col("hits"), F.col("n")).alias("prevalence"), ratio(F.col("w"), F.col("all_w")).alias("adjusted_prevalence"),
        "skills", F.col("all_skills").alias("observed_skills"), ratio(F.col("skills"), F.col("all_skills")).alias("skill_breadth"),
        "upstreams", F.col("all_upstreams").alias("observed_upstreams"), ratio(F.col("upstreams"), F.col("all_upstreams")).alias("upstream_coverage"),
    )


def canonical_rank(c: Column, order: list[str]) -> Column:
    """Place in a fixed order; others come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), c), F.lit(0)), F.lit(len(order) + 1))


def share(rows: DataFrame, key: str) -> DataFrame:
    """Count and share of all rows by key, the largest first."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", "total", ratio(F.col("n"), F.col("total")).alias("share")).orderBy(F.desc("n"), key)


def bundles(instances: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Sets of 2 to 3 categories that occur together: support, reach, and lift over independence, ranked.

    Combinations are formed inside each row's array, without a self-join, as numbers whose digits are places in the vocabulary;
    categories, pairs and triples are then counted together, as in ``prevalence``.
    """
    rows, names = _coded(instances)
    base, c = len(names) + 1, F.col("ids")
    rest = lambda i: F.slice(c, i + 2, F.greatest(F.size(c) - i - 1, F.lit(0)))
    pairs = F.flatten(F.transform(c, lambda x, i: F.transform(rest(i), lambda y: x * base + y)))
    triples = F.flatten(F.transform(c, lambda x, i: F.flatten(F.transform(rest(i), lambda y: F.transform(F.filter(rest(i), lambda z: z > y), lambda z: (x * base + y) * base + z)))))
    made = F.concat(*[m for n, m in ((2, pairs), (3, triples)) if n in sizes])
    counted = written(_counted(rows, F.concat(c, made), made), "bundles")
    digits = F.filter(F.array(*[F.pmod(F.floor(F.col("id") / base**k), F.lit(base)).cast("int") for k in (2, 1, 0)]), lambda d: d > 0)
    label = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    found = counted.where(F.col("id") >= base).withColumn("places", digits)
    single = counted.where(F.col("id") < base).select(F.col("id").cast("int").alias("place"), F.col("hits").alias("k"))
    parts = found.select("id", "n", F.explode("places").alias("place")).join(single, "place")
    expected = parts.groupBy("id").agg(F.product(F.col("k") / F.col("n")).alias("expected"))
    out = found.join(expected, "id").select(
        F.array_join(F.transform("places", lambda d: F.get(label, d - 1)), " + ").alias("bundle"), F.size("places").alias("size"), F.col("hits").alias("support"), ratio(F.col("hits"), F.col("n")).alias("prevalence"),
        "skills", ratio(F.col("upstreams"), F.col("all_upstreams")).alias("upstream_coverage"), "expected", ratio(ratio(F.col("hits"), F.col("n")), F.col("expected")).alias("lift"),
    )
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("prevalence"), "size", "bundle")))  # one row for each bundle of a fixed vocabulary


def pairs(instances: DataFrame, top: int | None = None) -> DataFrame:
    """Co-occurrence of all pairs of observed categories, pairs that never occur included; optionally of the ``top`` ones."""
    long = instances.select("id", F.explode(F.array_distinct("categories")).alias("category"))
    counts = long.groupBy("category").agg(F.count(F.lit(1)).alias("k"))
    if top is not None:
        counts = counts.orderBy(F.desc("k"), "category").limit(top)
    counts = _few(counts, "categories")
    n = instances.agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select(F.col("category").alias("a"), F.col("k").alias("a_count")).join(counts.select(F.col("category").alias("b"), F.col("k").alias("b_count")), F.col("a") < F.col("b"))
    c = F.array_sort(F.array_distinct("categories"))
    both = instances.select(c.alias("c")).select(F.explode(F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.greatest(F.size("c") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    both = both.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("together"))
    out = grid.join(both, ["a", "b"], "left").crossJoin(F.broadcast(n)).withColumn("together", F.coalesce("together", F.lit(0)))
    expected = F.col("a_count") / F.col("n") * F.col("b_count") / F.col("n")
    return out.select("a", "b", "a_count", "b_count", "together", ratio(F.col("together"), F.col("n")).alias("prevalence"), ratio(F.col("together") / F.col("n"), expected).alias("lift"))


def recall(rows: DataFrame) -> DataFrame:
    """Mean recall and share of rows with any hit, of ``pred`` against ``ref`` sets; empty references don't count."""
    both = F.size(F.array_intersect("pred", "ref"))
    kept = rows.where(F.size("ref") > 0).select((both / F.size(F.array_distinct("ref"))).alias("recall"), (both > 0).cast("double").alias("hit"))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"), F.coalesce(F.avg("hit"), F.lit(0.0)).alias("any_hit"))


def mismatch(rows: DataFrame) -> DataFrame:
    """Pooled: labels asserted in ``pred``, captured by ``ref``, unmatched, and the share unmatched."""
    out = rows.agg(F.sum(F.size(F.array_distinct("pred"))).alias("asserted"), F.sum(F.size(F.array_intersect("pred", "ref"))).alias("captured"), F.sum(F.size(F.array_except("pred", "ref"))).alias("unmatched"))
    return out.withColumn("share_unmatched", ratio(F.col("unmatched"), F.col("asserted")))


def expression_share(rows: DataFrame, column: str) -> DataFrame:
    """Count and share over all rows of each value of an array column; repeats within a row count."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    counts = rows.select(F.explode(column).alias("expression")).groupBy("expression").agg(F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(n)).select("expression", "k", ratio(F.col("k"), F.col("n")).alias("share"))


def sorted_pairs(found: DataFrame, order: list[str]) -> DataFrame:
    """Pairs with ``place``, by falling prevalence; equal ones in the categories' fixed order, unknown ones last, by name."""
    return running(found, [F.desc("prevalence"), canonical_rank(F.col("a"), order), canonical_rank(F.col("b"), order), F.col("a"), F.col("b")]).orderBy("place")


def conditional_lift(rows: DataFrame, why: str, what: str, support: int = 5) -> DataFrame:
    """P(what | why) / P(what) for each why with enough rows and each what, combinations that never occur included."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    long = rows.select(F.array_distinct(why).alias("y"), F.array_distinct(what).alias("x"))
    whys = long.select(F.explode("y").alias("why")).groupBy("why").agg(F.count(F.lit(1)).alias("why_count")).where(F.col("why_count") >= support)
    whats = long.select(F.explode("x").alias("what")).groupBy("what").agg(F.count(F.lit(1)).alias("what_count"))
    both = long.select(F.explode("y").alias("why"), "x").select("why", F.explode("x").alias("what")).groupBy("why", "what").agg(F.count(F.lit(1)).alias("both"))
    grid = whys.crossJoin(_few(whats, "labels")).crossJoin(F.broadcast(n))
    out = grid.join(both, ["why", "what"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return out.select("why", "what", "why_count", "what_count", "both", ratio(F.col("both") / F.col("why_count"), F.col("what_count") / F.col("n")).alias("lift"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; (0, 0) for no observations."""
    p = k / n
    middle, scale = (p + z * z / (2 * n)) / (1 + z * z / n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    zero = F.lit(0.0)
    return F.when(n > 0, middle - half).otherwise(zero), F.when(n > 0, middle + half).otherwise(zero)


#: Normal quantiles of the confidence levels that sizes are computed for.
Z = {0.90: 1.645, 0.95: 1.96, 0.98: 2.326, 0.99: 2.576}


def cochran(population: Column, confidence: float = 0.95, margin: float = 0.05, p: float = 0.5) -> Column:
    """Sample size with finite population correction, at most the population; raises for other confidence levels."""
    if confidence not in Z:
        raise ValueError(f"confidence must be one of {sorted(Z)}")
    n0 = Z[confidence] ** 2 * p * (1 - p) / margin**2
    return F.when(population <= 0, 0).otherwise(F.least(F.ceil(n0 * population / (n0 + population - 1)), population)).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def label_counts(rows: DataFrame) -> DataFrame:
    """For each label of ``a`` or ``b``: rows with both (n11), only a (n10), only b (n01), neither (n00)."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    flag = lambda c, other: F.transform(F.array_union("a", "b"), lambda x: F.struct(x.alias("label"), F.array_contains("a", x).alias("in_a"), F.array_contains("b", x).alias("in_b")))
    long = rows.select(F.explode(flag("a", "b")).alias("l")).select("l.*")
    count = lambda a, b: F.sum(F.when((F.col("in_a") == a) & (F.col("in_b") == b), 1).otherwise(0))
    out = long.groupBy("label").agg(count(True, True).alias("n11"), count(True, False).alias("n10"), count(False, True).alias("n01")).crossJoin(F.broadcast(n))
    return out.withColumn("n00", F.col("n") - F.col("n11") - F.col("n10") - F.col("n01"))


def kappa(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Cohen's kappa of two raters on one label; 1 if chance alone would agree fully."""
    n = n11 + n10 + n01 + n00
    po = (n11 + n00) / n
    pe = ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n * n)
    return F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe))


def agreement(rows: DataFrame) -> DataFrame:
    """Mean Jaccard, macro kappa, pooled positive agreement, and alpha, of the sets ``a`` and ``b``."""
    counts = label_counts(rows)
    k = kappa(F.col("n11"), F.col("n10"), F.col("n01"), F.col("n00"))
    pooled = counts.agg(F.avg(k).alias("macro_kappa"), F.sum("n11").alias("n11"), F.sum("n10").alias("n10"), F.sum("n01").alias("n01"), F.sum("n00").alias("n00"))
    means = rows.agg(F.count(F.lit(1)).alias("records"), F.avg(jaccard(F.col("a"), F.col("b"))).alias("mean_jaccard"))
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    p1 = (2 * F.col("n11") + F.col("n10") + F.col("n01")) / (2 * n)
    observed, expected = (F.col("n10") + F.col("n01")) / n, 2 * p1 * (1 - p1)
    positive = 2 * F.col("n11") + F.col("n10") + F.col("n01")
    alpha = F.when(F.coalesce(n, F.lit(0)) == 0, 1.0).when(expected == 0, 1.0).otherwise(1 - observed / expected)
    return means.crossJoin(pooled).select("records", F.coalesce("mean_jaccard", F.lit(1.0)).alias("mean_jaccard"), F.coalesce("macro_kappa", F.lit(0.0)).alias("macro_kappa"), F.when(F.coalesce(positive, F.lit(0)) == 0, 1.0).otherwise(2 * F.col("n11") / positive).alias("positive_agreement"), alpha.alias("alpha"))


def macro(rows: DataFrame) -> DataFrame:
    """Macro precision and recall of the set ``pred`` against ``gold`` over the labels of either."""
    counts = label_counts(rows.select(F.col("gold").alias("a"), F.col("pred").alias("b")))
    precision, rec = ratio(F.col("n11"), F.col("n11") + F.col("n01")), ratio(F.col("n11"), F.col("n11") + F.col("n10"))
    return counts.agg(F.count(F.lit(1)).alias("labels"), F.coalesce(F.avg(precision), F.lit(0.0)).alias("precision"), F.coalesce(F.avg(rec), F.lit(0.0)).alias("recall"))


def precision_recall(rows: DataFrame) -> DataFrame:
    """Pooled counts and ratios of ``pred`` against (pred and added) without removed, with Wilson bounds."""
    final = F.array_except(F.array_union("pred", "added"), "removed")
    hits = rows.agg(F.sum(F.size(F.array_intersect(F.col("pred"), final))).alias("hits"), F.sum(F.size(F.array_distinct("pred"))).alias("predicted"), F.sum(F.size(final)).alias("final"))
    out = hits.select("*", ratio(F.col("hits"), F.col("predicted")).alias("precision"), ratio(F.col("hits"), F.col("final")).alias("recall"))
    for name, of in (("precision", "predicted"), ("recall", "final")):
        low, high = wilson(F.col("hits"), F.col(of))
        out = out.withColumn(f"{name}_low", low).withColumn(f"{name}_high", high)
    return out


def batches(total, done, size: int = 50):
    """Batches that are left, of numbers or of columns."""
    if isinstance(total, Column):
        return F.ceil(F.greatest(total - done, F.lit(0)) / size).cast("long")
    return math.ceil(max(total - done, 0) / size)
