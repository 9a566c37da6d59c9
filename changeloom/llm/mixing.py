"""Mixing sources to target weights by temperature (operator 10).

A source's weight is its share of all tokens (words), to the power ``a``, over the sum of these. The exponent is bisected in
[0, 1]: the flattest mixture (least ``a``) whose entropy is at most the target and in which no source is repeated more
often than the limit. The budget is given in tokens; by default it is the least one at which no document is left out, so
the source with most tokens for its weight is used once and the others are repeated.

A source whose weight asks for r passes over its documents gets floor(r) whole ones and a last one up to the tokens that
remain. In every pass its documents are dealt into blocks by a seeded hash and ordered by that hash in their block, which
permutes them; blocks of all sources are interleaved by a hash of their own. The last pass ends in one block, at one
hash: two numbers for each source say which documents it holds. So no task ever needs a whole source, and copies of texts
can be made without a shuffle. All of this is DataFrame functions.

A null source is a source of its own. Documents without words count no tokens; a source with none at all is used once.
No window spans a source: sums run over spans of blocks, over the blocks of one span, and over the hashes of one block.
Very long texts are counted where they are read. Rows that repeat an id and a length share their decision; other columns are kept by ``mixed`` and ignored by ``schedule``;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Documents of a block on average, sources whose totals are held on the driver or broadcast at most, and bisections.
BLOCK, FEW, STEPS = 256, 10_000, 50
#: Blocks that are summed together where the last pass's end is looked for.
SPAN = 1024


@dataclass
class Target:
    """What a mixture has to meet: entropy as a share of the greatest possible, passes over a source, tokens, seed."""

    entropy: float = 0.98
    repeats: float = 1.5
    budget: float | None = None
    seed: int = 17


def source_key(column: str = "source") -> Column:
    """A key that tells a null source from any other."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit("n"))


def tokens(column: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, target: Target) -> tuple[float, float, float]:
    """The exponent, the sum of powered shares, and the budget for ``sources`` (source_key, total > 0)."""
    total, n = sources.agg(F.sum("total"), F.count(F.lit(1))).first()
    if not n:
        return 1.0, 1.0, 0.0
    share = F.col("total") / F.lit(float(total))
    held = sorted(r[0] / total for r in sources.select("total").collect()) if n <= FEW else None

    def measure(a: float) -> tuple[float, float, float]:
        """Entropy, most passes, and fewest passes, at a budget of all tokens; sums over the table if it is long."""
        if held is not None:
            z = math.fsum(s**a for s in held)
            passes = [s ** (a - 1) / z for s in held]
            return math.log(z) - math.fsum(s**a / z * a * math.log(s) for s in held), max(passes), min(passes)
        power = F.pow(share, F.lit(a))
        z, dot, most, least = sources.agg(F.sum(power), F.sum(power * F.log(share)), F.max(F.pow(share, F.lit(a - 1))), F.min(F.pow(share, F.lit(a - 1)))).first()
        return math.log(z) - a * dot / z, most / z, least / z

    def meets(a: float) -> bool:
        entropy, most, least = measure(a)
        passes = most / least if target.budget is None else most * target.budget / total
        return entropy <= target.entropy * math.log(n) + 1e-9 and passes <= target.repeats + 1e-9

    low, high = 0.0, 1.0
    if meets(low):
        high = low
    for _ in range(STEPS if high else 0):
        middle = (low + high) / 2
        low, high = (low, middle) if meets(middle) else (middle, high)
    _, _, least = measure(high)
    z = math.fsum(s**high for s in held) if held is not None else sources.agg(F.sum(F.pow(share, F.lit(high)))).first()[0]
    return high, z, target.budget if target.budget is not None else total / least


def order(epoch: Column, target: Target) -> Column:
    """The hash that orders a document in a pass."""
    return F.xxhash64(F.lit(target.seed), epoch.cast("long"), "doc_id", "tokens")


def plan(facts: DataFrame, target: Target) -> DataFrame:
    """One row for each source: blocks, whole passes, and block and hash at which the last pass ends (none: -1)."""
    sums = written(facts.groupBy("source_key").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("docs")), "sources")
    a, z, budget = exponent(sums.where("total > 0"), target)
    total = sums.agg(F.sum("total")).first()[0] or 1
    passes = F.pow(F.col("total") / F.lit(float(total)), F.lit(a)) / F.lit(z) * F.lit(float(budget)) / F.col("total")
    sums = sums.withColumn("passes", F.when(F.col("total") > 0, passes).otherwise(1.0))
    sums = sums.withColumn("full", F.floor(F.col("passes") + 1e-9).cast("int")).withColumn("left", F.greatest(F.floor((F.col("passes") - F.col("full")) * F.col("total")), F.lit(0)))
    sums = sums.withColumn("blocks", F.greatest(F.ceil(F.col("docs") / F.lit(BLOCK)), F.lit(1)).cast("long"))
    last = joined(facts, sums.where("left > 0")).withColumn("hash", order(F.col("full"), target)).withColumn("block", F.pmod("hash", "blocks"))
    sizes = written(last.groupBy("source_key", "block").agg(F.sum("tokens").alias("size")), "sizes")
    # The end is looked for in spans of blocks, then in the blocks of one span, then in one block.
    spans = sizes.groupBy("source_key", F.floor(F.col("block") / SPAN).alias("span")).agg(F.sum("size").alias("size"))
    span = ending(joined(spans, sums.where("left > 0").select("source_key", "left")), "span").withColumnRenamed("rest", "left")
    span = written(span, "spans")
    blocks = sizes.withColumn("span", F.floor(F.col("block") / SPAN)).join(F.broadcast(span) if span.count() <= FEW else span, ["source_key", "span"])
    block = written(ending(blocks.select("source_key", "block", "size", "left"), "block"), "ends").withColumnRenamed("block", "end_block")
    inside = last.join(F.broadcast(block) if block.count() <= FEW else block, "source_key").where("block = end_block")
    inside = inside.groupBy("source_key", "end_block", "hash", "rest").agg(F.sum("tokens").alias("tokens"))  # repeated rows share a hash
    so_far = F.sum("tokens").over(Window.partitionBy("source_key").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1))
    stop = inside.withColumn("so_far", F.coalesce(so_far, F.lit(0))).where("so_far < rest").groupBy("source_key").agg(F.max("end_block").alias("end_block"), F.max("hash").alias("end_hash"))
    return written(sums.join(stop, "source_key", "left").select("source_key", "passes", "full", "blocks", F.coalesce("end_block", F.lit(-1)).alias("end_block"), F.coalesce("end_hash", F.lit(0)).alias("end_hash")), "mixture")


def ending(rows: DataFrame, part: str) -> DataFrame:
    """(source_key, ``part``, rest): the part of each source, in order, in which the first ``left`` tokens end; rest of them in it."""
    before = F.sum("size").over(Window.partitionBy("source_key").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    ends = rows.withColumn("before", F.coalesce(before, F.lit(0))).where("before < left and before + size >= left")
    return ends.select("source_key", part, (F.col("left") - F.col("before")).alias("rest"))


def joined(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's columns: broadcast if the sources, a written table, are few, which is counted, else shuffled."""
    return rows.join(F.broadcast(sources) if sources.count() <= FEW else sources, "source_key")


def passes_of(rows: DataFrame, sources: DataFrame, target: Target) -> DataFrame:
    """Every row once for each pass that holds it, with ``epoch``, ``hash`` and ``block``."""
    out = joined(rows, sources)
    last = order(F.col("full"), target)
    block = F.pmod(last, "blocks")
    held = (F.col("end_block") >= 0) & ((block < F.col("end_block")) | (block == F.col("end_block")) & (last <= F.col("end_hash")))
    out = out.withColumn("copies", F.col("full") + held.cast("int")).where("copies > 0")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return out.withColumn("hash", order(F.col("epoch"), target)).withColumn("block", F.pmod("hash", "blocks"))


def facts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, source_key, tokens) of every document, written once."""
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), source_key().alias("source_key"), tokens().alias("tokens")), "tokens")


def schedule(docs: DataFrame, target: Target) -> DataFrame:
    """A row for each document and pass: its source, block, place in the block, and the block's place among all."""
    facts = facts_of(docs)
    rows = passes_of(facts, plan(facts, target), target)
    place = F.row_number().over(Window.partitionBy("source_key", "epoch", "block").orderBy("hash", "doc_id"))
    rows = rows.withColumn("place", place - 1).withColumn("block_order", F.xxhash64(F.lit(target.seed), "source_key", "epoch", "block"))
    return rows.select("doc_id", "source", "epoch", "block", "place", "block_order", "tokens")


def mixed(docs: DataFrame, target: Target) -> DataFrame:
    """The documents, with all of their columns, as often as the mixture holds them."""
    sources = plan(facts_of(docs), target)
    # The names that the plan needs are set aside, as a table may have columns called the same.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("source_key"), tokens().alias("tokens"))
    return passes_of(row, sources, target).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of all documents."""
    return schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"), Target())
