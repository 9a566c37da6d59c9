"""Sets that no other set of their group holds: Spark deals sets out to units of bounded size, tasks compare those by tries in arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import written

#: A task compares so many rows or bytes at once, and follows so many steps of its tries at once.
ROWS, BYTES, STEPS = 200_000, 32 << 20, 2_000_000


def _repeated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry as often as it counts: its index, and 0, 1, 2... within it."""
    index = np.repeat(np.arange(len(counts)), counts)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)


class _Tries:
    """Tries of the probes of some units, by levels; a node is a set's first items, its children follow each other in ``keys``."""

    def __init__(self, root: np.ndarray, start: np.ndarray, length: np.ndarray, code: np.ndarray, width: int, n: np.ndarray, probes: np.ndarray):
        self.start, self.stop, self.code, self.width, self.n = start, start + length, code, width, n
        self.keys, self.first, self.held, self.ends = [], [], [np.zeros(root.max(initial=-1) + 1, bool)], []
        node, left = root[probes], probes
        self._lookup = None
        while True:
            depth, over = len(self.keys), length[left] == len(self.keys)
            self.ends.append((left[over], node[over]))
            left, node = left[~over], node[~over]
            if not len(left):
                break
            keys, node = np.unique(node * width + code[start[left] + depth], return_inverse=True)
            self.keys.append(keys)
            self.first.append(np.searchsorted(keys, np.arange(len(self.held[-1]) + 1) * width))
            self.held.append(np.zeros(len(keys), bool))

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """Items of all sets as sorted keys, and where they are."""
        if self._lookup is None:
            keys = np.repeat(np.arange(len(self.start)), self.stop - self.start) * self.width + self.code
            order = np.argsort(keys, kind="stable")
            self._lookup = keys[order], order
        return self._lookup

    def walk(self, node: np.ndarray, holder: np.ndarray, at: np.ndarray) -> None:
        """Mark the nodes that larger sets hold, from the roots on: ``holder`` holds ``node``, and its items from ``at`` on come later."""
        todo = [(0, node, holder, at)]
        while todo:
            depth, node, holder, at = todo.pop()
            self.held[depth][node[self.n[holder] > depth]] = True
            if depth == len(self.keys):
                continue
            first = self.first[depth]
            children, items = first[node + 1] - first[node], self.stop[holder] - at
            some = np.flatnonzero((children > 0) & (items > 0))
            part = np.cumsum(np.minimum(children[some], items[some])) // STEPS
            parts = np.split(some, np.flatnonzero(np.diff(part)) + 1)
            if len(parts) > 1:
                todo += [(depth, node[x], holder[x], at[x]) for x in parts]
            elif len(some):
                todo.append((depth + 1, *self._next(depth, node[some], holder[some], at[some], children[some], items[some])))

    def _next(self, depth: int, node: np.ndarray, holder: np.ndarray, at: np.ndarray, children: np.ndarray, items: np.ndarray) -> list[np.ndarray]:
        """The children that holders hold: by their own items or by the children, whichever are fewer."""
        keys, found = self.keys[depth], []
        few = children < items
        if few.any():
            index, k = _repeated(children[few])
            child, who = self.first[depth][node[few]][index] + k, holder[few][index]
            sorted_, places = self.lookup()
            wanted = who * self.width + keys[child] % self.width
            place = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
            hit = sorted_[place] == wanted
            found.append((child[hit], who[hit], places[place[hit]] + 1))
        if not few.all():
            index, k = _repeated(items[~few])
            place, who = at[~few][index] + k, holder[~few][index]
            wanted = node[~few][index] * self.width + self.code[place]
            child = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[child] == wanted
            found.append((child[hit], who[hit], place[hit] + 1))
        return [np.concatenate(x) for x in zip(*found, strict=True)]


def _number(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers of a column's values; null is a value."""
    return pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _kept(rows: pa.Table) -> np.ndarray:
    """Whether each row is a probe that no row of its unit and group holds; of equal sets the first stays."""
    root = _number(rows["u"])
    for part in rows["g"].combine_chunks().flatten():
        more = _number(pa.chunked_array([part]))
        root = np.unique(root * (more.max() + 1) + more, return_inverse=True)[1]
    lists = rows["items"].combine_chunks()
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    probe, n = (rows[c].to_numpy().astype(kind) for c, kind in (("probe", bool), ("n", np.int64)))
    start = np.cumsum(length) - length
    tries = _Tries(root, start, length, words.indices.to_numpy().astype(np.int64), len(words.dictionary) + 1, n, np.flatnonzero(probe))
    every = np.arange(len(root))
    tries.walk(root, every, start)

    rank = np.empty(len(root), np.int64)
    rank[pc.sort_indices(rows.select(["a", "b"]), [("a", "ascending"), ("b", "ascending")], null_placement="at_start").to_numpy()] = every
    kept = np.zeros(len(root), bool)
    for (sets, node), held in zip(tries.ends, tries.held, strict=True):
        order = np.lexsort([rank[sets], node])
        best = np.ones(len(order), bool)
        best[1:] = np.diff(node[order]) != 0
        stay = order[best]
        kept[sets[stay[~held[node[stay]]]]] = True
    return kept


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, b) of the sets that stay. Rows come by unit, a unit's probes first; of a unit that isn't over yet, these are carried on."""
    waiting, carried = [], None

    def settled(last: bool) -> pa.Table:
        nonlocal waiting, carried
        rows = pa.concat_tables([*([carried] if carried is not None else []), pa.Table.from_batches(waiting)])
        rows = rows.filter(pa.array(_kept(rows))) if last else rows.append_column("stays", pa.array(_kept(rows)))
        waiting, carried = [], None
        if not last:
            open_ = pc.equal(rows["u"], rows["u"][-1])
            stay, rows = rows["stays"], rows.drop_columns(["stays"])
            carried, rows = rows.filter(pc.and_(stay, open_)), rows.filter(pc.and_(stay, pc.invert(open_)))
        return rows.select(["g", "b"])

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        if sum(x.num_rows for x in waiting) >= ROWS or sum(x.nbytes for x in waiting) >= BYTES:
            yield from settled(False).to_batches()
    if waiting:
        yield from settled(True).to_batches()
    elif carried is not None:
        yield from carried.select(["g", "b"]).to_batches()


def _dealt(united: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """Of large groups' sets (g, items, n, a, b): rows of units, and (g, b) of the sets that stay without being compared.

    An item is common if very many sets of its group have it; common items come last in a set. A set is a probe in the unit of its
    first item, and meets there the sets that have one of the unit's items and another one after it, from that item on. A
    unit is a share of a group's items, and of its probes if they are too many.
    """
    sizes = united.where("n > 0").groupBy("g").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total"))
    counts = written(united.select("g", F.explode("items").alias("x")).groupBy("g", "x").agg(F.count(F.lit(1)).alias("f")), "counts")
    often = F.col("f") > F.greatest(F.lit(hot / 8), F.col("sets") / 64)
    common = counts.join(sizes, "g").where(often).groupBy("g").agg(F.collect_set("x").alias("common"))
    plan = sizes.join(common, "g", "left").select("g", F.coalesce("common", F.array().cast("array<string>")).alias("common"), F.ceil(F.col("total") / hot).alias("shares"))
    share = lambda x: F.pmod(F.xxhash64(x, F.lit(1)), F.col("shares"))

    dealt = united.where("n > 1").join(written(plan, "plan"), "g")
    last = F.concat(F.filter("items", lambda x: ~F.array_contains("common", x)), F.filter("items", lambda x: F.array_contains("common", x)))
    dealt = dealt.select("g", "shares", last.alias("items"), "n", "a", "b").withColumn("met", F.transform(F.slice("items", F.lit(1), F.col("n") - 1), share))
    parts = F.col("n") > 1, F.ceil(F.sum("n") / hot).alias("blocks")
    units = written(dealt.groupBy("g", F.get("met", F.lit(0)).alias("share")).agg(parts[1]), "units")
    long = dealt.select("g", "items", "n", "a", "b", "met", F.explode(F.array_distinct("met")).alias("share"))
    place = F.array_position("met", F.col("share")).cast("int")
    long = long.select("g", "share", "n", "a", "b", place.alias("place"), F.slice("items", place, F.col("n")).alias("items"))
    long = long.join(units, ["g", "share"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    probe = (F.col("place") == 1) & (F.col("block") == F.pmod(F.xxhash64("items"), F.col("blocks")))
    rows = long.select(F.xxhash64("g", "share", "block").alias("u"), "g", "items", "n", probe.alias("probe"), *[F.when(probe, F.col(c)).alias(c) for c in "ab"])

    single = united.where("n = 1").select("g", "b", F.get("items", F.lit(0)).alias("x")).join(counts.where("f = 1"), ["g", "x"]).select("g", "b")
    return rows, single.unionByName(united.where("n = 0").join(sizes, "g", "left_anti").select("g", "b"))


def maximal_keys(rows: DataFrame, group: list[str], items: Column | str, first: Column, order: str = "row_no", hot: int = 500_000) -> DataFrame:
    """(group columns, order) of the rows whose set of ``items`` is not inside another row's set of the same group.

    Null is a group's value like any other, and null items are none. Of equal sets the row with the greatest ``first`` stays, then the
    least ``order``, which tells rows apart. A row without items goes if its group has any row with some, or an earlier one without.

    ``rows`` are read once. A group of at most ``hot`` sets and items is one unit of comparison; equal sets of larger
    groups are united, and these dealt out to units of about that size. No pair of sets is ever a row.
    """
    own = F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != ""))))
    base = rows.select(F.struct(*group).alias("g"), F.coalesce(own, F.array().cast("array<string>")).alias("items"), (~first).cast("int").alias("a"), F.col(order).alias("b"))
    base = written(base, "sets")
    large = written(base.groupBy("g").agg(F.sum(F.size("items") + 1).alias("size")).where(F.col("size") > hot).select("g"), "large")
    small = base.join(large, "g", "left_anti").select(F.xxhash64("g").alias("u"), "g", "items", F.size("items").alias("n"), F.lit(True).alias("probe"), "a", "b")
    united = base.join(large, "g", "left_semi").groupBy("g", "items").agg(F.min(F.struct("a", "b")).alias("o"))
    united = written(united.select("g", "items", F.size("items").alias("n"), "o.*"), "united")
    more, alone = _dealt(united, hot)

    sorted_ = small.unionByName(more).repartition("u").sortWithinPartitions("u", F.desc("probe"))
    kept = sorted_.mapInArrow(_compared, T.StructType([base.schema["g"], base.schema["b"]])).unionByName(alone)
    return kept.select("g.*", F.col("b").alias(order))
