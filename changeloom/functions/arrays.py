"""Column functions on arrays whose cost stays in proportion to the array's length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Elements that one chunk of a scan holds.
CHUNK = 128


def _serial(numbers: Column) -> Column:
    """Sums before each element and, at the end, of all; copies what is done at every step, so only for chunks."""
    return F.aggregate(numbers, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def prefix_sums(numbers: Column, levels: int = 3) -> Column:
    """For each element of an array of whole numbers the sum of those before it, as longs.

    Chunks of ``CHUNK`` elements are added up, the sums before the chunks are found in the same way a level higher, and each
    chunk starts from its own: no array longer than a chunk is grown, until the last level, which has one element for
    ``CHUNK ** (levels - 1)``.
    """

    def scan(a: Column) -> Column:
        if levels == 1:
            return F.slice(_serial(a), 1, F.size(a))
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / CHUNK).cast("int") - 1), lambda b: F.slice(a, b * CHUNK + 1, CHUNK))
        total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)

        def spread(chunks: Column) -> Column:
            each = lambda before: F.transform(chunks, lambda c, i: F.transform(F.slice(_serial(c), 1, F.size(c)), lambda x: x + before[i]))
            return F.flatten(bound(prefix_sums(F.transform(chunks, total), levels - 1), each))

        return F.when(F.size(a) > 0, bound(cut, spread)).otherwise(F.array().cast("array<long>"))

    return bound(numbers, scan)


def cut_at(items: Column, starts: Column) -> Column:
    """Sections of an array: what lies before the first of ``starts`` (places from 0, ascending), then one from each start on.

    Sections are slices, so all of them together cost as much as the array is long.
    """

    def sections(a: Column, s: Column) -> Column:
        end = lambda i: F.when(i + 1 < F.size(s), F.get(s, i + 1)).otherwise(F.size(a))
        first = F.slice(a, 1, F.when(F.size(s) > 0, F.get(s, F.lit(0))).otherwise(F.size(a)))
        return F.concat(F.array(first), F.transform(s, lambda p, i: F.slice(a, p + 1, end(i) - p)))

    return bound(items, lambda a: bound(starts, lambda s: sections(a, s)))
