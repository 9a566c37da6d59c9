"""Column functions on unified diffs: patches of several files, lines with roles, hunks, frontmatter, headings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import cut_at
from .text import bound, lines, strip


def patch(files: Column) -> Column:
    """One text from files (filename, previous_filename, status, additions, deletions, patch), each below a header."""
    old = lambda f: F.coalesce(F.when(f["previous_filename"] != "", f["previous_filename"]), f["filename"])
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    header = lambda f: F.concat(F.lit("diff --git "), old(f), F.lit(" "), f["filename"], F.lit("  ["), F.coalesce(f["status"], F.lit("")), F.lit(" +"), count(f["additions"]), F.lit("/-"), count(f["deletions"]), F.lit("]"))
    return F.array_join(F.transform(files, lambda f: F.concat_ws("\n", header(f), F.when(f["patch"] != "", f["patch"]))), "\n")


_HEADER = r"^diff --git (.+?) (.+?)(?:  \[|\z)"


def paths(text: Column) -> Column:
    """Changed paths of a patch, in order. A path with a space is cut at its first space, as headers don't quote."""
    return F.transform(F.filter(lines(text), lambda x: x.rlike(_HEADER)), lambda x: strip(F.regexp_extract(x, _HEADER, 2)))


def _numbered(text: Column) -> Column:
    """Lines of a text with their numbers, from 1."""
    return F.transform(lines(text), lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("text")))


def _sections(text: Column, begins) -> Column:
    """Numbered lines, cut before each line that ``begins`` holds for; first comes what is before any, be it empty."""
    starts = lambda rows: F.transform(F.filter(rows, lambda r: begins(r["text"])), lambda r: r["line"] - 1)
    return bound(_numbered(text), lambda rows: cut_at(rows, starts(rows)))


def files(text: Column) -> Column:
    """Files of a patch: array of (path, status, diff); text before the first header is dropped."""

    def one(rows: Column) -> Column:
        head, body = rows[0]["text"], F.slice(rows, F.lit(2), F.size(rows) - 1)
        diff = F.array_join(F.transform(body, lambda r: F.concat(r["text"], F.lit("\n"))), "")
        return F.struct(strip(F.regexp_extract(head, _HEADER, 2)).alias("path"), F.regexp_extract(head, r"(?U)\[(\w+)", 1).alias("status"), diff.alias("diff"))

    return bound(_sections(text, lambda x: x.rlike(_HEADER)), lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 1), one))


def _in_blocks(diff: Column, apart: bool) -> Column:
    """Lines with roles. What stands before the first header shares its block or, if ``apart`` and with any role, is one of its own."""

    def row(r: Column, block: Column) -> Column:
        x = r["text"]
        role = F.when(x.startswith("@@") | x.startswith("+++") | x.startswith("---"), None).when(x.startswith("+"), "added").when(x.startswith("-"), "removed").when(x.startswith(" "), "context")
        return F.struct(r["line"].alias("line"), block.cast("int").alias("block"), role.alias("role"), F.substring(x, F.lit(2), F.length(x)).alias("content"))

    def rows(sections: Column) -> Column:
        with_role = lambda s, block: F.filter(F.transform(s, lambda r: row(r, block)), lambda r: r["role"].isNotNull())
        joined = lambda lead: F.concat(lead, F.flatten(F.transform(F.slice(sections, F.lit(2), F.size(sections) - 1), lambda s, j: with_role(s, j + F.when(F.lit(apart) & (F.size(lead) > 0), 1).otherwise(0)))))
        return bound(with_role(sections[0], F.lit(0)), joined)

    return bound(_sections(diff, lambda x: x.startswith("@@")), rows)


def block_lines(diff: Column) -> Column:
    """(line, block, role, content) of the added, removed and context lines of one file's diff.

    Every line counts in ``line``. Lines that start with ``+++`` or ``---`` are taken for file headers. Lines before the
    first ``@@`` share block 0 with the first hunk.
    """
    return _in_blocks(diff, False)


def hunk_lines(diff: Column) -> Column:
    """As ``block_lines``, but lines before the first ``@@`` are block 0 and the first hunk then is block 1."""
    return _in_blocks(diff, True)


def hunk_status(roles: Column) -> Column:
    """Status of a hunk from the array of its lines' roles."""
    added, removed = F.array_contains(roles, "added"), F.array_contains(roles, "removed")
    return F.when(added & removed, "modified").when(added, "added").when(removed, "removed").otherwise("context")


def touches_field(diff: Column, field: str) -> Column:
    """Whether an added or removed line lies on a frontmatter field, its localised variants or their continuation."""
    start = F.struct(F.lit(0).alias("state"), F.lit(False).alias("inside"), F.lit(False).alias("hit"))
    quoted = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in field)

    def step(a: Column, raw: Column) -> Column:
        sign = F.when(raw.rlike(r"^[+\- ]"), F.substring(raw, 1, 1)).otherwise(" ")
        text = F.when(raw.rlike(r"^[+\- ]"), F.substring(raw, F.lit(2), F.length(raw))).otherwise(raw)
        fence, open_ = strip(text) == "---", a["state"] == 1
        named = text.rlike(rf"(?iU)^\s*{quoted}(_\w+)?\s*:")
        other = text.rlike(r"(?U)^\S+\s*:")
        inside = F.when(fence, False).when(~open_, a["inside"]).when(named, True).when(other, False).otherwise(a["inside"])
        hit = a["hit"] | (~fence & open_ & inside & sign.isin("+", "-"))
        moved = F.struct(F.when(fence, F.when(a["state"] == 0, 1).otherwise(2)).otherwise(a["state"]).alias("state"), inside.alias("inside"), hit.alias("hit"))
        return F.when(raw == "", a).otherwise(moved)

    return F.coalesce(F.aggregate(lines(diff), start, step, lambda a: a["hit"]), F.lit(False))


def frontmatter(text: Column) -> Column:
    """The YAML block at the very start of a text, or null."""
    pattern = r"(?s)\A---\n(.*?)\n---\s*\n"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def yaml_object(block: str | None) -> str:
    """A YAML block as a JSON object; what is missing, malformed or no mapping becomes ``{}``."""
    import json

    import yaml

    try:
        read = yaml.safe_load(block) if block else None
        return json.dumps(read if isinstance(read, dict) else {}, ensure_ascii=False, default=str)
    except (yaml.YAMLError, ValueError, TypeError, RecursionError):
        return "{}"


def frontmatter_fields(text: Column) -> Column:
    """Fields of the frontmatter as a JSON object, ``{}`` where there is none that can be read.

    YAML needs a parser in Python, which must be installed; only the block goes there, in Arrow batches.
    """

    @F.pandas_udf("string")
    def read(blocks: pd.Series) -> pd.Series:
        return pd.Series([yaml_object(b) for b in blocks], dtype=object)

    return read(frontmatter(text))


def frontmatter_variant(text: Column) -> Column:
    """Fields of the frontmatter as a VARIANT, an empty object where there is none that can be read."""
    return F.parse_json(frontmatter_fields(text))


def headings(text: Column) -> Column:
    """ATX headings (level, text, line) outside fences; either fence mark opens or closes."""
    pattern = r"(?U)^(#{1,6})\s+(.+?)\s*\z"

    def row(r: Column) -> Column:
        return F.struct(F.length(F.regexp_extract(r["text"], pattern, 1)).alias("level"), F.regexp_extract(r["text"], pattern, 2).alias("text"), r["line"].alias("line"))

    def outside(sections: Column) -> Column:  # every second section begins with a mark that closes
        found = F.transform(F.filter(sections, lambda s, j: j % 2 == 0), lambda s: F.filter(s, lambda r: r["text"].rlike(pattern)))
        return F.transform(F.flatten(found), row)

    return bound(_sections(text, lambda x: x.rlike(r"(?U)^\s*(```|~~~)")), outside)
