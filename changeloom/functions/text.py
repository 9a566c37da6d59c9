"""Column functions on messages and other text: classifiers, trimming, slugs, redaction, label lists.

Regular expressions are Java's. ``(?U)`` makes ``\\w``, ``\\s`` and ``\\b`` follow Unicode; ``\\z`` is the very end.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of mechanical commits, in the order in which they are tried at the start of a subject.
NOISE = (
    ("squashed", r"^Squashed commit of the following:"),
    ("squashed_subtree", r"^Squashed '.*' (changes|content) from"),
    ("merge_pr", r"(?U)^Merge pull request #\d+"),
    ("merge_branch", r"(?iU)^Merge (branch|remote-tracking|tag|commit|upstream|origin) "),
    ("merge_other", r"(?iU)^Merge\b(?! pull request| branch| remote| tag| commit| upstream| origin)"),
    ("revert", r"^Revert ['\"]"),
    ("release_note", r"(?iU)^(Release\s+v?\d+\.\d+|v?\d+\.\d+\.\d+(\s|\b)|Bump version)"),
    ("initial_commit", r"(?iU)^Initial commit\n?\z"),
    ("update_readme", r"(?iU)^Update README(\.md)?\n?\z"),
    ("create_using", r"(?iU)^Created? (using|with) "),
)
# Classes of maintenance messages, in order, searched anywhere in a subject.
MAINTENANCE = (
    ("upstream_sync", r"auto-sync|sync(ed)? with upstream|upstream sync|merge upstream"),
    ("catalog_index", r"catalog|index|skill-index|skill index|badge|count[s]?"),
    ("ci_workflow", r"ci|github actions?|workflow|lint|markdownlint|mdformat"),
    ("plugin_manifest", r"plugin|marketplace|manifest"),
    ("release_version", r"release|version|changelog|bump"),
    ("repo_docs", r"readme|contributing|license|quickstart|migration"),
    ("dependency_config", r"package\.json|pyproject|dependencies?|dependency|npm|pip|uv lock"),
    ("local_settings", r"settings\.local|local permission|allowlist"),
)
# Keys of footer lines.
FOOTERS = r"Co-Authored-By|Signed-off-by|Reviewed-by|Cc|Generated with|🤖 Generated|Reported-by|Closes|Fixes|Refs|Resolves|See|Tested-by|Acked-by"
# Secrets and local paths that a release must not show. The last secret keeps its key.
SECRETS = (
    (r"(?U)\bgh[pousr]_[A-Za-z0-9_]{20,}\b", "<REDACTED>"),
    (r"(?U)\bgithub_pat_[A-Za-z0-9_]{20,}\b", "<REDACTED>"),
    (r"(?U)\bsk-[A-Za-z0-9_-]{20,}\b", "<REDACTED>"),
    (r"(?iU)\b(api[_-]?key|token|secret|password)\s*[:=]\s*['\"]?[^'\"\s,;}]+", "$1=<REDACTED>"),
)
LOCAL_PATHS = (r"(?U)/Users/[^/\s]+", r"(?U)/home/[^/\s]+", r"(?iU)\b[A-Z]:\\Users\\[^\\\s]+")
# A key and its value in a line of code, and what stands for it if the key names a secret; bearer tokens.
SNIPPETS = (
    (r"(?iU)(['\"])KEY\1\s*:\s*(['\"])[^'\"]+\3", "$1$2$1: $3<redacted>$3"),
    (r"(?iU)\bKEY\b\s*=\s*(['\"])[^'\"]+\2", "$1=$2<redacted>$2"),
    (r"(?iU)\bKEY\b\s*=\s*(?!['\"])[^\s;&]+", "$1=<redacted>"),
)
BEARER = (r"(?iU)(Bearer\s+)[A-Za-z0-9._~+/=-]+", "$1<redacted>")
#: A text without any of these, in lower case, has no match.
HOLDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-", "key", "token", "secret", "password", "/users/", "/home/", "users\\")
# Branch names and messages of rows that only follow their upstream.
SYNC_BRANCH = r"(?iU)\b(auto-sync|sync/upstream|upstream-\d|merge-upstream)\b"
SYNC_MESSAGE = r"(?iU)\b(auto-sync|sync(ed)? with upstream|upstream sync|merge upstream)\b"
#: Line ends as Python's ``splitlines`` knows them, and white space at either end as ``strip`` does.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Marks around a match, any key, and a key that names a secret, for snippets.
_OPEN, _SHUT, _NAME = "\ue000", "\ue001", r"([A-Za-z_][A-Za-z0-9_-]*)"
_SECRET_KEY = r"(?=[A-Za-z0-9_-]*?(?:api[_-]?key|token|password|secret))([A-Za-z_][A-Za-z0-9_-]*)"


def strip(c: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(c, rf"\A{_BLANK}+|{_BLANK}+\z", "")


def lines(c: Column) -> Column:
    """Lines of a text, without their ends; an end at the very end makes no further line."""
    parts = F.split(c, LINE_END)
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def bound(c: Column, f) -> Column:
    """``f`` of a column that is evaluated once, however often ``f`` names it."""
    return F.transform(F.array(c), f)[0]


def subject(message: Column) -> Column:
    """First line of the stripped message; only that line is read."""
    end = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
    return F.regexp_extract(message, rf"\A{_BLANK}*((?:(?!{end})(?s:.))*?)(?={_BLANK}*\z|{end})", 1)


def is_empty(message: Column) -> Column:
    """Whether a message is null or has white space alone."""
    return ~F.coalesce(message.rlike(rf"(?!{_BLANK})(?s:.)"), F.lit(False))


def _first(message: Column, classes) -> Column:
    """The first class whose pattern is found in the subject."""

    def choose(of: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, pattern in classes:
            out = out.when(of.rlike(pattern), name)
        return out

    return F.when(is_empty(message), "empty").otherwise(bound(subject(message), choose))


def noise_class(message: Column) -> Column:
    """Class of a mechanical commit, or null."""
    return _first(message, NOISE)


def maintenance_class(message: Column) -> Column:
    """Class of a maintenance message, or null."""
    return _first(message, [(name, rf"(?iU)\b({words})\b") for name, words in MAINTENANCE])


def trim_footers(message: Column) -> Column:
    """Message without footer lines, with at most one blank line in a row, stripped."""
    blanked = F.regexp_replace(message, rf"(?imu)(?d)^(?:{FOOTERS}):.*$", "")
    return strip(F.regexp_replace(blanked, r"\n{3,}", "\n\n"))


def is_sync(branch: Column, commits: Column) -> Column:
    """Whether a row's branch name or any of its messages says that it follows the upstream."""
    return F.coalesce(branch.rlike(SYNC_BRANCH), F.lit(False)) | F.coalesce(F.exists(commits, lambda c: F.coalesce(c["message"].rlike(SYNC_MESSAGE), F.lit(False))), F.lit(False))


def slug(c: Column) -> Column:
    """Name for files: runs of other characters become a hyphen; empty becomes ``x``."""
    short = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.when(short == "", "x").otherwise(short)


def stem(upstream: Column, owner: Column, branch: Column) -> Column:
    """File stem of an instance."""
    return F.concat_ws("--", F.translate(upstream, "/", "-"), slug(owner), slug(branch))


def redact(c: Column) -> Column:
    """Text without secrets and local user paths. Texts that hold nothing that any pattern needs aren't searched."""
    out = c
    for pattern, by in [*SECRETS, *((p, "<LOCAL_USER_PATH>") for p in LOCAL_PATHS)]:
        out = F.regexp_replace(out, pattern, by)
    needed = bound(F.lower(c), lambda low: reduce(or_, (F.contains(low, F.lit(t)) for t in HOLDS)))
    return F.when(needed, out).otherwise(c)


def _redact_keyed(c: Column, pattern: str, by: str) -> Column:
    """Replace matches whose key names a secret. Any match uses up its text, so all are marked first, then told apart."""
    marked = F.regexp_replace(c, pattern, f"{_OPEN}$0{_SHUT}")
    secret = pattern.removeprefix("(?iU)").replace(_NAME, _SECRET_KEY).replace(r"[^\s;&]+", rf"[^\s;&{_SHUT}]+").replace("[^'\"]+", f"[^'\"{_SHUT}]+")
    keyed = F.regexp_replace(marked, f"(?iU){_OPEN}{secret}{_SHUT}", by)
    return F.regexp_replace(keyed, f"[{_OPEN}{_SHUT}]", "")


def redact_snippet(c: Column) -> Column:
    """Line of code without the values given to keys that name a secret, and without bearer tokens."""
    for pattern, by in SNIPPETS:
        c = _redact_keyed(c, pattern.replace("KEY", _NAME), by)
    return F.regexp_replace(c, *BEARER)


def label_list(c: Column) -> Column:
    """Labels of a comma-separated text; ``(none)`` and null give none."""
    parts = F.filter(F.transform(F.split(c, ","), strip), lambda x: (x != "") & (x != "(none)"))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(parts)


def fixed4(c: Column) -> Column:
    """A number with four decimals, ties to even, without separators."""
    return F.regexp_replace(F.format_number(c, 4), ",", "")
