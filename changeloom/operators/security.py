"""Rule scan of lines: one pass makes a table of matches, from which every summary is derived.

A rule matches a line if four tests hold, the cheap ones first: the line holds any of ``GLOBAL`` texts; it names none of the
rule's allowed domains; the rule's prefilter is found; one of its patterns is found. Prefilters are part of the result.
Rules are unrolled into one array expression, so a line is read once and the order of rules is kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Rule:
    """A rule; patterns and prefilters are searched without regard to case."""

    id: str
    category: str
    name: str
    severity: str
    patterns: tuple[str, ...]
    prefilters: tuple[str, ...] = ()
    allowed: tuple[str, ...] = field(default=())


# The rules.
RULES = (
    Rule("NET001", "network", "External Network Requests", "CRITICAL", (r"curl\s+.*http", r"wget\s+", r"requests\.(post|get|put|delete)\(", r"urllib\.(request|parse)", r"httpx\.", r"fetch\("), (r"\bcurl\b", r"\bwget\b", r"requests\.", r"urllib\.", r"httpx\.", r"fetch\("), ("api.anthropic.com", "github.com", "pypi.org", "npmjs.com")),
    Rule("NET002", "network", "Data Leakage", "CRITICAL", (r"curl.*-d.*@", r"wget.*--post-data", r"nc\s+.*-l", r"netcat.*-l"), (r"\bcurl\b", r"\bwget\b", r"nc\s+", r"netcat")),
    Rule("FILE001", "file", "Access to Sensitive Files", "CRITICAL", (r"~?/\.ssh/", r"~?/\.env", r"~?/\.aws/", r"~?/\.azure/", r"~?/\.credentials", r"\.pem", r"\.key", r"id_rsa", r"id_ed25519", r"credentials\.json", r"secrets\.(yaml|yml|json|env)", r"password", r"(access|auth|refresh|secret|bearer|oauth|session|api|csrf|jwt)[_-]?tokens?", r"api[_-]?key"), (r"\.ssh", r"\.env", r"\.aws", r"\.azure", r"\.credentials", r"\.pem", r"\.key", r"id_rsa", r"id_ed25519", r"credentials\.json", r"secrets\.", r"password", r"token", r"api[_-]?key")),
    Rule("FILE002", "file", "Dangerous File Operations", "CRITICAL", (r"rm\s+-rf\s+/", r"chmod\s+777", r"chmod\s+a\+rwx", r"dd\s+.*of=/", r">\s+/(etc|usr|bin|sbin)/"), (r"\brm\b", r"\bchmod\b", r"\bdd\b", r">\s*/(?:etc|usr|bin|sbin)/")),
    Rule("CMD001", "command", "Execution of Dangerous Commands", "CRITICAL", (r"\bsudo\b", r"\bsu\s", r"rm\s+-rf\s+/", r"chmod\s+777", r"\bdd\s+.*of=/", r":()>.*\("), (r"\bsudo\b", r"\bsu\s", r"\brm\b", r"\bchmod\b", r"\bdd\b", r":>")),
    Rule("CMD002", "command", "System Command Invocation", "WARNING", (r"\bos\.system\s*\(", r"subprocess\.(call|run|Popen).*shell\s*=\s*True", r"\bexec\s*\(", r"popen\s*\("), (r"os\.system", r"subprocess\.", r"\bexec\s*\(", r"popen\s*\(")),
    Rule("INJ001", "injection", "Code Injection", "CRITICAL", (r"inject.*into.*file", r"prepend.*__import__", r"inject.*code", r"insert.*into.*file"), (r"inject", r"prepend", r"insert")),
    Rule("INJ002", "injection", "Dynamic Code Execution", "WARNING", (r"\beval\s*\(", r"\bexec\s*\(", r"__import__\s*\(", r"\bcompile\s*\("), (r"\beval\s*\(", r"\bexec\s*\(", r"__import__", r"\bcompile\s*\(")),
    Rule("INJ003", "injection", "Backdoor Implantation", "CRITICAL", (r"bash\s+-i\s+>&\s*/dev/tcp/", r"nc\s+-.*-e\s+/", r"netcat.*-e", r"if.*PROD.*then.*(system|exec|eval|shell)"), (r"\bbash\b", r"/dev/tcp", r"\bnc\b", r"netcat", r"prod")),
    Rule("DEP001", "dependency", "Global Package Installation", "WARNING", (r"pip\s+install.*--global", r"npm\s+install.*-g", r"npm\s+i.*-g", r"yarn\s+global", r"gem\s+install"), (r"\bpip\b", r"npm", r"\byarn\b", r"\bgem\b")),
    Rule("DEP002", "dependency", "Forced Version Overrides", "WARNING", (r"install.*==.*force", r"--upgrade", r"--force-reinstall", r"--ignore-installed"), (r"==", r"--upgrade", r"--force-reinstall", r"--ignore-installed", r"force")),
    Rule("OBF001", "obfuscation", "Code Obfuscation", "WARNING", (r"base64\.decode", r"base64\.b64decode", r"chr\s*\(.+\)\s*\+\s*chr", r"exec\s*\(.*decode"), (r"base64", r"\bchr\s*\(", r"\bexec\s*\(", r"decode")),
    Rule("OBF002", "obfuscation", "Hidden Commands", "WARNING", (r"__import__.*\[.*\]", r"getattr\s*\(.*\s*,\s*['\"].*['\"]\s*\)\s*\(", r"vars\(\)\[.*\]"), (r"__import__", r"getattr", r"vars\(")),
)
# Texts of which a line must hold one before any rule is tried.
GLOBAL = (
    ".aws", ".azure", ".credentials", ".env", ".key", ".pem", ".ssh", "--force-reinstall", "--ignore-installed", "--upgrade", "/bin/", "/dev/tcp", "/etc/", "/sbin/", "/usr/", ":>", "==",
    "__import__", "api-key", "api_key", "apikey", "base64", "bash", "chmod", "chr", "compile", "credentials.json", "curl", "dd ", "dd\t", " dd", "decode", "eval", "exec", "fetch(", "force",
    "gem", "getattr", "httpx.", "id_ed25519", "id_rsa", "inject", "insert", "nc ", "nc\t", " nc", "netcat", "npm", "os.system", "password", "pip", "pnpm", "popen", "prepend", "prod",
    "requests.", "rm ", "rm\t", " rm", "secrets.", "subprocess.", "su ", "su\t", " su", "sudo", "token", "urllib.", "vars", "wget", "yarn",
)
SEVERITY = {"": 0, "WARNING": 1, "CRITICAL": 2}


def one_of(patterns: tuple[str, ...]) -> str:
    """One expression for several, without regard to case."""
    return "(?iU)" + "|".join(f"(?:{p})" for p in patterns)


def any_of(texts: tuple[str, ...]) -> str:
    """One expression that is found where any of the texts is: a tree of their prefixes, so a place is tried once for each first character."""
    heads: dict[str, list[str]] = {}
    for t in texts:
        if not t:
            return ""
        heads.setdefault(t[0], []).append(t[1:])
    parts = [(h if h.isalnum() or h in "_ " else "\\x{%x}" % ord(h)) + any_of(tuple(rest)) for h, rest in sorted(heads.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def needed_text(pattern: str) -> str:
    """The longest text, in lower case, that every match of a pattern holds, as far as it shows outside of groups and choices."""
    if re.search(r"(?<!\\)[|]", re.sub(r"(?<!\\)\([^()]*\)", "", pattern)):
        return ""
    runs, depth = [""], 0
    for m in re.finditer(r"\\[a-zA-Z]|\\.|\[[^]]*\]|.", pattern):
        token, after = m[0], pattern[m.end() : m.end() + 1]
        depth += (token == "(") - (token == ")")
        plain = token[1] if token[0] == "\\" and not token[1].isalnum() else token if len(token) == 1 and token not in "()[]{}.*+?^$|" else ""
        if depth or not plain or after in ("*", "?", "{"):
            runs.append("")
        else:
            runs[-1] += plain.lower()
            if after == "+":
                runs.append("")
    return max(runs, key=len)


def passes_global(line: Column) -> Column:
    """Whether a line holds any of the texts that rules ask for."""
    return F.lower(line).rlike(any_of(GLOBAL))


def folded(line: Column) -> Column:
    """A line in lower case, with the letters that expressions without regard to case take for s, i and k as such."""
    return F.lower(F.translate(line, "\u017f\u0131\u212a", "sik"))


def rule_matches(line: Column, rule: Rule, low: Column | None = None) -> Column:
    """Whether a rule matches a line that has passed the global test. ``low`` is the folded line, if it is at hand.

    A rule is tried only if the line holds a text that one of its prefilters needs.
    """
    low = folded(line) if low is None else low
    texts = [needed_text(p) for p in rule.prefilters]
    gate = low.rlike(any_of(tuple(texts))) if texts and all(texts) else F.lit(True)
    allowed = reduce(lambda a, d: a | F.contains(F.lower(line), F.lit(d.lower())), rule.allowed, F.lit(False))
    found = gate & ~allowed & (line.rlike(one_of(rule.prefilters)) if rule.prefilters else F.lit(True))
    return found & line.rlike(one_of(rule.patterns))


def rule_table(spark, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rules as a small table."""
    return spark.createDataFrame([(i, r.id, r.category, r.name, r.severity) for i, r in enumerate(rules)], "rule_no int, rule string, category string, rule_name string, severity string")


def scan(lines: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each line and rule that match; ``lines`` has ``content`` and any columns that place it.

    All tests are in generated code: the global test first, then a column with the folded line that all rules share.
    """
    passed = lines.where(passes_global(F.col("content"))).withColumn("_low", folded(F.col("content")))
    each = F.array(*[F.when(rule_matches(F.col("content"), r, F.col("_low")), F.lit(i)) for i, r in enumerate(rules)])
    hit = passed.withColumn("rule_no", F.explode(each)).drop("_low").where("rule_no is not null")
    return hit.join(F.broadcast(rule_table(lines.sparkSession, rules)), "rule_no")


def diff_lines(instances: DataFrame, hunks: bool = False) -> DataFrame:
    """(instance columns, file_no, path, file_status, line, block, role, content) of every line of every file of ``patch``.

    With ``hunks`` a block is a hunk, and lines before the first ``@@`` are one of their own; else they share the first one's.
    """
    from ..functions import diffs as D

    files = instances.select(*[c for c in instances.columns if c != "patch"], F.posexplode(D.files(F.col("patch"))).alias("file_no", "f"))
    own = [c for c in files.columns if c != "f"]
    lines = files.select(*own, F.col("f.path").alias("path"), F.col("f.status").alias("file_status"), F.explode((D.hunk_lines if hunks else D.block_lines)(F.col("f.diff"))).alias("l"))
    return lines.select(*own, "path", "file_status", "l.*")


def severity_rank(c: Column) -> Column:
    """Rank of a severity."""
    return F.when(c == "CRITICAL", 2).when(c == "WARNING", 1).otherwise(0)


def _ordered(column: str, sort: list[str]) -> Column:
    """Distinct values in the order of the sort columns, joined by semicolons; empty ones are left out."""
    rows = F.array_sort(F.collect_list(F.struct(*sort, column)))
    return F.array_join(F.array_distinct(F.filter(F.transform(rows, lambda r: r[column]), lambda v: v != "")), ";")


def by_instance(instances: DataFrame, matches: DataFrame, key: str = "id", sort: tuple[str, ...] = ("line", "rule_no")) -> DataFrame:
    """One row for each instance, those without matches too: flag, number, greatest severity, rules and categories in order."""
    found = matches.groupBy(key).agg(F.count(F.lit(1)).alias("matches"), F.max(severity_rank(F.col("severity"))).alias("rank"), _ordered("rule", list(sort)).alias("rules"), _ordered("category", list(sort)).alias("categories"))
    out = instances.select(key).join(found, key, "left")
    return out.select(key, F.col("matches").isNotNull().alias("flagged"), F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("rank") == 2, "CRITICAL").when(F.col("rank") == 1, "WARNING").otherwise("").alias("severity"), F.coalesce("rules", F.lit("")).alias("rules"), F.coalesce("categories", F.lit("")).alias("categories"))


def summary(by_instance: DataFrame) -> DataFrame:
    """One row: instances, flagged ones, by greatest severity, matches."""
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    out = by_instance.agg(F.count(F.lit(1)).alias("instances"), one(F.col("flagged")).alias("flagged"), one(F.col("severity") == "CRITICAL").alias("critical"), one(F.col("severity") == "WARNING").alias("warning"), F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"))
    return out.withColumn("prevalence", F.when(F.col("instances") > 0, F.col("flagged") / F.col("instances")).otherwise(0.0))


def by(matches: DataFrame, keys: list[str], instances: DataFrame, key: str = "id") -> DataFrame:
    """Distinct instances, matches, prevalence among ``instances`` and share of matches by category or rule."""
    pairs = matches.groupBy(*keys, key).agg(F.count(F.lit(1)).alias("m"))
    counts = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("instances"), F.sum("m").alias("matches"))
    total = counts.agg(F.sum("matches").alias("total"))
    all_of = instances.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    out = counts.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(all_of))  # each of one row
    return out.select(*keys, "instances", (F.col("instances") / F.col("n")).alias("prevalence"), "matches", (F.col("matches") / F.col("total")).alias("match_share"))


def hunks(matches: DataFrame, roles: DataFrame) -> DataFrame:
    """One row for each hunk with a match: its status, matches by role, flags. ``roles`` has (id, file_no, block, roles)."""
    from ..functions.diffs import hunk_status

    place = ["id", "file_no", "block"]
    n = lambda r: F.sum(F.when(F.col("role") == r, 1).otherwise(0))
    found = matches.groupBy(*place).agg(n("added").alias("added"), n("removed").alias("removed"), n("context").alias("context"))
    out = found.join(roles, place).withColumn("hunk_status", hunk_status(F.col("roles"))).drop("roles")
    return out.withColumn("deleted_only", (F.col("removed") > 0) & (F.col("added") == 0))


def hunk_roles(lines: DataFrame) -> DataFrame:
    """(id, file_no, block, roles) of every hunk."""
    return lines.groupBy("id", "file_no", "block").agg(F.collect_set("role").alias("roles"))


def removed_alone(matches: DataFrame) -> DataFrame:
    """Matches on removed lines in blocks that have none on an added line."""
    w = Window.partitionBy("id", "file_no", "block")
    return matches.withColumn("_a", F.max((F.col("role") == "added").cast("int")).over(w)).where("role = 'removed' and _a = 0").drop("_a")


def by_role(matches: DataFrame) -> dict[str, DataFrame]:
    """The matches as three tables: on added lines, on context and removed ones (``role`` tells them apart), on removed ones."""
    return {"added": matches.where("role = 'added'"), "context": matches.where("role in ('context', 'removed')"), "removed": matches.where("role = 'removed'")}


def origin(matches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Instances with matches on added lines (a), on context or removed lines (c), on both, and on one only; by keys or in all."""
    keys = keys or []
    flags = matches.groupBy(*keys, "id").agg(F.max((F.col("role") == "added").cast("int")).alias("a"), F.max((F.col("role") != "added").cast("int")).alias("c"))
    out = flags.groupBy(*keys) if keys else flags
    n = lambda e: F.coalesce(F.sum(F.expr(f"CAST({e} AS INT)")), F.lit(0))
    return out.agg(n("a = 1").alias("added"), n("c = 1").alias("context"), n("a = 1 and c = 1").alias("both"), n("a = 1 and c = 0").alias("added_only"), n("a = 0 and c = 1").alias("context_only"))


def deleted_only(matches: DataFrame) -> DataFrame:
    """Instances whose matches are all on removed lines."""
    flags = matches.groupBy("id").agg(F.max((F.col("role") != "removed").cast("int")).alias("other"), F.count(F.lit(1)).alias("matches"))
    return flags.where("other = 0").select("id", "matches")


def line_edits(matches: DataFrame) -> DataFrame:
    """Instances by edit, files that were removed aside: ``added`` if any added line matches, else ``deleted`` if a removed one does."""
    kept = matches.where("file_status != 'removed' and role in ('added', 'removed')")
    flags = kept.groupBy("id").agg(F.max((F.col("role") == "added").cast("int")).alias("a"))
    return flags.groupBy(F.when(F.col("a") == 1, "added").otherwise("deleted").alias("edit")).agg(F.count(F.lit(1)).alias("instances"))


def file_statuses(matches: DataFrame) -> DataFrame:
    """Distinct instances by status of the file, removed files aside."""
    return matches.where("file_status != 'removed'").select("file_status", "id").distinct().groupBy("file_status").agg(F.count(F.lit(1)).alias("instances"))
