"""Column functions on POSIX paths: parts, ancestors, scopes and surfaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# Names, directories and suffixes that decide what belongs to a package of instructions.
DEFINITION = "skill.md"
ASSET_DIRS = ["assets", "artifacts", "config", "configs", "examples", "references", "schemas", "scripts", "templates"]
ASSET_SUFFIXES = [".css", ".env.example", ".go", ".html", ".js", ".json", ".jsx", ".md", ".mdx", ".py", ".rb", ".rs", ".sh", ".toml", ".ts", ".tsx", ".txt", ".yaml", ".yml"]
BINARY_SUFFIXES = [".gif", ".jpeg", ".jpg", ".pdf", ".png", ".tgz", ".webp", ".zip"]
MAINTENANCE_ROOTS = [".claude", ".claude-plugin", ".github", ".opencode", ".vscode", "docs", "eval", "scripts", "src", "tests"]
MAINTENANCE_FILES = [".gitignore", "changelog.md", "contributing.md", "license", "license.md", "marketplace.json", "package-lock.json", "package.json", "plugin.json", "pyproject.toml", "readme.md", "security.md", "uv.lock"]
# Directories, names and suffixes of the surfaces, and the order in which surfaces are shown.
SURFACE_DIRS = {
    "agents/": ["agents"],
    "scripts": ["bin", "script", "scripts", "tool", "tools"],
    "references": ["docs", "documentation", "knowledge", "reference", "references", "rules"],
    "assets": ["asset", "assets", "canvas-fonts", "fonts", "images", "media", "public", "resource", "resources", "static", "template", "templates", "theme-factory", "themes"],
    "configuration": [".github", "config", "configs", "hooks"],
    "examples": ["demo", "demos", "evals", "example", "examples", "sample", "samples", "test", "tests"],
}
SURFACE_FILES = {"SKILL.md": "skill.md", "README.md": "readme.md", "LICENSE.txt": "license.txt", "AGENTS.md": "agents.md"}
SCRIPT_SUFFIXES = [".cjs", ".go", ".js", ".jsx", ".mjs", ".py", ".rb", ".sh", ".ts", ".tsx"]
PICTURE_SUFFIXES = [".avif", ".css", ".gif", ".jpeg", ".jpg", ".otf", ".png", ".svg", ".ttf", ".webp", ".woff", ".woff2"]
CONFIG_NAMES = [".gitignore", "config.json", "metadata.json", "package-lock.json", "package.json", "pyproject.toml", "requirements.txt", "uv.lock"]
CONFIG_SUFFIXES = [".json", ".toml", ".yaml", ".yml"]
SURFACES = ["SKILL.md", "README.md", "LICENSE.txt", "AGENTS.md", "agents/", "scripts", "references", "assets", "configuration", "examples", "additional files", "additional directories"]
COMPANIONS = ["visual-companion.md", "spec-document-reviewer-prompt.md", "plan-document-reviewer-prompt.md", "code-quality-reviewer-prompt.md", "implementer-prompt.md", "anthropic-best-practices.md", "AGENTS.md"]


def parts(path: Column) -> Column:
    """Parts of a relative path; empty ones and ``.`` don't count."""
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def name(path: Column) -> Column:
    """Last part, or ``''``."""
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def parent(path: Column) -> Column:
    """Path without its last part; ``.`` if none is left."""
    p = parts(path)
    return F.when(F.size(p) < 2, ".").otherwise(F.array_join(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), "/"))


def suffix(of_name: Column) -> Column:
    """Suffix of a name with its dot; none for names that start or end with their only dot."""
    return F.regexp_extract(of_name, r"(?s)^.+(\.[^.]+)$", 1)


def ancestors(path: Column) -> Column:
    """The path itself and all directories above it, the shortest first."""
    p = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, 1, i), "/"))


def is_definition(path: Column) -> Column:
    """Whether a path names a definition file, in any case."""
    return F.lower(name(path)) == DEFINITION


def is_maintenance(path: Column) -> Column:
    """Whether a path belongs to the repository itself: by its first directory, or as a lone file; so does an empty one."""
    p = parts(path)
    first = F.lower(F.coalesce(F.try_element_at(p, F.lit(1)), F.lit("")))
    return (F.size(p) == 0) | first.isin(MAINTENANCE_ROOTS) | ((F.size(p) == 1) & first.isin(MAINTENANCE_FILES))


def under(path: Column, root: Column) -> Column:
    """Whether a path is a root or below it; everything is below ``.``."""
    return (root == ".") | (path == root) | path.startswith(F.concat(root, F.lit("/")))


def is_asset(path: Column, roots: Column) -> Column:
    """Whether a path belongs to a package whose root is among ``roots`` or which lies below ``skills/``."""
    clean = F.array_join(parts(path), "/")
    p, last = parts(path), F.lower(name(path))
    known = F.exists(roots, lambda r: under(clean, r)) | ((F.size(p) >= 3) & (F.lower(F.try_element_at(p, F.lit(1))) == "skills"))
    inside = F.exists(p, lambda x: F.lower(x).isin(ASSET_DIRS))
    ends = F.lit(False)
    for s in ASSET_SUFFIXES:
        ends = ends | F.lower(clean).endswith(s)
    return F.when(is_maintenance(path), False).when(last == DEFINITION, True).when(suffix(last).isin(BINARY_SUFFIXES), False).when(~known, False).otherwise(inside | ends)


def _directory_surface(d: Column) -> Column:
    out = F.when(F.lit(False), "")
    for surface, names in SURFACE_DIRS.items():
        out = out.when(F.lower(d).isin(names), surface)
    return out


def surface(path: Column) -> Column:
    """Surface of a path relative to its package's root."""
    p = parts(path)
    low = F.lower(name(path))
    root = F.when(F.lit(False), "")
    for s, n in SURFACE_FILES.items():
        root = root.when(low == n, s)
    root = root.when(low.isin(CONFIG_NAMES) | suffix(low).isin(CONFIG_SUFFIXES), "configuration")
    root = root.when(low.contains("example") | low.startswith("demo") | low.startswith("sample") | low.startswith("test-"), "examples")
    root = root.when(low.contains("reference"), "references").when(suffix(low).isin(PICTURE_SUFFIXES), "assets").when(suffix(low).isin(SCRIPT_SUFFIXES), "scripts")
    first, second = F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(2))
    below = F.coalesce(_directory_surface(first), F.when(F.size(p) > 2, _directory_surface(second)), F.lit("additional directories"))
    return F.when(F.size(p) == 0, "additional files").when(low == DEFINITION, "SKILL.md").when(F.size(p) == 1, F.coalesce(root, F.lit("additional files"))).otherwise(below)


def skill_dirs(paths: Column) -> Column:
    """Directories of the definition files (in their exact spelling) among paths."""
    cut = lambda p: F.regexp_replace(p, r"(?s)/?[^/]*$", "")
    return F.array_distinct(F.transform(F.filter(paths, lambda p: F.element_at(F.split(p, "/"), -1) == "SKILL.md"), cut))


def file_roots(paths: Column) -> Column:
    """For each path the longest definition directory above it, else its own directory."""

    def root(p: Column, dirs: Column) -> Column:
        fits = F.filter(dirs, lambda d: (d == "") | p.startswith(F.concat(d, F.lit("/"))))
        best = F.aggregate(fits, F.lit(None).cast("string"), lambda a, d: F.when(a.isNull() | (F.length(d) > F.length(a)), d).otherwise(a))
        return F.coalesce(best, F.regexp_replace(p, r"(?s)/?[^/]*$", ""))

    return bound(paths, lambda every: bound(skill_dirs(every), lambda dirs: F.transform(every, lambda p: root(p, dirs))))


def skill_roots(paths: Column) -> Column:
    """Distinct roots that a change touches; files at the top count as ``(root)`` if it holds no definition file."""

    def roots(every: Column) -> Column:
        none = F.size(skill_dirs(every)) == 0
        named = F.transform(file_roots(every), lambda r: F.when(none & (r == ""), "(root)").otherwise(r))
        return F.array_distinct(F.filter(named, lambda r: r != ""))

    return bound(paths, roots)


def file_relatives(paths: Column) -> Column:
    """Each path relative to its root."""
    below = lambda p, r: F.when((r != "") & p.startswith(F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, F.length(p))).otherwise(p)
    return bound(paths, lambda every: F.zip_with(every, file_roots(every), below))
