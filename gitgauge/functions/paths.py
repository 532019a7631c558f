"""Path expressions: parts of a path, language, relevance score. All are built-in column expressions."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------
ALWAYS_INCLUDE = [
    "README.md", "README.mdx", "package.json", "pyproject.toml", "Cargo.toml", "go.mod",
    "CLAUDE.md", ".cursorrules", ".windsurfrules",
]
LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TypeScript React", ".js": "JavaScript", ".jsx": "JavaScript React",
    ".mjs": "JavaScript (ESM)", ".cjs": "JavaScript (CJS)", ".py": "Python", ".rs": "Rust", ".go": "Go",
    ".java": "Java", ".kt": "Kotlin", ".swift": "Swift", ".rb": "Ruby", ".php": "PHP", ".cs": "C#",
    ".cpp": "C++", ".c": "C", ".h": "C/C++ Header", ".md": "Markdown", ".mdx": "MDX", ".json": "JSON",
    ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML", ".graphql": "GraphQL", ".gql": "GraphQL",
    ".prisma": "Prisma", ".sql": "SQL",
}
SUPPORTED_EXTENSIONS = list(LANGUAGES)
ENTRY_POINTS = ["index", "main", "app", "server", "cli", "index.ts", "main.ts", "app.ts", "server.ts"]
BUSINESS_WORDS = [
    "contract", "protocol", "hook", "service", "api", "game", "bet", "flip", "payment", "auth", "wallet",
]
VALUED_DIRS = ["/hooks", "/services", "/lib", "/api", "/contracts", "/components"]
ROLE_MARKS = [
    ".controller.", ".service.", ".resolver.", ".dto.", ".guard.", ".middleware.", ".decorator.",
    ".filter.", ".pipe.", ".interceptor.", ".entity.", ".model.",
]
SOURCE_EXTENSIONS = [
    "ts", "js", "tsx", "jsx", "py", "go", "rs", "java", "c", "cpp", "h", "hpp", "rb", "php", "swift",
    "kt", "cs", "scala", "r", "m", "sh", "bash", "sql", "graphql", "proto", "vue", "svelte",
]
CHURN_FREE_NAMES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "Gemfile.lock", "poetry.lock",
    "CLAUDE.md", ".cursorrules", ".windsurfrules",
]
# --- end of fixed values ------------------------------------------------------------------------

TOOL_DIR = ".gitgauge"
IGNORED_SEGMENTS = [".git", TOOL_DIR, "gitgauge"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _contains_any(text, words) -> Column:
    """Plain substring tests; several times faster than one regex of alternatives."""
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def basename(path="path") -> Column:
    return F.substring_index(_col(path), "/", -1)


def dirname(path="path", base=None) -> Column:
    """Folder part; ``.`` for a file at the root."""
    p = _col(path)
    base = basename(p) if base is None else base
    cut = F.length(p) - F.length(base) - 1
    return F.when(cut < 0, F.lit(".")).otherwise(F.left(p, cut))


def _without_suffix(base) -> Column:
    """Length of the base name before its last dot; the whole length if there is no dot behind the first character."""
    before = F.length(base) - F.length(F.substring_index(base, ".", -1)) - 1
    return F.when(before > 0, before).otherwise(F.length(base))


def extension(path="path") -> Column:
    """Last dot suffix of the base name; a leading dot is part of the name and starts no extension."""
    base = basename(path)
    return F.substr(base, _without_suffix(base) + 1)


def stem(base) -> Column:
    return F.left(base, _without_suffix(base))


def language(path="path") -> Column:
    """Language of the lowercased extension, ``Unknown`` if it is not in the table."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(extension(path))), F.lit("Unknown"))


def is_hidden(path="path") -> Column:
    """Any segment starts with a dot."""
    p = _col(path)
    return p.startswith(".") | F.contains(p, F.lit("/."))


def is_supported(path="path") -> Column:
    """Known extension (case matters here, unlike in ``language``) or a name that is always kept.

    Same as testing ``extension``, but cheap for the many files that do not end in a known one.
    """
    p = _col(path)
    last = F.substring_index(p, ".", -1)
    known = last.isin([e[1:] for e in SUPPORTED_EXTENSIONS]) & (last != p) & (basename(p) != F.concat(F.lit("."), last))
    return known | basename(p).isin(ALWAYS_INCLUDE)


def has_segment(segments, path="path") -> Column:
    wrapped = F.concat(F.lit("/"), _col(path), F.lit("/"))
    return _contains_any(wrapped, [f"/{s}/" for s in segments])


def is_source(path="path") -> Column:
    return _col(path).rlike(r"\.(" + "|".join(SOURCE_EXTENSIONS) + r")$")


def is_churn_free(path="path", tool_dir=TOOL_DIR) -> Column:
    """Files that change often for no bad reason: lock files, agent files, markdown, the tool's own folder."""
    p = _col(path)
    return basename(p).isin(CHURN_FREE_NAMES) | p.endswith(".md") | p.startswith(tool_dir + "/")


def relevance(path="path", base="base", folder="folder") -> Column:
    """Additive score from the path, its base name and its folder, which the caller computes once as columns.

    The marks are substring tests on purpose: ``test`` also hits ``latest``.
    """
    path, base, folder = _col(path), _col(base), _col(folder)

    def points(condition, value):
        return F.when(condition, F.lit(float(value))).otherwise(F.lit(0.0))

    depth = F.when(folder == ".", F.lit(0)).otherwise(F.length(folder) - F.length(F.replace(folder, F.lit("/"))) + 1)
    return (
        points(base.isin(ALWAYS_INCLUDE) & (~base.isin("README.md", "README.mdx") | (folder == ".")), 100)
        + points(_contains_any(F.lower(path), BUSINESS_WORDS), 60)
        + points(_contains_any(folder, VALUED_DIRS), 40)
        + points(stem(base).isin(ENTRY_POINTS) | base.isin(ENTRY_POINTS), 50)
        + points(_contains_any(base, [".config.", ".setup."]), 30)
        - depth * F.lit(1.5)
        - points(_contains_any(base, [".test.", ".spec."]) | _contains_any(folder, ["__tests__", "test"]), 10)
    )


def has_role_mark(path="path") -> Column:
    return _contains_any(F.lower(_col(path)), ROLE_MARKS)
