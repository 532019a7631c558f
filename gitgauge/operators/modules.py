"""Import graph of code: what each file imports, which file of its repository that is, and which packages lie outside.

``files(repo, path, content)``. Imports are found by patterns of the file's language. Each becomes a short ranked list of paths it could mean
(the path itself, with an extension, an index file or package file in it, below a source root); the lists meet the paths of the
repository by one equi-join on (repo, path), and the best rank that is there wins. A popular file is one row on its side of the join,
so nothing is paired within a group.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from . import links

# Extensions and index files that a specifier may leave out, in order of preference, and source roots.
SCRIPT_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
MODULE_ENDINGS = [".py", "/__init__.py"]
MODULE_ROOTS = ["", "src/", "lib/"]
CLASS_ENDINGS = [".java", ".kt"]
CLASS_ROOTS = ["src/main/java/", "src/main/kotlin/", "src/", ""]

_SCRIPT = r"""\b(?:from\s*|import\s*\(?\s*|require\s*\(\s*)(?:'([^'\n]+)'|"([^"\n]+)")"""
_PY_FROM = r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+(?:\(\s*)?([\w.*][\w.*, \t]*(?:\n[ \t]+[\w, \t]+)*)"
_PY_IMPORT = r"(?m)^[ \t]*import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*)[ \t]*(?:#.*|;.*)?\r?$"
_GO_BLOCK = r"(?m)^import[ \t]*\(([^)]*)\)"
_GO_LINE = r'(?m)^import[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)"'
_CLASS = r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)"


def _all(pattern, group=1, column="content"):
    return F.regexp_extract_all(F.col(column) if isinstance(column, str) else column, F.lit(pattern), F.lit(group))


def _named(specs, kind):
    """Array of (kind, spec, name) for imports that name no part."""
    return F.transform(specs, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("spec"), F.lit("").alias("name")))


def _imports():
    """All imports of a file as an array of (kind, spec, name), by its language."""
    language = F.lower(paths.language())
    script = _named(F.concat(_all(_SCRIPT, 1), _all(_SCRIPT, 2)), "script")
    parts = F.transform(F.arrays_zip(_all(_PY_FROM, 1).alias("spec"), _all(_PY_FROM, 2).alias("names")), lambda z: F.transform(
        F.split(z["names"], r"\s*,\s*"), lambda n: F.struct(
            F.lit("module").alias("kind"), z["spec"].alias("spec"), F.regexp_extract(n, r"^\s*(\w*)", 1).alias("name"))))
    whole = F.transform(F.flatten(F.transform(_all(_PY_IMPORT), lambda x: F.split(x, r"[ \t]*,[ \t]*"))), lambda s: F.regexp_extract(s, r"^\s*([\w.]+)", 1))
    go = F.concat(F.flatten(F.transform(_all(_GO_BLOCK), lambda b: F.regexp_extract_all(b, F.lit(r'"([^"\n]+)"'), F.lit(1)))), _all(_GO_LINE))
    return (
        F.when(F.rlike(language, F.lit("^(typescript|javascript)")), script).when(language == "python", F.concat(F.flatten(parts), _named(whole, "module")))
        .when(language == "go", _named(go, "folder")).when(language.isin("java", "kotlin"), _named(_all(_CLASS), "class"))
    )


def module_imports(files: DataFrame) -> DataFrame:
    """(repo, source, kind, spec, name): each import of each file once, as written; ``name`` is what a Python ``from`` takes out of it."""
    found = files.filter(F.col("content").isNotNull()).select("repo", F.col("path").alias("source"), F.explode(F.array_distinct(_imports())).alias("i"))
    return found.select("repo", "source", "i.*").filter("spec <> ''").distinct()


def _walked(source, target):
    """The path that ``target`` leads to from the folder of ``source``; null if it leaves the repository."""
    steps = F.split(F.concat(F.regexp_extract(source, r"^(.*/)?[^/]*$", 1), target), "/")
    out = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda acc, s: F.when(acc.isNull() | s.isin("", "."), acc)
        .when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))))
        .otherwise(F.array_append(acc, s)))
    return F.array_join(out, "/")


def _with(bases, endings):
    """Every base with every ending, in order of preference."""
    return F.flatten(F.transform(bases, lambda b: F.array(*[F.concat(b, F.lit(e)) for e in endings])))


def _candidates():
    """Ranked paths that an import may mean; empty for one that can only lie outside."""
    spec, name, source = F.col("spec"), F.col("name"), F.col("source")
    inside = F.rlike(spec, F.lit(r"^\.{0,2}/|^\.{1,2}$"))
    local = F.when(spec.startswith("/"), F.substr(spec, F.lit(2))).when(spec.startswith("@/"), F.concat(F.lit("src/"), F.substr(spec, F.lit(3)))).otherwise(
        _walked(source, spec))
    swapped = F.regexp_replace(local, r"\.([mc]?)js(x?)$", ".$1ts$2")  # what is compiled to this name
    script = F.when(inside | spec.startswith("@/"), F.concat(_with(F.array(local), SCRIPT_ENDINGS), F.array(swapped))).otherwise(F.array().cast("array<string>"))
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    tail = F.replace(F.substr(spec, dots + 1), F.lit("."), F.lit("/"))
    start = F.concat(F.lit("./"), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), tail)
    roots = F.when(dots > 0, F.array(_walked(source, start))).otherwise(F.array(*[F.concat(F.lit(r), tail) for r in MODULE_ROOTS]))
    part = F.transform(roots, lambda r: F.concat(r, F.when(r == "", "").otherwise("/"), name))
    module = F.concat(F.when(name == "", F.array().cast("array<string>")).otherwise(_with(part, MODULE_ENDINGS)), _with(roots, MODULE_ENDINGS))
    of_class = _with(F.array(*[F.concat(F.lit(r), F.replace(spec, F.lit("."), F.lit("/"))) for r in CLASS_ROOTS]), CLASS_ENDINGS)
    kind = F.col("kind")
    return F.when(kind == "script", script).when(kind == "module", module).when(kind == "class", of_class).otherwise(F.array().cast("array<string>"))


def package():
    """The package an import that is no file belongs to; null for one that points into the repository and misses."""
    spec, kind = F.col("spec"), F.col("kind")
    script = F.when(~F.rlike(spec, F.lit(r"^\.{0,2}/|^\.{1,2}$|^@/")), links.package_name(F.regexp_replace(spec, "^node:", "")))
    module = F.when(~spec.startswith("."), F.substring_index(spec, ".", 1))
    folder = F.when(F.rlike(spec, F.lit(r"^[^/]*\.[^/]*/")), F.substring_index(spec, "/", 3)).otherwise(spec)
    return F.when(kind == "script", script).when(kind == "module", module).when(kind == "folder", folder).otherwise(F.substring_index(spec, ".", 2))


def module_graph(files: DataFrame) -> DataFrame:
    """(repo, source, spec, name, target, package): each import with the file of the same repository it means, or the package it comes from,
    or neither if it points to a file that is not there."""
    imports = module_imports(files)
    tried = imports.select("repo", "source", "kind", "spec", "name", F.posexplode(_candidates()).alias("rank", "target")).filter(F.length("target") > 0)
    there = files.select("repo", F.col("path").alias("target")).distinct()
    hits = tried.join(there, ["repo", "target"]).filter("target <> source")
    best = hits.groupBy("repo", "source", "kind", "spec", "name").agg(F.min(F.struct("rank", "target")).alias("best"))
    keys = ["repo", "source", "kind", "spec", "name"]
    return imports.join(best, keys, "left").select(
        "repo", "source", "spec", "name", F.col("best.target").alias("target"), F.when(F.col("best.target").isNull(), package()).alias("package"))


def module_packages(graph: DataFrame) -> DataFrame:
    """(repo, package, n_files): how many files of a repository use each package from outside."""
    return graph.filter(F.col("package").isNotNull()).select("repo", "package", "source").distinct().groupBy("repo", "package").agg(
        F.count(F.lit(1)).alias("n_files"))


def module_users(graph: DataFrame) -> DataFrame:
    """(repo, path, n_files): how many files import each file."""
    return graph.filter(F.col("target").isNotNull()).select("repo", F.col("target").alias("path"), "source").distinct().groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("n_files"))
