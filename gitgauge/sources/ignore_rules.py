"""Ignore files at every folder level, applied to an inventory.

An ignore file holds for its own folder and below. Of the rules that match a path the last one decides, deeper files
win over higher ones, ``!`` takes a path back, and nothing can be taken back below an ignored folder.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text


# what a backslash makes literal, the sign that stands for it meanwhile, and the regex of the literal
_ESCAPED = [("\\\\", "\u0003", "\\\\"), ("\\*", "\u0004", "\\*"), ("\\?", "\u0005", "\\?"), ("\\[", "\u0006", "\\[")]
_CLASS = r"\[!?[^!\[\]\\/&*?][^\[\]\\/&*?]*\]"  # a glob sign within brackets is not supported


def _unescaped(body):
    """The rule without backslashes: an escaped glob sign has a stand-in, any other escaped character is itself."""
    for written, stand_in, _ in _ESCAPED:
        body = F.replace(body, F.lit(written), F.lit(stand_in))
    return F.regexp_replace(body, r"\\(.)", "$1")


def _sound(body):
    """Is every bracket of an unescaped rule closed, every range upwards, and no backslash left over at the end?"""
    ranges = F.regexp_extract_all(F.array_join(F.regexp_extract_all(body, F.lit(_CLASS), F.lit(0)), ""), F.lit(r"[^\[\]!]-[^\[\]]"), F.lit(0))
    upwards = F.forall(ranges, lambda r: F.ascii(F.substring(r, 1, 1)) <= F.ascii(F.substring(r, 3, 1)))
    return ~F.contains(F.regexp_replace(body, _CLASS, ""), F.lit("[")) & ~F.contains(body, F.lit("\\")) & upwards


def _as_regex(body):
    """Glob of one unescaped rule, without ``!`` and outer slashes, to a regex over the path below the rule's folder."""
    out = F.regexp_replace(body, r"([.+^$(){}|])", r"\\$1")
    out = F.regexp_replace(out, r"\[!", "[^")
    for glob, stand_in in (("**/", "\u0001"), ("/**", "\u0002"), ("*", "[^/]*"), ("?", "[^/]")):
        out = F.replace(out, F.lit(glob), F.lit(stand_in))
    out = F.replace(out, F.lit("\u0001"), F.lit("(?:.*/)?"))
    out = F.replace(out, F.lit("\u0002"), F.lit("/.*"))
    for _, stand_in, literal in _ESCAPED:
        out = F.replace(out, F.lit(stand_in), F.lit(literal))
    return out


def _plain(body):
    """An unescaped rule without glob signs, as the text it stands for."""
    for written, stand_in, literal in _ESCAPED:
        body = F.replace(body, F.lit(stand_in), F.lit(literal[1:]))
    return body


def _kind(body, anchored):
    """What a path must have to be worth a look, as one text: ``n:`` a last segment, ``e:`` the end of the last segment after its last
    dot, ``p:`` a whole path below the folder of the rule, ``g:`` anything (a true glob)."""
    literal = ~F.rlike(body, F.lit(r"[*?\[]"))
    ending = F.substr(body, F.lit(2))
    by_end = ~anchored & body.startswith("*.") & ~F.rlike(ending, F.lit(r"[*?\[]"))
    return (
        F.when(literal & anchored, F.concat(F.lit("p:"), _plain(body))).when(literal, F.concat(F.lit("n:"), _plain(body)))
        .when(by_end, F.concat(F.lit("e:"), F.substring_index(_plain(ending), ".", -1))).otherwise(F.lit("g:"))
    )


def parsed_rules(content):
    """Array of struct(key, ending, regex, keep, dir_only) of an ignore file, in file order. A malformed rule matches nothing."""

    def rule(line):
        t = F.rtrim(F.regexp_replace(line, r"\r$", ""))
        keep = t.startswith("!")
        t = F.when(keep, F.substr(t, F.lit(2))).otherwise(t)
        dir_only = t.endswith("/")
        body = F.regexp_replace(t, "/+$", "")
        anywhere = F.regexp_replace(body, r"^/?\*\*/(?=[^/]+$)", "")  # **/name is name
        anchored = F.contains(anywhere, F.lit("/"))
        body = _unescaped(F.regexp_replace(anywhere, "^/+", ""))
        start = F.when(anchored, F.lit("^")).otherwise(F.lit("^(?:.*/)?"))
        return F.struct(_kind(body, anchored).alias("key"), _plain(F.substr(body, F.lit(2))).alias("ending"),
                        F.concat(start, _as_regex(body), F.lit("$")).alias("regex"), keep.alias("keep"),
                        dir_only.alias("dir_only"), ((F.length(body) > 0) & _sound(body)).alias("real"))

    written = F.filter(text.lines_of(content), lambda x: (F.length(text.trimmed(x)) > 0) & ~x.startswith("#"))
    return F.filter(F.transform(written, rule), lambda r: r.real)


def ignore_files_of(contents: DataFrame, name=".gitignore") -> DataFrame:
    """``(repo, folder, content)`` of the ignore files among ``contents(repo, path, content)``."""
    folder = paths.dirname()
    found = contents.filter((paths.basename() == name) & F.col("content").isNotNull())
    return found.select("repo", F.when(folder == ".", F.lit("")).otherwise(folder).alias("folder"), "content")


def _above(path):
    """All folders above a path, the root as ''."""
    segments = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"))


def hidden_nodes(nodes: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """(repo, path) of the nodes ``(repo, path, is_folder)`` that the rules hide, each judged by itself.

    Rules are rows under the key that a path must have: a literal name, the end of a name, or a whole path. Paths bring their keys, so
    rules and paths meet by one equi-join on (repo, folder of the rule, key); only true globs are tried as patterns on all that
    is below their folder. The rule that decides is a maximum.
    """
    rules = ignore_files.select("repo", "folder", F.posexplode(parsed_rules("content")).alias("at", "rule")).select(
        "repo", "folder", "at", "rule.*").drop("real")
    last = F.substring_index("path", "/", -1)
    below = F.when(F.col("folder") == "", F.col("path")).otherwise(F.substr("path", F.length("folder") + 2))
    keys = F.array(F.concat(F.lit("n:"), last), F.concat(F.lit("e:"), F.substring_index(last, ".", -1)), F.concat(F.lit("p:"), F.col("below")), F.lit("g:"))
    reached = (
        nodes.withColumn("folder", F.explode(_above(F.col("path"))))
        .join(rules.select("repo", "folder").distinct(), ["repo", "folder"], "left_semi")
        .withColumn("below", below).withColumn("key", F.explode(keys))
    )
    kind = F.left("key", F.lit(2))
    fits = F.when(kind == "g:", F.rlike("below", F.col("regex"))).when(kind == "e:", F.endswith("below", F.col("ending"))).otherwise(True)
    judged = (
        reached.join(rules, ["repo", "folder", "key"]).filter((~F.col("dir_only") | F.col("is_folder")) & fits)
        .groupBy("repo", "path").agg(F.max(F.struct(F.length("folder").alias("deep"), "at", (~F.col("keep")).alias("hide"))).alias("v"))
    )
    return judged.filter("v.hide").select("repo", "path")


def apply_ignore_files(files: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """Files that no rule of ``ignore_files(repo, folder, content)`` hides, nor any folder above them; ``folder`` is ``''`` at the root.
    Each folder is judged once, whatever is in it."""
    folders = files.select("repo", F.explode(_above(F.col("path"))).alias("path")).filter("path <> ''").distinct().withColumn("is_folder", F.lit(True))
    nodes = folders.unionByName(files.select("repo", "path", F.lit(False).alias("is_folder")))
    hidden = hidden_nodes(nodes, ignore_files).withColumnRenamed("path", "gone")
    ways = files.select("repo", "path", F.explode(F.concat(_above(F.col("path")), F.array("path"))).alias("gone"))
    return files.join(ways.join(hidden, ["repo", "gone"]).select("repo", "path").distinct(), ["repo", "path"], "left_anti")
