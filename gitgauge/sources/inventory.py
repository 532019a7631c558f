"""Files of many repositories as tables: a listing source, and a reader for the content of chosen files.

Spark's own file sources skip names that start with an underscore (``__init__.py``, ``__tests__/``), so the listing is a
Python data source. Folders are the units of work: executors walk them, the driver sees the upper levels of folders only.
"""

import posixpath

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import paths
from ..session import task_count, written
from . import ignore_rules

SCHEMA = "repo string, path string, size bigint, modified_at timestamp"
BATCH_ROWS = 10_000
BATCH_BYTES = 32 << 20


def _open(root):
    """File system and base folder of a URI or an absolute path."""
    system, base = pafs.FileSystem.from_uri(root)
    return system, base.rstrip("/")


def _home(root):
    """As _open, with a clear error if there is no such folder."""
    system, base = _open(root)
    if system.get_file_info(base).type != pafs.FileType.Directory:
        raise FileNotFoundError(f"no folder of repositories at {root}")
    return system, base


def _children(system, folder):
    infos = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return [i for i in infos if i.type == pafs.FileType.File], [i.path for i in infos if i.type == pafs.FileType.Directory]


class Folder(InputPartition):
    """A folder to walk, or only the files directly in it."""

    def __init__(self, repo, home, folder, deep):
        self.repo, self.home, self.folder, self.deep = repo, home, folder, deep


class RepoFiles(DataSource):
    """``spark.read.format("repo_files").option("path", root)``: one row per file, content not read.

    ``root`` holds one folder per repository, or is one repository if option ``repo`` names it. Each folder ``levels``
    (default 1) below a repository is a task of its own; raise it for repositories with few and large folders. Folders whose name
    starts with a dot are not entered unless option ``hidden`` is true.
    """

    @classmethod
    def name(cls):
        return "repo_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RepoFilesReader(self.options)


class RepoFilesReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.repo, self.levels = options["path"], options.get("repo"), int(options.get("levels", 1))
        self.hidden = str(options.get("hidden", "false")).lower() == "true"

    def _entered(self, folders):
        return folders if self.hidden else [d for d in folders if not posixpath.basename(d).startswith(".")]

    def partitions(self):
        system, base = _home(self.root)
        homes = [(self.repo, base)] if self.repo else [(posixpath.basename(d), d) for d in _children(system, base)[1]]
        work, level = [], [Folder(repo, home, home, deep=False) for repo, home in homes]
        for _ in range(self.levels):
            work += level
            level = [Folder(f.repo, f.home, d, deep=False) for f in level for d in self._entered(_children(system, f.folder)[1])]
        return work + [Folder(f.repo, f.home, f.folder, deep=True) for f in level]

    def read(self, partition):
        if partition is None:  # what Spark asks for when there are no folders at all
            return
        system, _ = _open(self.root)
        todo, rows = [partition.folder], []
        while todo:
            files, folders = _children(system, todo.pop())
            for f in files:
                rows.append((partition.repo, f.path[len(partition.home) + 1:], f.size, f.mtime))
                if len(rows) == BATCH_ROWS:
                    yield self._batch(rows)
                    rows = []
            if partition.deep:
                todo += self._entered(folders)
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC")]
        names = ["repo", "path", "size", "modified_at"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def list_files(spark: SparkSession, root: str, repo=None, include_hidden=False, levels=1) -> DataFrame:
    spark.dataSource.register(RepoFiles)
    source = spark.read.format("repo_files").option("path", root).option("levels", levels).option("hidden", include_hidden)
    listed = (source.option("repo", repo) if repo else source).load()
    return listed if include_hidden else listed.filter(~paths.is_hidden())


def _listing(folders: DataFrame, root: str, single_repo=False) -> DataFrame:
    """What is directly in the folders ``(repo, path)`` below ``root``; the tasks list them."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.bool_()]
    names = ["repo", "path", "size", "modified_at", "is_folder"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def read(batches):
        system, base = _open(root)
        for each in batches:
            rows = []
            for repo, path in zip(each.column("repo").to_pylist(), each.column("path").to_pylist()):
                home = base if single_repo else f"{base}/{repo}"
                for i in system.get_file_info(pafs.FileSelector(f"{home}/{path}".rstrip("/"), allow_not_found=True)):
                    if i.type in (pafs.FileType.File, pafs.FileType.Directory):
                        rows.append((repo, i.path[len(home) + 1:], i.size, i.mtime, i.type == pafs.FileType.Directory))
                        if len(rows) == BATCH_ROWS:
                            yield batch(rows)
                            rows = []
            if rows:
                yield batch(rows)

    dealt = folders.select("repo", "path").repartition(task_count(folders), F.xxhash64("repo", "path"))
    return dealt.mapInArrow(read, SCHEMA + ", is_folder boolean")


def walk(spark: SparkSession, root: str, repo=None, include_hidden=False, ignore_name=".gitignore") -> DataFrame:
    """Files ``(repo, path, size, modified_at)`` below ``root`` that no ignore file found there hides.

    The folders of one depth are a table, the frontier. Tasks list them; the ignore files among what they find are read, folders that are
    hidden or ignored leave, and the rest is the next frontier. So nothing below a folder that does not count is ever listed, and the driver
    sees no names. One round for each level of depth; each is written, so a lost executor costs one round at most. A
    missing root is an error, an empty one gives no rows.
    """
    _home(root)
    if repo:
        frontier = spark.createDataFrame([(repo, "")], "repo string, path string")
    else:
        top = _listing(spark.createDataFrame([("", "")], "repo string, path string"), root, single_repo=True)
        frontier = top.filter("is_folder").select(F.col("path").alias("repo"), F.lit("").alias("path"))
    found, rules = None, None
    while frontier is not None:
        rows = written(_listing(frontier, root, bool(repo)), "listing")
        files = rows.filter("NOT is_folder").drop("is_folder")
        found = found.unionByName(files) if found else files
        named = files.filter(paths.basename() == ignore_name)
        n = rows.agg(F.count_if("is_folder").alias("folders"), F.count_if(~F.col("is_folder") & (paths.basename() == ignore_name)).alias("named")).first()
        if n["named"]:
            new = written(ignore_rules.ignore_files_of(read_content(named, root, bool(repo)), ignore_name), "ignore-files")
            rules = rules.unionByName(new) if rules else new
        frontier = None
        if n["folders"]:
            folders = rows.filter("is_folder")
            if not include_hidden:
                folders = folders.filter(~F.startswith(paths.basename(), F.lit(".")))
            frontier = folders.select("repo", "path")
            if rules:
                frontier = frontier.join(ignore_rules.hidden_nodes(folders.select("repo", "path", "is_folder"), rules), ["repo", "path"], "left_anti")
    listed = found if include_hidden else found.filter(~paths.is_hidden())
    return ignore_rules.apply_ignore_files(listed, rules) if rules else listed


def write_tree(files: DataFrame, root: str) -> int:
    """Writes files ``(repo, path, content)`` below a folder that all executors share, each by the task that has its row; returns their number.
    A task that runs again writes the same files again."""

    def write(batches):
        system, base = _open(root)
        for batch in batches:
            for repo, path, content in zip(*[batch.column(c).to_pylist() for c in ("repo", "path", "content")]):
                name = f"{base}/{repo}/{path}"
                system.create_dir(posixpath.dirname(name), recursive=True)
                with system.open_output_stream(name) as out:
                    out.write((content or "").encode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    system, base = _open(root)
    system.create_dir(base, recursive=True)
    return files.select("repo", "path", "content").mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def read_content(files: DataFrame, root: str, single_repo=False, partitions=None) -> DataFrame:
    """Adds ``content`` to the rows ``(repo, path)`` of files below ``root``, null for what cannot be read.

    Only the files asked for are opened, so this comes after the selection. The rows are dealt evenly over the tasks, and a
    task hands its text on in batches of limited size.
    """

    def read(batches):
        system, base = _open(root)
        for batch in batches:
            bodies, held, start = [], 0, 0
            for at, (repo, path) in enumerate(zip(batch["repo"], batch["path"]), 1):
                name = f"{base}/{path}" if single_repo else f"{base}/{repo}/{path}"
                try:
                    with system.open_input_stream(name) as stream:
                        bodies.append(stream.read().decode("utf-8", "replace"))
                    held += len(bodies[-1])
                except OSError:
                    bodies.append(None)
                if held >= BATCH_BYTES or at == len(batch):
                    yield batch.iloc[start:at].assign(content=bodies)
                    bodies, held, start = [], 0, at

    keys = files.select("repo", "path")
    dealt = keys.repartition(partitions or task_count(keys), F.xxhash64("repo", "path"))
    return dealt.mapInPandas(read, "repo string, path string, content string")
