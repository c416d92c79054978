"""Project directory trees to the ``files`` table.

Spark's file sources hide names that start with a dot or an underscore, so trees are
listed and read on the executors. Store the result as Parquet and scan that.
"""

from __future__ import annotations

import ctypes
import json
import os
import sys
import time
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from faultlens.functions import paths
from faultlens.functions.paths import IGNORED_DIRS
from faultlens.operators import codelines
from faultlens.schemas import FILES

# Executors get these functions by value, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ENTRY = "project string, root string, path string, is_dir boolean, size long, in_core boolean"
_COLUMNS = ["project", "root", "path", "is_dir", "size", "in_core"]
BATCH_BYTES = 16 * 1024 * 1024
#: Directories that planning finds for each task, and those it lists for that at most.
DIRS_PER_TASK, LISTINGS_PER_TASK = 4, 16
#: Buckets that files are dealt to, the files of trees that lie on disk at once, and the batches that these make.
TREE_BUCKETS, FILES_AT_ONCE, BATCHES_AT_ONCE = 256, 200_000, 3
#: Entries of a batch that a walk sends, paths of a list of spares, and directories that a task remembers to have made.
ENTRIES, SPARES, DIRS_KNOWN = 10_000, 1000, 10_000
AT_FDCWD, RENAME_NOREPLACE = -100, 1
CORE_MARKER = os.path.join("core", "CodeIgniter.php")


def _entries(root: str, rel: str, core: bool, deep: bool) -> Iterator[tuple[str, bool, int, bool]]:
    """Entries below ``root/rel``; directories that cannot be read are skipped.

    The last item says whether the entry lies in (or is) a vendored framework core.
    """
    if "://" in root:
        yield from _remote_entries(root, rel, core, deep)
        return
    stack = [(rel, core)]
    while stack:
        here, in_core = stack.pop()
        try:
            with os.scandir(os.path.join(root, here)) as found:
                children = list(found)
        except OSError:
            continue
        for child in children:
            path = f"{here}/{child.name}" if here else child.name
            is_dir = child.is_dir(follow_symlinks=False)
            if is_dir and child.name in IGNORED_DIRS:
                continue
            try:
                size = 0 if is_dir else child.stat().st_size
            except OSError:
                continue
            below_core = in_core or (
                is_dir
                and child.name.lower() == "system"
                and os.path.exists(os.path.join(root, path, CORE_MARKER))
            )
            yield path, is_dir, size, below_core
            if is_dir and deep:
                stack.append((path, below_core))


def _remote_entries(root: str, rel: str, core: bool, deep: bool) -> Iterator[tuple[str, bool, int, bool]]:
    """The same for a root that is a URI, by the file system that its scheme names."""
    store, base = fs.FileSystem.from_uri(root)
    stack = [(rel, core)]
    while stack:
        here, in_core = stack.pop()
        try:
            children = store.get_file_info(fs.FileSelector(f"{base}/{here}" if here else base))
        except OSError:
            continue
        for child in children:
            path = f"{here}/{child.base_name}" if here else child.base_name
            is_dir = child.type == fs.FileType.Directory
            if is_dir and child.base_name in IGNORED_DIRS:
                continue
            below_core = in_core or (
                is_dir
                and child.base_name.lower() == "system"
                and store.get_file_info(f"{base}/{path}/{CORE_MARKER}").type == fs.FileType.File
            )
            yield path, is_dir, 0 if is_dir else child.size, below_core
            if is_dir and deep:
                stack.append((path, below_core))


def _bytes(root: str, path: str) -> bytes:
    if "://" in root:
        store, base = fs.FileSystem.from_uri(root)
        with store.open_input_stream(f"{base}/{path}") as f:
            return f.read()
    with open(os.path.join(root, path), "rb") as f:
        return f.read()


def _list(deep: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows = []
                for entry in _entries(row.root, row.path, row.in_core, deep):
                    rows.append((row.project, row.root, *entry))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=_COLUMNS)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


def _read(max_bytes: int | None):
    """Contents in batches of bounded size; a file over a limit that is set keeps an empty content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["project", "path", "is_dir", "size", "content", "in_core"]
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False):
                content = None
                if not row.is_dir:
                    content = ""
                    if max_bytes is None or row.size <= max_bytes:
                        try:
                            content = _bytes(row.root, row.path).decode("utf-8", "replace")
                        except OSError:
                            continue
                rows.append((row.project, row.path, row.is_dir, row.size, content, row.in_core))
                held += len(content or "")
                if held > BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return run


def _uri(root: str) -> str:
    """The root with the two slashes that Hadoop leaves out of ``file:/`` paths."""
    return f"file://{root[5:]}" if root.startswith("file:/") and not root.startswith("file://") else root


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_COLUMNS)


class TreePart(InputPartition):
    """Directories that one task lists: ``(project, root, path, in_core, deep)`` each."""

    def __init__(self, dirs: list[tuple[str, str, str, bool, bool]]):
        self.dirs = dirs


def plan_walk(roots: list[tuple[str, str]], tasks: int) -> list[TreePart]:
    """The walk of some roots, dealt to tasks.

    Directories are opened breadth-first until there are enough of them, wherever in the
    tree they branch; those opened are listed alone, the rest with all below. Only
    directories are held, and their number depends on ``tasks`` and not on the trees, but
    for the children of the last one opened.
    """
    waiting = deque((project, root, "", False) for project, root in roots)
    opened = []
    while waiting and len(waiting) < DIRS_PER_TASK * tasks and len(opened) < LISTINGS_PER_TASK * tasks:
        project, root, path, core = here = waiting.popleft()
        opened.append((*here, False))
        waiting.extend((project, root, p, c) for p, is_dir, _, c in _entries(root, path, core, False) if is_dir)
    units = [(*unit, True) for unit in waiting] + opened
    return [TreePart(units[i::tasks]) for i in range(max(1, min(tasks, len(units))))]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [tuple(r) for r in json.loads(options["roots"])]
        self.tasks = int(options["tasks"])

    def partitions(self) -> list[TreePart]:
        return plan_walk(self.roots, self.tasks)

    def read(self, partition: TreePart) -> Iterator[pa.RecordBatch]:
        rows = []
        for project, root, path, core, deep in partition.dirs:
            for entry in _entries(root, path, core, deep):
                rows.append((project, root, *entry))
                if len(rows) == ENTRIES:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


class TreeSource(DataSource):
    """Entries of the trees in the option ``roots``, a JSON list of ``[project, root]``."""

    @classmethod
    def name(cls) -> str:
        return "project_tree"

    def schema(self) -> str:
        return _ENTRY

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def walk(spark: SparkSession, roots: list[tuple[str, str]], tasks: int | None = None) -> DataFrame:
    """Entries of a few trees, however deep they branch; see ``list_tree`` for tables of many.

    The driver opens the first directories; roots are on storage that all nodes see.
    """
    spark.dataSource.register(TreeSource)
    options = {"roots": json.dumps([(project, _uri(root)) for project, root in roots]), "tasks": str(tasks or spark.sparkContext.defaultParallelism)}
    return spark.read.format(TreeSource.name()).options(**options).load()


def list_tree(projects: DataFrame, tasks: int | None = None) -> DataFrame:
    """Entries of every project in ``projects(project, root)``.

    Listing fans out twice: the roots are listed one level deep, then every directory
    found there becomes a unit of work, spread over ``tasks``. Roots are on storage that
    all executors see.
    """
    n = tasks or projects.sparkSession.sparkContext.defaultParallelism
    start = projects.select(
        "project", "root", F.lit("").alias("path"), F.lit(False).alias("in_core")
    )
    top = start.repartition(n).mapInPandas(_list(False), _ENTRY)
    below = (
        top.where("is_dir")
        .select("project", "root", "path", "in_core")
        .repartition(n)
        .mapInPandas(_list(True), _ENTRY)
    )
    return top.unionByName(below)


def read_trees(projects: DataFrame, max_bytes: int | None = None, tasks: int | None = None) -> DataFrame:
    """The ``files`` table of many projects; contents are read where the rows are.

    Where ``max_bytes`` is set, larger files appear with their size only.
    """
    n = tasks or projects.sparkSession.sparkContext.defaultParallelism
    return list_tree(projects, tasks).repartition(n).mapInPandas(_read(max_bytes), FILES)


def read_tree(spark: SparkSession, root: str, project: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """One project, spread over all tasks wherever it branches; a missing root is an error."""
    if "://" not in root and not os.path.isdir(root):
        raise FileNotFoundError(root)
    name = project or os.path.basename(os.path.abspath(root))
    entries = walk(spark, [(name, root)])
    return entries.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_read(max_bytes), FILES)


def _store(base: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base)


class Spares:
    """Files or directories of trees that are done with, as lists of paths in a folder.

    File systems may search long for the place of a new file where many were removed a moment
    before, so trees that follow each other take over the files and directories of those before.
    The task that renames a list has it for itself. The newest goes first, as what it names may
    not have gone to the disk yet; what tasks leave of a list goes last.
    """

    def __init__(self, folder: str | None, kind: str):
        self.folder, self.kind, self.paths, self.lists, self.asked = folder, kind, [], [], 0

    def more(self) -> bool:
        """Take a list. Where there was none, the folder is not looked into each time."""
        if not self.folder:
            return False
        if not self.lists:
            self.asked += 1
            if self.asked % SPARES == 1:
                self.lists = sorted(name for name in os.listdir(self.folder) if name.endswith(self.kind))
        while self.lists:
            mine = f"{self.folder}/{uuid.uuid4().hex}"
            try:
                os.rename(f"{self.folder}/{self.lists.pop()}", mine)
            except FileNotFoundError:
                continue
            with open(mine, "rb") as f:
                self.paths = f.read().split(b"\0")[::-1]
            os.unlink(mine)
            return True
        return False

    def take(self) -> bytes | None:
        return self.paths.pop() if self.paths or self.more() else None

    def leave(self, paths: list[bytes], name: str = "") -> None:
        for i in range(0, len(paths), SPARES):
            mine = f"{self.folder}/-{uuid.uuid4().hex}"
            with open(mine, "wb") as f:
                f.write(b"\0".join(paths[i : i + SPARES]))
            os.rename(mine, f"{self.folder}/{name}-{i}{self.kind}" if name else mine + self.kind)


def _move_dir(old: bytes, new: bytes) -> bool:
    """Rename a directory unless there is one; os.rename would replace one that is empty."""
    return ctypes.CDLL(None).renameat2(AT_FDCWD, old, AT_FDCWD, new, RENAME_NOREPLACE) == 0


def _can_spare(folder: str) -> bool:
    """Whether files and directories in a folder can be taken over as ``LocalTree`` does."""
    one, two = (f"{folder}/{uuid.uuid4().hex}" for _ in range(2))
    try:
        os.mkdir(one)
        if not _move_dir(one.encode(), two.encode()):
            return False
        open(f"{two}/a", "w").close()
        os.link(f"{two}/a", f"{two}/b")
        return True
    except (OSError, AttributeError, TypeError):
        return False


class LocalTree:
    """Writes files of a tree on a mounted file system, of spare ones as long as there are some."""

    def __init__(self, spare: str | None):
        self.files, self.dirs, self.in_use, self.known = Spares(spare, ".files"), Spares(spare, ".dirs"), [], set()

    def empty_dir(self) -> bytes | None:
        """A spare directory of which all that was in it is taken over."""
        while old := self.dirs.take():
            with os.scandir(old) as children:
                if next(children, None) is None:
                    return old
            self.in_use.append(old)
        return None

    def make_dir(self, path: bytes) -> None:
        if path in self.known:
            return
        if not os.path.isdir(path):
            self.make_dir(os.path.dirname(path))
            old = self.empty_dir()
            if not (old and _move_dir(old, path)):
                os.makedirs(path, exist_ok=True)
                if old:
                    self.dirs.paths.append(old)
        if len(self.known) >= DIRS_KNOWN:
            self.known.clear()
        self.known.add(path)

    def put(self, path: bytes, data: bytes) -> None:
        self.make_dir(os.path.dirname(path))
        if old := self.files.take():
            try:
                os.link(old, path)
                os.unlink(old)
            except FileExistsError:
                self.files.paths.append(old)
        handle = os.open(path, os.O_WRONLY | os.O_CREAT, 0o666)
        try:
            os.truncate(handle, len(data))
            while data:
                data = data[os.write(handle, data):]
        finally:
            os.close(handle)

    def close(self) -> None:
        self.files.leave(self.files.paths[::-1])
        self.dirs.leave(self.in_use + self.dirs.paths[::-1])


class StoreTree:
    """Writes files of a tree by the file system of its URI."""

    def __init__(self, store: fs.FileSystem):
        self.store = store

    def put(self, path: bytes, data: bytes) -> None:
        target = path.decode()
        self.store.create_dir(os.path.dirname(target), recursive=True)
        with self.store.open_output_stream(target) as f:
            f.write(data)

    def close(self) -> None:
        pass


def _write(base: str, spare: str | None = None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _store(base)
        out = LocalTree(spare and _store(spare)[1]) if isinstance(store, fs.LocalFileSystem) else StoreTree(store)
        try:
            for batch in batches:
                for project, path, content in zip(batch["project"], batch["path"], batch["content"]):
                    if ".." in path.split("/"):
                        raise ValueError(f"path leaves its tree: {path}")
                    out.put(f"{top}/{project}/{path}".encode(), content.encode("utf-8", "replace"))
                yield pd.DataFrame({"n": [len(batch)]})
        finally:
            out.close()

    return run


def write_trees(files: DataFrame, base: str, spare: str | None = None) -> int:
    """Write files as directory trees ``base/project/path``; returns how many there were.

    ``base`` is a directory or URI that all executors see. A task that runs again writes the
    same files again; of files with one path any one stays. A null content is empty. Python is
    sent some 16 MB of contents at a time, however long the files are. ``spare`` is a folder
    that ``hand_on_trees`` has listed files and directories in; they are used up first.
    """
    rows = files.select("project", "path", F.coalesce("content", F.lit("")).alias("content"))
    write = _write(_uri(base), _uri(spare)) if spare else _write(_uri(base))
    with _python_batches(files.sparkSession):
        return rows.mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


@contextmanager
def _python_batches(spark: SparkSession) -> Iterator[None]:
    """Send Python some 16 MB at a time."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key, None)
    conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _remove(base: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _store(base)
        for batch in batches:
            for row in batch.itertuples(index=False):
                target = f"{top}/{row.project}/{row.part}".rstrip("/")
                kind = store.get_file_info(target).type
                if kind == fs.FileType.Directory:
                    store.delete_dir(target)
                elif kind == fs.FileType.File:
                    store.delete_file(target)
            yield pd.DataFrame({"n": [len(batch)]})

    return run


def _hand_on(base: str, folder: str, tasks: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = _store(base)[1].encode()
        for batch in batches:
            for part in batch["id"]:
                files, dirs = [], [top + b"/" + name for name in os.listdir(top) if zlib.crc32(name) % tasks == part]
                # The list grows while it is read.
                for here in dirs:
                    with os.scandir(here) as children:
                        for child in children:
                            (dirs if child.is_dir(follow_symlinks=False) else files).append(child.path)
                # A task that runs again leaves the same lists. A directory stands behind those below it.
                Spares(folder, ".files").leave(sorted(files), str(part))
                Spares(folder, ".dirs").leave(sorted(dirs, reverse=True), str(part))
            yield pd.DataFrame({"n": [len(batch)]})

    return run


def _clear(folder: str, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spares = Spares(folder, kind)
            while path := spares.take():
                try:
                    os.unlink(path) if kind == ".files" else os.rmdir(path)
                except OSError:
                    pass  # Of a failed task; goes with its tree.
            yield pd.DataFrame({"n": [len(batch)]})

    return run


def remove_trees(files: DataFrame, base: str) -> None:
    """Remove what ``write_trees`` has written: what lies at the top of each tree, then the trees."""
    tops = files.select("project", F.substring_index("path", "/", 1).alias("part"))
    for rows in (tops, tops.select("project", F.lit("").alias("part"))):
        spread = rows.distinct().repartition(files.sparkSession.sparkContext.defaultParallelism)
        spread.mapInPandas(_remove(_uri(base)), "n long").agg(F.sum("n")).first()


def hand_on_trees(spark: SparkSession, base: str, spare: str) -> None:
    """List all that is below ``base`` in the folder ``spare``, for ``write_trees`` to use up.

    Directories are listed when the next tree is handed on, as their files are taken over first.
    """
    folder = _store(_uri(spare))[1]
    before = [name for name in os.listdir(folder) if name.endswith(".kept")]
    mine = f"{folder}/{time.time_ns():020d}"
    os.mkdir(mine)
    _each_task(spark, _hand_on(_uri(base), mine, spark.sparkContext.defaultParallelism))
    for name in os.listdir(mine):
        os.rename(f"{mine}/{name}", f"{mine}-{name}" + (".kept" if name.endswith(".dirs") else ""))
    for name in before:
        try:
            os.rename(f"{folder}/{name}", f"{folder}/{name.removesuffix('.kept')}")
        except FileNotFoundError:
            pass  # Another tree was handed on at the same time.


def remove_spares(spark: SparkSession, trees: str, spare: str) -> None:
    """Remove the files and directories that no tree has used up, and what failed tasks have left."""
    folder = _store(_uri(spare))[1]
    for kind in (".files", ".dirs", ".kept"):
        _each_task(spark, _clear(folder, kind))
    store, top = _store(_uri(trees))
    for path in (top, folder):
        if os.path.isdir(path):
            store.delete_dir(path)


def _each_task(spark: SparkSession, run) -> None:
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).mapInPandas(run, "n long").agg(F.sum("n")).first()


def _batches(counts: list[tuple[int, int]], most: int) -> Iterator[list[int]]:
    """Buckets in batches of up to ``most`` files, or of one bucket."""
    batch, held = [], 0
    for bucket, n in counts:
        if batch and held + n > most:
            yield batch
            batch, held = [], 0
        batch.append(bucket)
        held += n
    if batch:
        yield batch


def written_and_walked(files: DataFrame, base: str, most: int = FILES_AT_ONCE) -> DataFrame:
    """The entries of all trees, written as directories and walked some batches at a time.

    A small file takes a block of the disk whatever its size, so no more than some batches of trees
    lie there at once: what one has at the top of a project stays together, is walked as a tree
    and removed. Rows wait for their batch in a Parquet table, as the entries found do after it.
    On a mounted file system, what is removed is used up by the batches after it.
    """
    spark = files.sparkSession
    # A project named so may be a core itself, and stays whole.
    whole = F.lower("project") == "system"
    bucket = F.pmod(F.xxhash64("project", F.when(whole, F.lit("")).otherwise(F.substring_index("path", "/", 1))), F.lit(TREE_BUCKETS))
    rows = files.select("project", "path", "content").withColumn("bucket", bucket.cast("int"))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{base}/waiting")
    waiting = spark.read.schema("project string, path string, content string, bucket int").parquet(f"{base}/waiting")
    counts = sorted((r["bucket"], r["count"]) for r in waiting.groupBy("bucket").count().collect())
    store, _ = _store(_uri(base))
    spare = f"{base}/spare" if isinstance(store, fs.LocalFileSystem) else None
    if spare:
        folder = _store(_uri(spare))[1]
        os.makedirs(folder)
        if not _can_spare(folder):
            store.delete_dir(folder)
            spare = None

    def one(i: int, buckets: list[int]) -> None:
        part = waiting.where(F.col("bucket").isin(buckets)).drop("bucket")
        root = f"{base}/trees/{i}"
        # Rows of one path meet in one task.
        write_trees(part.repartition(spark.sparkContext.defaultParallelism, "project", "path"), root, spare)
        walk(spark, [("all", root)]).write.parquet(f"{base}/entries/batch={i}")
        if spare:
            hand_on_trees(spark, root, spare)
        else:
            remove_trees(part, root)

    batches = list(_batches(counts, max(1, most // BATCHES_AT_ONCE)))
    with _python_batches(spark), ThreadPoolExecutor(BATCHES_AT_ONCE) as pool:
        list(pool.map(inheritable_thread_target(spark)(one), range(len(batches)), batches))
    if spare:
        remove_spares(spark, f"{base}/trees", spare)
    return spark.read.schema(_ENTRY + ", batch int").parquet(f"{base}/entries").drop("batch") if counts else spark.createDataFrame([], _ENTRY)


def tree_rows(objects: DataFrame) -> DataFrame:
    """The ``files`` table of trees of which only the files are listed, as object stores do.

    ``objects(project, path, size, content)`` has paths below the tree's root. Files below
    ignored directories go, and every other directory above a file gets a row. Only files
    with a ``system`` directory above them are shuffled.
    """
    seen = objects.select("project", "path", F.lit(False).alias("is_dir"), "size", "content")
    kept = seen.where(~paths.in_ignored_dir(F.col("path")))
    ignored = F.array(*[F.lit(d) for d in IGNORED_DIRS])
    above = seen.select("project", F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    directories = above.where(~F.arrays_overlap(paths.parts(F.col("path")), ignored)).select(
        "project", "path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("content")
    )
    # The innermost directory named so, at an entry or above it.
    system = codelines.system_dir(F.concat("path", F.lit("/")))
    plain = kept.where(system == "").withColumn("in_core", F.lit(False))
    inside = kept.where(system != "").withColumn("core_dir", system)
    named = directories.where(system != "").select("project", F.lit(None).cast("string").alias("path"), system.alias("core_dir"))
    cores = codelines.core_dirs(inside.select("project", "path", "core_dir").unionByName(named)).withColumn("in_core", F.lit(True))
    # A directory without any is looked up by its own path, in vain.
    own = F.coalesce(F.nullif(system, F.lit("")), F.col("path"))
    looked_up = inside.unionByName(directories.withColumn("core_dir", own))
    flagged = looked_up.join(cores, ["project", "core_dir"], "left").withColumn("in_core", F.coalesce("in_core", F.lit(False)))
    return plain.unionByName(flagged.select(*plain.columns))


def with_unit(files: DataFrame) -> DataFrame:
    """Add ``unit``: which group of rules may read a file, by name alone."""
    path = F.col("path")
    config = paths.may_be_config(path)
    code = paths.is_source(path) & ~paths.is_minified(path)
    unit = (
        F.when(F.coalesce(F.col("is_dir"), F.lit(False)), "dir")
        .when(paths.is_manifest(path), "manifest")
        .when(code & config, "code_and_config")
        .when(code, "code")
        .when(config, "config")
        .otherwise("other")
    )
    return files.withColumn("unit", unit)


def write_files(files: DataFrame, path: str) -> None:
    """Store a ``files`` table partitioned by unit, so that every group of rules reads
    only the contents it needs."""
    with_unit(files).write.mode("overwrite").partitionBy("unit").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
