"""Source files as a DataFrame (project, file, language, source, error)."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecrest.functions import scores

EXCLUDE = tuple(f"**/{d}/**" for d in scores.EXCLUDED) + ("**/*.d.ts", "**/*.min.js")
COLUMNS = ["project", "file", "language", "source", "error"]
#: Characters of text that a batch holds before it is handed on; files that a task reads; tasks at most.
READ_BYTES, FILES_A_TASK, MAX_TASKS = 4 << 20, 32, 10_000
#: Files, and characters of text, that make a task of parsing worth its cost (as many as that, and the compiler is warm); what a task has at most, as far as files can be told apart; tasks for each core where there is that much to do.
WORTH, MOST, TASKS_A_CORE = (1 << 13, 1 << 20), (1 << 16, 1 << 24), 2


class TooManyFiles(ValueError):
    """The scan found more files than its limit; nothing is truncated."""


def from_sources(spark: SparkSession, rows: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(project, path, text) rows held in memory. A text of None counts as a file that can't be read."""
    df = spark.createDataFrame(list(rows), "project string, file string, source string")
    return _routed(df)


def from_table(df: DataFrame) -> DataFrame:
    """Files of a table (project, file, source) of any size. A null source counts as a file that can't be read."""
    return _routed(df)


def listed(path: str, exclude: Sequence[str] = EXCLUDE) -> list[str]:
    """Analysable files below a directory, relative to it and in order; excluded folders aren't entered.

    Names that begin with ``_`` or ``.`` are files like others (a scan by Spark's own file index would leave them out).
    Links to folders are not followed.
    """
    fs, root = fs_of(path)
    regex = [re.compile(scores.glob_regex(g)) for g in exclude]
    whole = [r for r, g in zip(regex, exclude) if g.endswith("/**")]  # these exclude all that a folder holds
    out, folders = [], [""]
    while folders:
        folder = folders.pop()
        for info in fs.get_file_info(pafs.FileSelector(posixpath.join(root, folder) if folder else root)):
            name = posixpath.join(folder, info.base_name)
            if info.type == pafs.FileType.Directory:
                if not any(r.match(name + "/") for r in whole) and not (isinstance(fs, pafs.LocalFileSystem) and os.path.islink(info.path)):
                    folders.append(name)
            elif posixpath.splitext(name)[1].lower() in scores.LANGUAGES and not any(r.match(name) for r in regex):
                out.append(name)
    return sorted(out)


def fs_of(path: str) -> tuple[pafs.FileSystem, str]:
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))
    return fs, root.rstrip("/") or "/"


def texts(spark: SparkSession, root: str, names: Sequence[str], project: str) -> DataFrame:
    """(project, file, source) of files below root; the executors read them. The text of a file that can't be read, or isn't UTF-8, is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = fs_of(root)
        for b in batches:
            held, size = [], 0
            for name in b.column("file").to_pylist():
                try:
                    with fs.open_input_stream(posixpath.join(base, name)) as f:
                        text = f.read().decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    text = None
                held.append((name, text))
                size += len(text or "")
                if size > READ_BYTES:
                    yield _texts(held, project)
                    held, size = [], 0
            if held:
                yield _texts(held, project)

    table = spark.createDataFrame([(n,) for n in names], "file string")
    parts = max(1, min(-(-len(names) // FILES_A_TASK), MAX_TASKS))
    return table.repartition(parts).mapInArrow(read, "project string, file string, source string")


def _texts(held: list[tuple[str, str | None]], project: str) -> pa.RecordBatch:
    names, sources = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array([project] * len(held)), pa.array(names), pa.array(sources, pa.string())], names=["project", "file", "source"])


def from_directory(spark: SparkSession, path: str, project: str = "", exclude: Sequence[str] = EXCLUDE, max_files: int | None = None) -> DataFrame:
    """All analysable files below a directory, apart from those that a glob excludes.

    The names are listed here, the bytes are read by the executors, so path must be one that they can reach (a shared
    folder, or a URI of a file system that pyarrow knows). A directory without files gives no rows.
    """
    return _some(spark, path, listed(path, exclude), project, max_files)


def from_paths(spark: SparkSession, paths: Sequence[str], root: str, project: str = "", max_files: int | None = None) -> DataFrame:
    """Those of the given paths (relative to root) that exist and can be analysed."""
    fs, base = fs_of(root)
    known = [p for p in dict.fromkeys(paths) if posixpath.splitext(p)[1].lower() in scores.LANGUAGES]
    infos = fs.get_file_info([posixpath.join(base, p) for p in known])
    return _some(spark, root, [p for p, i in zip(known, infos) if i.type == pafs.FileType.File], project, max_files)


def _some(spark: SparkSession, root: str, names: list[str], project: str, max_files: int | None) -> DataFrame:
    if max_files is not None and len(names) > max_files:
        raise TooManyFiles(f"more than {max_files} files")
    return _routed(texts(spark, root, names, project))


def parts_for(files: int, chars: int, cores: int) -> int:
    """Tasks over which so many files with so many characters are spread."""
    by = lambda bound: max(-(-files // bound[0]), -(-chars // bound[1]), 1)
    return min(max(min(by(WORTH), TASKS_A_CORE * cores), by(MOST)), MAX_TASKS)


def spread(df: DataFrame) -> DataFrame:
    """The rows (project, file, source, ...), spread over tasks by project and file where a partition has more than twice its share.

    Sources that come out of a small table lie in one partition, however many there are, and would be parsed by one core.
    """
    sizes = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.sum(F.length("source")).alias("c"))
    r = sizes.agg(*(F.coalesce(f(c), F.lit(0)).alias(f"{name}_{c}") for name, f in (("all", F.sum), ("most", F.max)) for c in ("n", "c"))).first()
    parts = parts_for(r.all_n, r.all_c, df.sparkSession.sparkContext.defaultParallelism)
    share = [max(2 * whole / parts, worth) for whole, worth in zip((r.all_n, r.all_c), WORTH)]
    return df.repartition(parts, "project", "file") if r.most_n > share[0] or r.most_c > share[1] else df


def _routed(df: DataFrame) -> DataFrame:
    language = scores.language(F.col("file"))
    error = F.when(language.isNull(), "Unsupported file type").when(F.col("source").isNull(), "Could not read file")
    return df.select("project", "file", language.alias("language"), "source", error.alias("error"))
