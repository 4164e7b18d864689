"""The engine as a library: analyse a directory, files, one file, or text."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import SparkSession

from gatecrest.plans.exposure import Analysis, analyse
from gatecrest.sources import files

MIN_CONFIDENCE = 0.7


class Engine:
    def __init__(self, spark: SparkSession, exclude: Sequence[str] = files.EXCLUDE, min_confidence: float = MIN_CONFIDENCE, max_files: int | None = None) -> None:
        self.spark, self.exclude, self.min_confidence, self.max_files = spark, exclude, min_confidence, max_files

    def analyse_directory(self, path: str, project: str = "") -> Analysis:
        return analyse(files.from_directory(self.spark, path, project, self.exclude, self.max_files), self.min_confidence)

    def analyse_files(self, paths: Sequence[str], root: str, project: str = "") -> Analysis:
        """Those of the paths, relative to root, that exist and can be analysed."""
        return analyse(files.from_paths(self.spark, paths, root, project, self.max_files), self.min_confidence)

    def analyse_file(self, path: str) -> Analysis:
        """One file, whatever its confidence; an unsupported one gives a failed file."""
        with open(path, encoding="utf-8", errors="replace") as f:
            return self.analyse_source(f.read(), posixpath.basename(path))

    def analyse_source(self, text: str, virtual_path: str) -> Analysis:
        return analyse(files.from_sources(self.spark, [("", virtual_path, text)]))
