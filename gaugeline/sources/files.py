"""Which files to read."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

CSV_GLOB = "*.[cC][sS][vV]"


@dataclass(frozen=True)
class FileSet:
    """Named files, and directories with the rules for looking into them.

    A directory is listed by Spark: its top level, or everything below it when ``recursive``, down to
    ``max_depth`` levels of sub-directories.  ``extension`` restricts what is found in directories, not the
    files that were named.
    """

    files: tuple[str, ...] = ()
    directories: tuple[str, ...] = ()
    recursive: bool = False
    extension: str | None = None
    max_depth: int | None = None

    @property
    def is_empty(self) -> bool:
        return not self.files and not self.directories

    def scan(
        self, spark: SparkSession, load: Callable[[DataFrameReader, list[str]], DataFrame], csv: bool | None = None
    ) -> list[DataFrame]:
        """Frames from ``load(reader, paths)``; ``csv`` keeps only CSV files, or only the others."""
        frames = []
        named = [f for f in self.files if csv is None or f.lower().endswith(".csv") == csv]
        if named:
            frames.append(load(_reader(spark), named))
        for directory in self.directories:
            reader = _reader(spark).option("recursiveFileLookup", str(self.recursive).lower())
            if csv and self.extension is None:
                reader = reader.option("pathGlobFilter", CSV_GLOB)
            elif self.extension is not None:
                reader = reader.option("pathGlobFilter", f"*{self.extension}")
            frame = load(reader, [directory])
            name = F.col("_metadata.file_name")
            if csv is not None and not (csv and self.extension is None):
                is_csv = F.lower(name).endswith(".csv")
                frame = frame.where(is_csv if csv else ~is_csv)
            # Without looking below, Spark still goes into directories named like values of a partition column.
            depth = self.max_depth if self.recursive else 0 if _has_partitions(spark, directory) else None
            if depth is not None:
                below = levels_below(F.col("_metadata.file_path"), path_of(spark, directory))
                frame = frame.where(below <= depth)
            frames.append(frame)
        return frames


def _reader(spark: SparkSession) -> DataFrameReader:
    return spark.read.option("ignoreMissingFiles", "true")


def levels_below(path, directory: str):
    """Sub-directories between ``directory`` and a file in it; both without scheme and host, whatever the store."""
    plain = F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?/*", "/")
    above = [part for part in directory.split("/") if part]
    return F.size(F.filter(F.split(plain, "/"), lambda part: part != "")) - len(above) - 1


def _file_status(spark: SparkSession, path: str):
    """Hadoop's status of a path, None when there is nothing."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(hadoop_path) if system.exists(hadoop_path) else None


def _has_partitions(spark: SparkSession, directory: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return any(s.isDirectory() and "=" in s.getPath().getName() for s in found)


def path_of(spark: SparkSession, directory: str) -> str:
    return _file_status(spark, directory).getPath().toUri().getPath()


def exists(spark: SparkSession, path: str) -> bool:
    return _file_status(spark, path) is not None


def collect_files(
    spark: SparkSession, paths: str | Sequence[str], recursive: bool = False, extension: str | None = None,
    max_depth: int | None = None,
) -> FileSet:
    """Sort out files and directories; a path that is not there is reported and skipped."""
    files, directories = [], []
    for path in [paths] if isinstance(paths, str) else paths:
        status = _file_status(spark, path)
        if status is None:
            warnings.warn(f"no such file: {path}", stacklevel=2)
        elif status.isDirectory():
            directories.append(path.rstrip("/") or "/")
        else:
            files.append(path)
    if extension and not extension.startswith("."):
        extension = "." + extension
    depth = None if max_depth is None or max_depth < 0 else max_depth
    return FileSet(tuple(files), tuple(directories), recursive, extension or None, depth)
