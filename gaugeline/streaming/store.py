"""Results that a stream keeps: what changed per micro-batch, and a manifest that names the newest finished version.

A version is the folder of what one micro-batch changed (``version=<batch>``).  A manifest lists the versions that together
are the result, newest last; it is written under another name and renamed when its folder is complete, so a reader never sees
half a version, and a repeated batch either writes its folder anew or finds itself done.  Every ``DELTAS`` versions the rows
are put together into one.  Only what the two newest manifests name is kept.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELTAS = 8
KEPT = 2
_MANIFEST = "_manifest-"


def version_path(path: str, version: int) -> str:
    return f"{path}/version={version}"


@dataclass(frozen=True)
class Manifest:
    version: int
    parts: tuple[int, ...]
    keys: tuple[str, ...]


class Kept:
    """A kept result with one row per ``keys``; without keys a version replaces all before it."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ()) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), tuple(keys)
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._root = self._paths(self.path)
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._files.listStatus(self._root)] if self._files.exists(self._root) else []

    def manifests(self) -> list[int]:
        """Finished versions whose manifests are still there, oldest first."""
        return sorted(int(n[len(_MANIFEST):]) for n in self._names() if n.startswith(_MANIFEST))

    def manifest(self, version: int) -> Manifest:
        stream = self._files.open(self._paths(self.path, f"{_MANIFEST}{version}"))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(found["version"], tuple(found["parts"]), tuple(found["keys"]))

    def newest(self, below: int | None = None) -> Manifest | None:
        found = [v for v in self.manifests() if below is None or v < below]
        return self.manifest(found[-1]) if found else None

    def finished(self, version: int) -> bool:
        return version in self.manifests()

    def _rows(self, manifest: Manifest) -> DataFrame:
        parts = [self.spark.read.parquet(version_path(self.path, v)).withColumn("_version", F.lit(v)) for v in manifest.parts]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows

    @staticmethod
    def _newest_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        columns = [c for c in rows.columns if c != "_version"]
        values = F.struct(*[c for c in columns if c not in keys])
        # Keys may be null, which a grouping takes for a value like any other.
        return rows.groupBy(*keys).agg(F.max_by(values, "_version").alias("_row")).select(
            *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in columns])

    def read(self, below: int | None = None) -> DataFrame | None:
        """The result as of the newest finished version (before ``below``); None while there is none."""
        manifest = self.newest(below)
        if manifest is None:
            return None
        rows = self._rows(manifest)
        if len(manifest.parts) == 1 or not manifest.keys:
            return rows.drop("_version")
        return self._newest_rows(rows, manifest.keys)

    def write(self, changed: DataFrame, version: int) -> None:
        """Finish a version with the rows that changed in it; a version that is finished stays as it is."""
        if self.finished(version):
            return
        before = self.newest(version)
        parts = (*before.parts, version) if before is not None and self.keys else (version,)
        changed.write.mode("overwrite").parquet(version_path(self.path, version))
        if len(parts) > DELTAS:
            # The changed rows are read back before their folder is replaced, so they go to a folder of their own first.
            whole = self._newest_rows(self._rows(Manifest(version, parts, self.keys)), self.keys)
            staged = f"{self.path}/_whole-{version}"
            whole.write.mode("overwrite").parquet(staged)
            target = self._paths(version_path(self.path, version))
            self._files.delete(target, True)
            self._files.rename(self._paths(staged), target)
            parts = (version,)
        self._publish(Manifest(version, parts, self.keys))
        self._clean()

    def remove(self, path: str) -> None:
        self._files.delete(self._paths(path), True)

    def _publish(self, manifest: Manifest) -> None:
        text = json.dumps({"version": manifest.version, "parts": manifest.parts, "keys": manifest.keys})
        draft = self._paths(self.path, f"_draft-{manifest.version}")
        out = self._files.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._files.rename(draft, self._paths(self.path, f"{_MANIFEST}{manifest.version}"))

    def _clean(self) -> None:
        """Remove what neither of the newest manifests names; unfinished newer folders stay."""
        found = self.manifests()
        kept = found[-KEPT:]
        needed = {v for m in kept for v in self.manifest(m).parts}
        for name in self._names():
            old = (name.startswith("version=") and int(name[8:]) < found[-1] and int(name[8:]) not in needed) or (
                name.startswith(_MANIFEST) and int(name[len(_MANIFEST):]) not in kept)
            if old:
                self._files.delete(self._paths(self.path, name), True)
