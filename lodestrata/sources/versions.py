"""Folders whose content is replaced at once, on any file system that Spark writes to.

A version is written below a folder of its own and counts from the moment on at which its
manifest, a small JSON file, is renamed into place. A writer that dies leaves files that
no reader looks at.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class Versions:
    """The versions below a path, by number."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._java = spark.sparkContext._jvm
        self._files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._java.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def folder(self, number: int) -> str:
        """Where a version's tables are written."""
        return f"{self.path}/v{number:08d}"

    def numbers(self) -> list[int]:
        """The published versions, the last one at the end."""
        if not self._files.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._at(""))]
        return sorted(int(n[9:17]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:17].isdigit())

    def manifest(self, number: int) -> dict[str, Any] | None:
        """A version's manifest; None if it can't be read."""
        try:
            stream = self._files.open(self._at(f"manifest-{number:08d}.json"))
            try:
                got = json.loads(self._java.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        except Exception:  # missing, unreadable or no JSON: as if it weren't there
            return None
        return got if isinstance(got, dict) else None

    def current(self) -> tuple[int, dict[str, Any]] | None:
        """The last version whose manifest can be read."""
        for number in reversed(self.numbers()):
            if (held := self.manifest(number)) is not None:
                return number, held
        return None

    def next(self) -> int:
        """A number above all that were published."""
        return (self.numbers() or [0])[-1] + 1

    def publish(self, number: int, manifest: dict[str, Any]) -> None:
        """Makes a version the current one; fails if another writer was first."""
        draft, final = self._at(f".draft-{number:08d}"), self._at(f"manifest-{number:08d}.json")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            raise FileExistsError(f"version {number} of {self.path} was published by another writer")

    def drop(self, keep: int = 2) -> None:
        """Removes the manifests and folders of all but the last ``keep`` versions, whose readers may still run."""
        for number in self.numbers()[:-keep]:
            self._files.delete(self._at(f"manifest-{number:08d}.json"), False)
            self._files.delete(self._java.org.apache.hadoop.fs.Path(self.folder(number)), True)
