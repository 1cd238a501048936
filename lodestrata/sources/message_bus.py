"""A bus of messages: documents in a folder, published by a sink and read in order by a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lodestrata.runtime import ship
from lodestrata.sources.document_sink import write_documents

_FORMAT = "lodestrata_messages"
#: Messages that a task reads.
PER_TASK = 256


@dataclass
class _Names(InputPartition):
    names: tuple[str, ...]


class _Folder:
    def __init__(self, options: dict) -> None:
        self.path, self.per_task = options["path"], int(options.get("pertask", PER_TASK))

    def _root(self) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return files, root.rstrip("/")

    def names(self, after: str = "", to: str | None = None) -> list[str]:
        """The messages behind one, up to another, in order."""
        files, root = self._root()
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith(".") and f.base_name > after and (to is None or f.base_name <= to))

    def dealt(self, names: list[str]) -> list[_Names]:
        return [_Names(tuple(names[i : i + self.per_task])) for i in range(0, len(names), self.per_task)]

    def rows(self, part: _Names) -> Iterator[tuple[str, str]]:
        files, root = self._root()
        for name in part.names:
            with files.open_input_stream(f"{root}/{name}") as source:
                yield name, source.read().decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, folder: _Folder) -> None:
        self.folder = folder

    def partitions(self) -> list[_Names]:
        return self.folder.dealt(self.folder.names()) or [_Names(())]

    def read(self, partition: _Names) -> Iterator[tuple[str, str]]:
        yield from self.folder.rows(partition)


class _Stream(DataSourceStreamReader):
    """An offset is the name of the last message read."""

    def __init__(self, folder: _Folder) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"name": ""}

    def latestOffset(self) -> dict:
        return {"name": (self.folder.names() or [""])[-1]}

    def partitions(self, start: dict, end: dict) -> list[_Names]:
        return self.folder.dealt(self.folder.names(start["name"], end["name"])) or [_Names(())]

    def read(self, partition: _Names) -> Iterator[tuple[str, str]]:
        yield from self.folder.rows(partition)


class Messages(DataSource):
    """Rows (name, body) of the documents below the option ``path``, in the order of their names."""

    @classmethod
    def name(cls) -> str:
        return _FORMAT

    def schema(self) -> str:
        return "name string, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Folder(dict(self.options)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(_Folder(dict(self.options)))


def publish(messages: DataFrame, number: Column, body: Column, path: str) -> None:
    """Puts messages on the bus, all or none; ``number`` is unique and above all numbers put there before."""
    write_documents(messages.select(F.concat(F.lpad(number.cast("string"), 20, "0"), F.lit(".msg")).alias("name"), body.alias("body")), path)


def waiting(spark: SparkSession, path: str) -> DataFrame:
    """All messages on the bus."""
    ship(spark)
    spark.dataSource.register(Messages)
    return spark.read.format(_FORMAT).option("path", path).load()


def consume(spark: SparkSession, path: str, per_task: int = PER_TASK) -> DataFrame:
    """A stream of the messages, each once for each checkpoint, first in, first out from batch to batch.

    A stream that starts again goes on behind the last message of its checkpoint.
    """
    ship(spark)
    spark.dataSource.register(Messages)
    return spark.readStream.format(_FORMAT).option("path", path).option("perTask", str(per_task)).load()
