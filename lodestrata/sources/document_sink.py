"""A sink that writes each row as a document of its own, all of them or none."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import ship


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A folder's file system and its path there."""
    files, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return files, root.rstrip("/")


def _place(name: str, folders: int) -> str:
    """A document's place below the folder."""
    return f"{zlib.crc32(name.encode()) % folders:03x}/{name}" if folders > 1 else name


def write_documents(rows: DataFrame, path: str, folders: int = 1) -> None:
    """Writes a document for each row (name, body); documents of the same name are replaced.

    Nothing is seen below its name before all tasks are done: a run that fails leaves what
    was there. Of rows with one name the one with the largest body counts, as documents have
    no order. A null body is an empty document; a null or empty name, one with a slash or one
    that begins with a point fails the run. ``path`` is a folder that all executors reach.

    Tasks write below a hidden folder of the run, and tasks of a second job move what
    succeeded into place; the driver sees the names of their folders only. ``folders`` deals
    the documents to so many folders below the path by their names, for those who list them;
    all writers of a path have to take the same number.
    """
    spark = rows.sparkSession
    ship(spark)
    files, root = opened(path)
    draft = f"{root}/.draft-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(path)
        context = TaskContext.get()
        folder = f"{draft}/{context.partitionId()}-{context.taskAttemptId()}"
        files.create_dir(folder, recursive=False)  # fails once the run has been given up
        for batch in batches:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
                if not name or "/" in name or name.startswith("."):
                    raise ValueError(f"no name of a document: {name!r}")
                with files.open_output_stream(f"{folder}/{name}") as out:
                    out.write(body.encode() if isinstance(body, str) else bytes(body or b""))
        yield pa.RecordBatch.from_arrays([pa.array([folder])], ["folder"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(path)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                for found in files.get_file_info(fs.FileSelector(folder)):  # those that a lost task has moved are gone from here
                    files.move(found.path, f"{root}/{_place(found.base_name, folders)}")
                yield pa.RecordBatch.from_arrays([pa.array([folder])], ["folder"])

    files.create_dir(draft, recursive=True)
    try:
        once = rows.groupBy("name").agg(F.max("body").alias("body"))
        done = [r["folder"] for r in once.mapInArrow(write, "folder string").collect()]  # one for each task
        for i in range(folders if folders > 1 else 0):
            files.create_dir(f"{root}/{i:03x}")
        spark.createDataFrame([(f,) for f in done], "folder string").repartition(max(1, len(done)), "folder").mapInArrow(move, "folder string").collect()
    finally:
        files.delete_dir(draft)
