"""What a job needs from its session: shipped code and shared folders."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="lodestrata-")) / "lodestrata_code.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, f"{_PACKAGE.name}/{source.relative_to(_PACKAGE)}")
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the setting is absent (local tests) a temporary folder takes its place.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local
    if not _local:
        _local = f"file://{tempfile.mkdtemp(prefix='lodestrata-shared-')}"
    return _local


_local = ""


_made: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which ``sweep`` removes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Removes what this application wrote to the shared folder, once its results have been used; returns how many paths."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    java = spark.sparkContext._jvm
    for path in paths:
        place = java.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def settle(df: DataFrame, name: str = "stage", options: dict[str, str] | None = None) -> DataFrame:
    """Writes a table to the shared folder and returns a scan of it, which cuts the lineage.

    Unlike an in-memory cache, the rows outlive a lost executor. ``options`` are those of
    the Parquet writer.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a narrow table that may be broadcast: some 64 MB.
BROADCAST_ROWS = 1 << 20


def few(keys: DataFrame) -> bool:
    """Whether a settled table of keys has few enough rows for a broadcast."""
    return keys.count() <= BROADCAST_ROWS


def marked(keys: DataFrame) -> DataFrame:
    """A settled table of keys, marked for a broadcast if it has few enough rows.

    A larger one is left to a shuffled join.
    """
    return F.broadcast(keys) if few(keys) else keys


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt to all tasks before work that takes long, as a small file is read by few; rows of equal keys to one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def free_name(df: DataFrame, name: str) -> str:
    """A name that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """A schema with more fields behind its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def session(app: str = "lodestrata", cores: str | None = None) -> SparkSession:
    """A local session with the settings that tests and bench use."""
    return (
        SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
