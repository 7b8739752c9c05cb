"""Session helpers: a scratch folder that all executors share, and shipping of this package to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []

#: Shuffle files go when an execution has ended: what is written needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a table that make one part of it, where it is dealt by its size.
PART_ROWS = 500_000


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, in a folder of this application's own, which may go when it has ended.

    Where the setting is missing on one machine (tests), a temporary folder stands in until Python exits. On a cluster,
    executors would not share such a folder, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
        base = _own["dir"]
    _made.append(f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    kept = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept) if kept is not None else spark.conf.unset(CLEANUP)
    read = spark.read.schema(df.schema).parquet(path)
    read._scratch_path = path
    return read


def release(df: DataFrame) -> None:
    """Delete what materialize wrote for df: for tables of finished rounds, once all that was made of them is written."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes what is written to the scratch folder within, at its end, but for tables of materialize put on the list."""
    begun, kept = len(_made), []
    yield kept
    stay = {getattr(df, "_scratch_path", None) for df in kept}
    for path in _made[begun:]:
        if path not in stay:
            _delete(spark, path)
    _made[begun:] = [path for path in _made[begun:] if path in stay]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python functions in it can be unpickled there."""
    app = spark.sparkContext.applicationId
    if _own.get("shipped") == app:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-")), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _own["shipped"] = app


def parts_of(df: DataFrame) -> int:
    """How many parts of PART_ROWS rows df has, one at least."""
    return -(-df.count() // PART_ROWS) or 1


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df dealt by keys into so many parts; as it is, if shuffles make as many or more by setting.

    The setting is one number for tables of all sizes, so that what a task sorts or keeps grows with the table."""
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
