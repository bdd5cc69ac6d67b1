"""Session settings and intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one is set only where the session names none and runs on this machine alone, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cirrostrat-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts both lineage and the planner's size estimates, which plain checkpoints keep,
    and the files outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables; for tables that no later step reads."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in any file system that Spark knows, if it is there."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once for each Spark application, so that it need not be installed on them."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).parent
    target = f"{tempfile.mkdtemp(prefix='cirrostrat-')}/{here.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, str(f.relative_to(here.parent)))
    sc.addPyFile(target)  # Spark's file server copies it to every executor
    _shipped.add(sc.applicationId)
