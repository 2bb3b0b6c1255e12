"""What the operators share on the driver: the shared folder, materialised tables, worker code by value."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module_name: str) -> None:
    """Pickle a module's functions by value: executors then need no copy of this package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's, else, in a single local JVM only, a new temporary one."""
    uri = spark.conf.get("spark.checkpoint.dir", None)
    if not uri:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        uri = known.get() if known.isDefined() else None
    if not uri:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        uri = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(uri)
    return uri.rstrip("/")


#: URIs only: functions of these modules travel to the executors by value, with their modules' globals.
_made: list[str] = []


def _remove() -> None:
    spark = SparkSession.getActiveSession()
    for uri in _made if spark else []:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone by then; the folder is scratch space
            return


atexit.register(_remove)


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder (not yet made) in the shared folder; removed when the driver ends."""
    uri = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(uri)
    return uri


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    uri = new_folder(df.sparkSession, name)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns of any name never reach the operators' own ones."""
    return df.select(*[df[n] for n in names])


def ascii_lower(col: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
