"""Intermediate tables: written to the shared folder of the session, so that lineage ends there and any executor can read them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_bases: dict[str, str] = {}


def base(spark: SparkSession) -> str:
    """This application's folder under the one that the session names in spark.checkpoint.dir.

    Without that setting a temporary folder serves a local master, where all threads share the machine; on a cluster executors
    would not see each other's files, so there it is an error. The folder goes when the driver's process ends.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _bases:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="plinth-")
        _bases[app] = f"{named.rstrip('/')}/plinth-{app}"
        atexit.register(_remove, spark, _bases[app])
    return _bases[app]


def folder(spark: SparkSession, name: str) -> str:
    """A path that no other call gets; nothing is there yet."""
    return f"{base(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a written table: computed once, pruned by column when read, and with no lineage behind it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def spent(*tables: DataFrame) -> None:
    """Remove settled tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._settled_at)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
