"""Materialised intermediates in the folder that every executor shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Staged folders, each with a weak reference to what plans read it through.
_staged: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; only on one machine, and where none is set, an own one is made and set."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame once to the shared folder and read it back.

    It cuts lineage, lets several branches read one result, and survives the
    loss of executors because the files are not theirs. They are deleted when a later
    call finds that no plan reads them any more, at the latest when the driver ends.
    """
    spark = df.sparkSession
    sweep()
    path = f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.deleteOnExit(folder)
    back = spark.read.schema(df.schema).parquet(path)
    held = back._jdf.queryExecution().analyzed().relation().location()
    _staged.append((spark._jvm.java.lang.ref.WeakReference(held), system, folder))
    return back


def sweep() -> int:
    """Delete the staged folders that no plan reads any more; how many are left."""
    for entry in list(_staged):
        ref, system, folder = entry
        try:
            if ref.refersTo(None):
                system.delete(folder, True)
                _staged.remove(entry)
        except Exception:  # the session that staged it has ended, and its files with it
            _staged.remove(entry)
    return len(_staged)


def ensure_package(spark: SparkSession) -> None:
    """Ship this package to workers that don't see the driver's files: those of a cluster, and local ones started elsewhere."""
    sc = spark.sparkContext
    if getattr(sc, "_weft_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if not (sc.master.startswith("local") and root in map(os.path.abspath, filter(None, seen))):
        folder = tempfile.mkdtemp(prefix="weft-package-")
        atexit.register(shutil.rmtree, folder, True)
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "weft"), "zip", root, "weft"))
    sc._weft_shipped = True
