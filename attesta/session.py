"""SparkSession with the settings the engine is written for."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "attesta", **settings: str) -> SparkSession:
    """A session; ``settings`` override the defaults. The cluster's own master is used unless one is given."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make the package importable on the workers, unless their Python path has it already. Done once a context."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or (context.master.startswith("local[") and os.getcwd() == root)
    if known or getattr(context, "_attesta_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(), "attesta.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "attesta")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    context.addPyFile(target)
    context._attesta_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, one is set for a local master, whose only machine is the driver's; a cluster without it
    is an error, as a folder of the driver would be no use there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file:///tmp/checkpoints/attesta-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def scratch_folder(spark: SparkSession) -> str:
    """A new folder within the shared one, removed when the driver exits."""
    path = f"{shared_folder(spark)}/attesta-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            fs, where = file_system(spark, path)
            fs.delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass

    atexit.register(remove)
    return path
