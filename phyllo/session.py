"""Session settings and the shared folder that operators cut lineage into."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Of sessions in one process only; a cluster's number of shuffle partitions is its own matter.
LOCAL_CONF = {"spark.sql.shuffle.partitions": "8"}


def _in_one_process(master: str) -> bool:
    return re.fullmatch(r"local(\[[^\]]*\])?", master) is not None


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``conf``, and with the settings above where neither ``conf`` nor the cluster names them.

    What ``spark-submit --conf``, ``spark-defaults.conf`` or a session that is
    there already says stays as it is. The package is sent to the executors, so
    operators with Python kernels run from any folder.
    """
    there = SparkSession.getActiveSession()
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
        if _in_one_process(master):
            conf = {"spark.ui.enabled": "false"} | conf
    if "spark.app.name" not in conf:
        builder = builder.appName("phyllo")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if there is None:
        given = spark.sparkContext.getConf()
        for key, value in (SESSION_CONF | (LOCAL_CONF if _in_one_process(spark.sparkContext.master) else {})).items():
            if not given.contains(key):
                spark.conf.set(key, value)
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where none is named and all runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not _in_one_process(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="phyllo-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


_FOLDERS: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder, which goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_dir(spark).rstrip('/')}/phyllo-{app}"
        atexit.register(_leave, spark, app)
    return f"{_FOLDERS[app]}/{name}-{uuid.uuid4().hex}"


def _leave(spark: SparkSession, app: str) -> None:
    if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
        _delete(spark, _FOLDERS[app])


#: Paths of cut tables, with a weak reference to the file index that every plan over such a table holds.
_CUT: dict[str, tuple[str, object]] = {}


def sweep(spark: SparkSession) -> list[str]:
    """Delete the cut tables that no plan reads any more, and name them."""
    app = spark.sparkContext.applicationId
    gone = [path for path, (owner, index) in _CUT.items() if owner == app and index.refersTo(None)]
    for path in gone:
        _delete(spark, path)
        del _CUT[path]
    return gone


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, computes a
    frame that several later stages read only once, and gives the optimizer the
    true size of the table, so that broadcast choices are checked against it.
    Zstandard keeps the files small, and its buffers are not the kind that many
    small tasks pile up outside of the heap. Tables that no plan reads any more,
    as the JVM's garbage collection tells, are deleted on the way.
    """
    spark = df.sparkSession
    sweep(spark)
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _CUT[path] = spark.sparkContext.applicationId, spark._jvm.java.lang.ref.WeakReference(back._jdf.queryExecution().analyzed().relation().location())
    return back


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, rows: int = 500) -> DataFrame:
    """``df`` dealt to tasks of about ``rows`` rows each, for tables whose rows are small but give much work or many bytes: Spark sizes tasks by the bytes that it reads."""
    return df.repartition(max(1, -(-df.count() // rows)))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder_of_zip = tempfile.mkdtemp(prefix="phyllo-")
    atexit.register(shutil.rmtree, folder_of_zip, ignore_errors=True)
    target = os.path.join(folder_of_zip, "phyllo.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
