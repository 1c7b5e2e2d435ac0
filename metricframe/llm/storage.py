"""Tables that cut lineage, written to the folder all executors share."""

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

#: Bytes of a batch that goes to Python, where :func:`small_batches` says so.
BATCH_BYTES = 2 << 20
_OWN: dict[str, str] = {}
#: What is written and not yet released: path to the Hadoop path and its file system.
_LIVE: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a private one only where that is unset and all tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share; intermediate tables are written to it")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="metricframe-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The files outlive any executor, so later stages restart from them instead of
    recomputing the plan that made them.  They are deleted by :func:`release`,
    :func:`release_all` or at the end of the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    _LIVE[path] = (target, target.getFileSystem(spark._jsc.hadoopConfiguration()))
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._materialized_at = path
    return back


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python in batches of about :data:`BATCH_BYTES` for what is run inside, unless the session has a limit of its own.

    Else a batch is 10000 rows, tens of MB of texts, which a task holds several times over
    outside the heap: in the vector, in the buffer it is written to and in the worker.
    """
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(conf, None) is not None:
        yield
        return
    spark.conf.set(conf, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(conf)


def _delete(path: str) -> None:
    target, system = _LIVE.pop(path)
    system.delete(target, True)


def release(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for the tables; only for those that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_materialized_at", None)
        if path in _LIVE:
            _delete(path)


def release_all() -> None:
    """Delete every intermediate table of this driver: for long sessions, once the results made so far are no longer read."""
    for path in list(_LIVE):
        _delete(path)


def _at_exit() -> None:
    try:
        release_all()
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        _LIVE.clear()


atexit.register(_at_exit)


def importable(spark: SparkSession) -> None:
    """Ship this package to the executors, once a Spark application, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_metricframe_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="metricframe-code-")  # on the driver, which serves it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "metricframe_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted([*package.rglob("*.py"), *package.rglob("*.npz")]):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    context._metricframe_shipped = True
