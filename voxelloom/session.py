"""Session helpers: local builder, package shipping, shared scratch tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch between the JVM and Python workers, and Spark's default, which is large where rows are whole texts.
BATCH, ARROW, ARROW_DEFAULT = "8m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_SHIPPED: "weakref.WeakSet" = weakref.WeakSet()
_WRITTEN: list[tuple[SparkSession, str]] = []
_PATHS: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def local_session(cpus: int | str = "*", app: str = "voxelloom", **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("VOXELLOOM_DRIVER_MEMORY", "8g"),
        "spark.sql.shuffle.partitions": "8",
    }
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per context, and bound the session's Arrow batches
    by ``BATCH`` bytes where it has Spark's default."""
    if spark.conf.get(ARROW) == ARROW_DEFAULT:
        spark.conf.set(ARROW, BATCH)
    sc = spark.sparkContext
    if sc in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="voxelloom-ship-")
    path = os.path.join(folder, f"voxelloom-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(path)
    atexit.register(shutil.rmtree, folder, True)
    _SHIPPED.add(sc)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster session without it is an
    error, since a machine-local folder would not be seen by the other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    folder = "file://" + tempfile.mkdtemp(prefix="voxelloom-shared-")
    atexit.register(shutil.rmtree, folder[7:], True)
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already; the folder belongs to the cluster
            return


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of :func:`written` that nothing reads any more; others are left alone."""
    for df in tables:
        if df is not None and (path := _PATHS.pop(df, None)):
            _delete(df.sparkSession, path)
            _WRITTEN.remove((df.sparkSession, path))


atexit.register(_sweep)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts lineage, survives lost executors and is computed once, unlike a reliable checkpoint, which
    runs its job twice. The folder goes with :func:`discard`, or when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
