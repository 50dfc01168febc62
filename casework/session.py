"""Session helpers: building a local session and locating the shared folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "casework") -> SparkSession:
    """A local session for tests and the bench (AQE on, UI off, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # small local inputs: let AQE keep one partition per core instead of merging to 1 MB minimum
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for lineage cuts, intermediate tables and model exports.

    Taken from ``spark.checkpoint.dir``, or from a checkpoint folder already set on the context.
    Only a local session without either gets a fresh folder of its own (once per application);
    a cluster session without one is an error, since executor-local folders do not survive.
    ``spark.checkpoint.dir`` is a static setting, so it is only read here, never written.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running casework jobs")
    d = _LOCAL_DIRS.get(sc.applicationId)
    if d is None:
        d = _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="casework-ckpt-")
    sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path inside the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str):
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage, keeps
    column pruning for later readers, and survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a method above which the JVM never compiles it but interprets every call.
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
COMPILED_BYTES = 8000
_WIDE: dict[SparkSession, tuple[int, str]] = {}  # jobs inside ``wide_plans`` and the setting before them
_WIDE_LOCK = threading.Lock()


@contextmanager
def wide_plans(spark: SparkSession):
    """While it holds, plans over many columns are generated as many small methods wherever one method would be too large for
    the JVM to compile. Several threads of a session may hold it; the last one puts the setting back."""
    with _WIDE_LOCK:
        holders, before = _WIDE.get(spark, (0, spark.conf.get(HUGE_METHOD)))
        _WIDE[spark] = (holders + 1, before)
        spark.conf.set(HUGE_METHOD, str(min(int(before), COMPILED_BYTES)))
    try:
        yield
    finally:
        with _WIDE_LOCK:
            holders, before = _WIDE.pop(spark)
            if holders > 1:
                _WIDE[spark] = (holders - 1, before)
            else:
                spark.conf.set(HUGE_METHOD, before)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``casework`` importable in Python workers (what ``--py-files`` does at submit time).

    Python steps on rows (``mapInPandas``) pickle functions by module reference, so executors need
    the package. A zip of the package is added once per application with ``addPyFile``; Spark
    serves it to every executor.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="casework-pkg-"), "casework.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)
