"""Session helpers: a tuned local session for tests/bench and a shared checkpoint folder.

On a cluster the session is created by the caller; these helpers only read its
settings. ``checkpoint_dir`` honours ``spark.checkpoint.dir`` and only falls back to
a fresh scratch folder when the setting is absent (local tests).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


# Settings for a large cluster (~100 TB inputs). AQE sizes shuffle partitions from measured map
# output (coalescing toward the advisory size) and splits skewed join partitions; scans cut
# files into 256 MiB splits; the broadcast threshold stays modest because every explicit
# broadcast in this package is of a table with a structural bound. ``spark.checkpoint.dir``
# must name shared storage: written tables that cut lineage go there, never to a local folder.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def apply_cluster_conf(spark: SparkSession, overrides: dict[str, str] | None = None) -> None:
    """Set the runtime-modifiable SQL settings above on an existing session."""
    for k, v in {**CLUSTER_CONF, **(overrides or {})}.items():
        spark.conf.set(k, v)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quiver") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUIVER_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quiver`` importable on the Python workers (once per application).

    Operators that run Python inside tasks (Arrow batches) call this. On a cluster submit the
    package with ``--py-files`` (then this is a no-op); otherwise it zips the package's source
    files on the driver and registers the archive with ``addPyFile``, and executors fetch it
    from the driver.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    submitted = sc.getConf().get("spark.submit.pyFiles", "") or ""
    if "quiver" in submitted:  # already shipped by spark-submit --py-files
        _SHIPPED.add(app)
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="quiver-pyfiles-"), "quiver.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches sent to Python end at ``BATCH_BYTES``, in the whole session; a smaller setting stays.

    Rows alone bound a batch loosely: 10,000 texts are tens of MB, held by the JVM twice and by the Python worker.
    The setting is read when a query runs, so it can't be undone as soon as a DataFrame is returned.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)b?\s*", (spark.conf.get(key, None) or "").lower())  # as Spark writes sizes; others are no bound
    size = int(now[1]) << 10 * " kmgtp".index(now[2] or " ") if now else 0
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Without either, a local session (tests) gets a scratch folder; on a cluster there is no folder
    that all executors share, so this raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.split("[")[0] == "local":
        raise RuntimeError(f"set spark.checkpoint.dir to storage that the driver and all executors share (master {sc.master})")
    path = configured or tempfile.mkdtemp(prefix="quiver-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def tables_dir(spark: SparkSession) -> str:
    """Where this application's written tables lie."""
    return f"{checkpoint_dir(spark).rstrip('/')}/quiver-tables/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a written table in the shared checkpoint folder, and read it back.

    The write is an ordinary query, so AQE sizes its output (a 10-row model table becomes one
    file, a large table many), and the re-read table carries real size statistics for later
    join planning. The files live under ``spark.checkpoint.dir`` (shared storage on a cluster),
    so a lost executor does not lose them; :func:`release_tables` deletes them when a run is done.
    """
    import uuid

    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_tables(spark: SparkSession) -> None:
    """Delete every table this application wrote with :func:`materialize` (their readers end with it)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
